"""Attribute statistics: cardinality, selectivity by segment, runs, and advice on promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_div

#: Thresholds of the verdicts.
STRING_SHARE, CHEAP_BYTES, COSTLY_BYTES, LEAST_ROWS, LEAST_COVERAGE, SELECTIVE = 0.9, 0.5, 2.0, 50, 0.01, 0.25
WINDOWS = {"1m": 60_000_000_000, "1h": 3_600_000_000_000, "24h": 86_400_000_000_000}


def exploded(df: DataFrame, source: str = "attributes", segment: str = "segment") -> DataFrame:
    """One row per attribute: segment, time_ns, key, value (strings verbatim, others as JSON) and whether it is a string."""
    prefix = "" if source == "attributes" else f"{source}:"
    keys = F.explode(F.json_object_keys(source)).alias("k")
    rows = df.select(segment, "time_ns", F.col(source).alias("j"), keys)
    v = F.try_variant_get(F.try_parse_json(F.col("j")), "$", "map<string,variant>")[F.col("k")]
    text = F.schema_of_variant(v) == "STRING"
    return rows.select(F.col(segment).alias("segment"), "time_ns", F.concat(F.lit(prefix), "k").alias("key"), F.when(text, F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)).alias("value"), F.coalesce(text, F.lit(False)).alias("is_string"))


def _per_segment(rows: DataFrame) -> DataFrame:
    """(key, value, segment): in which segments a value stands."""
    return rows.groupBy("key", "value", "segment").agg(F.lit(1).alias("one")).drop("one")


def _sigma(held: DataFrame, segments: DataFrame) -> DataFrame:
    """The share of segments that hold a value, summed up over a key's values.

    held: (key, value, held).  Ranks come from how many values are held by each number of segments, so a key's window
    has one row a number, whatever its cardinality.
    """
    shares = held.groupBy("key", "held").agg(F.count("*").alias("n")).join(F.broadcast(segments), F.lit(True)).withColumn("sigma", F.col("held") / F.col("segments"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("held").rowsBetween(Window.unboundedPreceding, 0))
    ranked = shares.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("key")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q + 0.5), F.col("sigma")))  # noqa: E731  the nearest rank
    bins = [F.sum(F.when(F.least(F.floor(F.col("sigma") * 10), F.lit(9)) == i, F.col("n")).otherwise(0)) for i in range(10)]
    return ranked.groupBy("key").agg(
        at(0.5).alias("sigma_p50"), at(0.9).alias("sigma_p90"), F.max("sigma").alias("sigma_max"), (F.sum(F.col("sigma") * F.col("n")) / F.sum("n")).alias("sigma_mean"),
        (F.sum(F.when(F.col("sigma") <= SELECTIVE, F.col("n")).otherwise(0)) / F.sum("n")).alias("sigma_selective"), F.array(*bins).alias("sigma_histogram"),
        F.sum(F.col("held") * F.col("n")).alias("postings"), F.sum("n").alias("distinct_values"),
    )


def key_statistics(df: DataFrame, sources: tuple[str, ...] = ("attributes",), segment: str = "segment", windows: dict[str, int] | None = None) -> DataFrame:
    """One row per key: counts, cardinality at each width, sigma, and the two verdicts.

    windows: names and widths of the cardinality ladder, in ns, rising.  C(w), the mean number of distinct values of a
    window, is over all windows that any segment begins in; sigma at a width is C(segment) / C(w).
    """
    windows = WINDOWS if windows is None else windows
    if list(windows.values()) != sorted(set(windows.values())):
        raise ValueError("widths must rise")
    rows = None
    for s in sources:
        one = exploded(df, s, segment)
        rows = one if rows is None else rows.unionByName(one)
    own = df.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("n"), F.min("time_ns").alias("first"))
    totals = [F.count("*").alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *[F.countDistinct(floor_div(F.col("first"), w)).alias(f"windows_{name}") for name, w in windows.items()]]
    unit = own.agg(*totals)
    order = Window.partitionBy("key", "segment").orderBy("time_ns", "value")
    runs = rows.withColumn("new", F.coalesce((F.col("value") != F.lag("value").over(order)).cast("int"), F.lit(1)))
    length = F.when(F.col("is_string"), F.length("value"))
    per = runs.groupBy("key").agg(F.count("*").alias("rows_present"), F.count_if("is_string").alias("rows_string"), F.avg(length).alias("str_len_avg"), F.max(length).alias("str_len_max"), F.countDistinct("segment").alias("segments_present"), F.sum("new").alias("runs"))
    placed = _per_segment(rows)
    out = per.join(_sigma(placed.groupBy("key", "value").agg(F.count("*").alias("held")), unit.select("segments")), "key").join(F.broadcast(unit), F.lit(True))
    started = placed.join(own.select("segment", "first"), "segment")
    for name, width in windows.items():
        seen = started.groupBy("key", "value", floor_div(F.col("first"), width).alias("w")).agg(F.lit(1).alias("one"))
        out = out.join(seen.groupBy("key").agg(F.count("*").alias(f"_{name}")), "key", "left").withColumn(f"distinct_{name}", F.col(f"_{name}") / F.col(f"windows_{name}")).drop(f"_{name}", f"windows_{name}")
    distinct = F.col("postings") / F.col("segments")  # C(segment)
    bits = F.when(distinct > 1, F.log2(distinct)).otherwise(0.0)
    rows_each = F.greatest(F.col("rows") / F.col("segments"), F.lit(1.0))
    bytes_ = (distinct * F.coalesce("str_len_avg", F.lit(0.0)) + F.col("runs") / F.col("segments") * bits / 8) / rows_each
    by_scale = F.map_from_arrays(F.array(*[F.lit(n) for n in windows]), F.array(*[distinct / F.col(f"distinct_{n}") for n in windows])) if windows else F.create_map().cast("map<string,double>")
    out = out.withColumns(
        {
            "string_fraction": F.col("rows_string") / F.col("rows_present"), "coverage": F.col("rows_string") / F.col("rows"), "repetition": F.col("rows_present") / F.col("postings"),
            "runs_per_row": F.col("runs") / F.col("rows_present"), "locality": F.col("distinct_values") / distinct, "sigma_by_scale": by_scale, "est_bytes_per_row": bytes_,
        }
    )
    return out.withColumns({"promote": verdict(), "index_scale": index_scale(list(windows))}).orderBy(F.col("postings").desc(), "key")


def verdict() -> Column:
    """Whether to promote a key to a column: no for few strings, - for segments too short to tell, costly, marginal, yes, or yes? for a rare key."""
    return (
        F.when(F.col("rows_present") == 0, "-")
        .when(F.col("string_fraction") < STRING_SHARE, "no")
        .when(F.col("rows") / F.col("segments") < LEAST_ROWS, "-")
        .when(F.col("est_bytes_per_row") > COSTLY_BYTES, "costly")
        .when(F.col("est_bytes_per_row") > CHEAP_BYTES, "marginal")
        .when(F.col("coverage") >= LEAST_COVERAGE, "yes")
        .otherwise("yes?")
    )


def index_scale(names: list[str]) -> Column:
    """The widest range over which an index of segments still prunes: a rung of the ladder, all, or null; null for a single segment."""
    widest = F.lit(None).cast("string")
    for name in names:  # rising, so the last that holds wins
        widest = F.when(F.col("sigma_by_scale")[name] <= SELECTIVE, F.lit(name)).otherwise(widest)
    return F.when(F.col("segments") < 2, F.lit(None)).when(1 / F.col("locality") <= SELECTIVE, F.lit("all")).otherwise(widest)


def bottom_k(rows: DataFrame, k: int) -> DataFrame:
    """For each key its k values of smallest hash: an order-independent sample of distinct values that merges.

    Values are first thinned inside each of 64 hash slices of a key, so that no window holds all of a key's values.
    """
    distinct = rows.select("key", "value").distinct().withColumn("hash", F.xxhash64("value"))
    slice_ = F.pmod(F.xxhash64(F.lit(7), "value"), F.lit(64))
    for part in (["key", slice_], ["key"]):
        distinct = distinct.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("hash", "value"))).where(F.col("place") <= k).drop("place")
    return distinct
