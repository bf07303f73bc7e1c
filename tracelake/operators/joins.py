"""As-of and interval joins, and counts by interval, as equi-joins and windows; no theta join is planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_div


def as_of_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tolerance: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row of the same key at or before it (and within tolerance).

    Both sides are unioned and one window per key carries the last right row on: one shuffle by key, a sort, no pairs.
    """
    own = left.withColumn("_side", F.lit(1)).withColumn("_row", F.struct(*left.columns))
    carried = F.struct(F.col(on).alias("_at"), *values)
    a = own.select(*by, on, "_side", "_row", F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_right"))
    b = right.select(*by, on, F.lit(0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), carried.alias("_right"))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    near = F.lit(True) if tolerance is None else F.col(on) - F.col("_last._at") <= tolerance
    return out.select("_row.*", *[F.when(near, F.col(f"_last.{v}")).alias(v) for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the half-open intervals that hold them, by bins of `width`: an interval is copied to the bins it touches, a point stands in one."""
    bin_of = lambda c: floor_div(c.cast("long"), width)
    spread = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end) - 1))))
    own = points.withColumn("_bin", bin_of(F.col(at)))
    return own.join(spread, "_bin").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def _before(counts: DataFrame, levels: int) -> DataFrame:
    """(bin, before): of all n the sum in lower bins, by bins of 1,024 bins, so that one task sums only the highest level."""
    if not levels:
        return counts.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    grouped = counts.withColumn("_group", floor_div(F.col("bin"), 1024))
    base = _before(grouped.groupBy(F.col("_group").alias("bin")).agg(F.sum("n").alias("n")), levels - 1)
    start = base.select(F.lit(None).cast("long").alias("bin"), F.col("before").alias("n"), F.col("bin").alias("_group"))  # sorts first in its group
    running = Window.partitionBy("_group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.select("bin", "n", "_group").unionByName(start).withColumn("before", F.sum("n").over(running)).where("bin is not null").select("bin", "before")


def interval_counts(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: list[str], width: int) -> DataFrame:
    """How many points the half-open intervals of a key hold, for keys that hold any: the points before the ends less those before the starts.

    Running sums inside bins of a 1,024th of `width`, the usual interval, above the sums of all lower bins: no pairs, so
    the work grows with the rows, not with the matches.
    """
    none = [F.lit(None).cast(intervals.schema[k].dataType).alias(k) for k in by]
    whole = intervals.where(F.col(end) > F.col(start))
    own = points.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("long").alias("_t")).agg(F.count("*").alias("n"))
    rows = own.select("_t", F.lit(1).alias("_side"), "n", F.lit(0).alias("_sign"), *none)
    for edge, sign in ((start, -1), (end, 1)):  # an edge stands before the points of its instant
        rows = rows.unionByName(whole.select(F.col(edge).cast("long").alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("n"), F.lit(sign).alias("_sign"), *by))
    rows = rows.withColumn("_bin", floor_div(F.col("_t"), max(1, width // 1024)))
    base = _before(rows.groupBy(F.col("_bin").alias("bin")).agg(F.sum("n").alias("n")), 2)
    base = base.select(F.lit(None).cast("long").alias("_t"), F.lit(0).alias("_side"), F.col("before").alias("n"), F.lit(0).alias("_sign"), *none, F.col("bin").alias("_bin"))
    running = Window.partitionBy("_bin").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.unionByName(base).withColumn("_sum", F.sum("n").over(running)).where("_sign <> 0")
    return summed.groupBy(*by).agg(F.sum(F.col("_sign") * F.col("_sum")).alias("n")).where("n > 0")
