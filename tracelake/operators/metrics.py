"""Metric queries: ranges, rates, instants, histogram quantiles and discovery."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exp_histogram_quantile, histogram_quantile
from ..functions.jsonattr import string_map
from .filters import Filtered, bucket

MINUTE = 60_000_000_000


def last_wins(points: DataFrame) -> DataFrame:
    """One point of each (time, series): numbers before NaN, then the greatest."""
    identity = Window.partitionBy("time_ns", "metric", "service", "resource", "scope", "attributes").orderBy(F.isnan("value").asc(), F.col("value").desc())
    return points.withColumn("_place", F.row_number().over(identity)).where("_place = 1").drop("_place")


@dataclass(frozen=True)
class MetricQuery(Filtered):
    """Gauge or sum points of one metric, aggregated per step and group."""

    kind: str = "gauge"
    step: int = MINUTE
    by: tuple[str, ...] = ()
    aggregation: str | None = None

    def metric(self, name: str):
        return self.where(F.col("metric") == name)

    def group_by(self, *keys: str):
        return replace(self, by=keys)

    def every(self, step: int):
        return replace(self, step=max(1, step))

    def using(self, aggregation: str):
        """sum, avg, min, max, count, rate (of deltas) or rate_counter (of a cumulative counter, resets not handled)."""
        return replace(self, aggregation=aggregation)

    def deduplicated(self):
        return replace(self, df=last_wins(self.rows()), predicates=())

    def _value(self) -> Column:
        v, seconds = F.col("value"), self.step / 1e9
        name = self.aggregation or ("sum" if self.kind == "sum" else "avg")
        return {"sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v), "rate": F.sum(v) / seconds, "rate_counter": (F.max(v) - F.min(v)) / seconds}[name].cast("double")

    def query_range(self) -> DataFrame:
        labels = [self.attr(k).alias(k) for k in self.by]
        grouped = self.rows().groupBy(bucket(F.col("time_ns"), self.step).alias("bucket"), *labels).agg(self._value().alias("value"))
        return grouped.select("bucket", *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in self.by], "value")

    def instant(self) -> DataFrame:
        """The last bucket's sample of each series."""
        keys = [F.col(f"`{k}`") for k in self.by]
        return self.query_range().groupBy(*keys).agg(F.max("bucket").alias("bucket"), F.max_by("value", "bucket").alias("value"))

    def points(self, limit: int | None = None) -> DataFrame:
        out = self.rows().orderBy("time_ns", "service", "attributes", "value")
        return out if limit is None else out.limit(limit)


def _sum_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


@dataclass(frozen=True)
class HistogramQuery(MetricQuery):
    """Quantiles of explicit-bucket histograms."""

    def quantile_per_point(self, phi: float) -> DataFrame:
        labels = [F.coalesce(self.attr(k), F.lit("")).alias(k) for k in self.by]
        return self.rows().select("time_ns", *labels, histogram_quantile(F.lit(phi), F.col("explicit_bounds"), F.col("bucket_counts")).alias("value"))

    def quantile(self, phi: float) -> DataFrame:
        """Of the counts added up per step and group.  Points whose bounds differ from the group's earliest (then
        smallest) ones are left out; counts are added by place, so a group's size does not matter."""
        labels = [F.coalesce(self.attr(k), F.lit("")).alias(k) for k in self.by]
        rows = self.rows().select(bucket(F.col("time_ns"), self.step).alias("bucket"), *labels, "time_ns", "explicit_bounds", "bucket_counts")
        keys = ["bucket", *[f"`{k}`" for k in self.by]]
        per = rows.groupBy(*keys, "explicit_bounds", F.size("bucket_counts").alias("n")).agg(F.min("time_ns").alias("first"), F.count("*").alias("points"))
        chosen = per.groupBy(*keys).agg(F.min(F.struct("first", "explicit_bounds", "n")).alias("c")).select(*[F.col(f"`{k}`").alias(f"c_{k}") for k in self.by], F.col("bucket").alias("c_bucket"), F.col("c.explicit_bounds").alias("bounds"))
        same = F.col("bucket") == F.col("c_bucket")
        for k in self.by:
            same &= F.col(f"`{k}`") == F.col(f"`c_{k}`")
        kept = rows.join(chosen, same & (F.col("explicit_bounds") == F.col("bounds")))
        cells = kept.select(*keys, "bounds", F.posexplode("bucket_counts").alias("i", "n")).groupBy(*keys, "bounds", "i").agg(F.sum("n").alias("n"))
        merged = cells.groupBy(*keys, "bounds").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("counts"))
        return merged.select(*keys, histogram_quantile(F.lit(phi), F.col("bounds"), F.col("counts")).alias("value"))


@dataclass(frozen=True)
class ExpHistogramQuery(MetricQuery):
    """Quantiles of base-2 exponential histograms."""

    def quantile_per_point(self, phi: float) -> DataFrame:
        labels = [F.coalesce(self.attr(k), F.lit("")).alias(k) for k in self.by]
        names = ("scale", "zero_count", "positive_offset", "positive_counts", "negative_offset", "negative_counts")
        return self.rows().select("time_ns", *labels, exp_histogram_quantile(F.lit(phi), *map(F.col, names)).alias("value"))

    def quantile(self, phi: float, widest: int = 1 << 20) -> DataFrame:
        """Of points brought to the coarsest scale of their step and group and added; NaN beyond `widest` buckets."""
        labels = [F.coalesce(self.attr(k), F.lit("")).alias(k) for k in self.by]
        rows = self.rows().select(bucket(F.col("time_ns"), self.step).alias("bucket"), *labels, "scale", "zero_count", "positive_offset", "positive_counts", "negative_offset", "negative_counts")
        keys = ["bucket", *[f"`{k}`" for k in self.by]]
        window = Window.partitionBy(*keys)
        scaled = rows.withColumn("coarsest", F.min("scale").over(window)).withColumn("shift", F.least(F.col("scale") - F.col("coarsest"), F.lit(31)))
        sides = F.array(
            F.struct(F.lit(1).alias("sign"), F.col("positive_offset").alias("offset"), F.col("positive_counts").alias("counts")),
            F.struct(F.lit(-1).alias("sign"), F.col("negative_offset").alias("offset"), F.col("negative_counts").alias("counts")),
        )
        side = scaled.select(*keys, "coarsest", "shift", "zero_count", F.explode(sides).alias("s"))
        cells = side.select(*keys, "coarsest", "shift", F.col("s.sign").alias("sign"), F.col("s.offset").alias("offset"), F.posexplode("s.counts").alias("i", "n"))
        index = F.expr("shiftright(offset + i, shift)")
        cells = cells.select(*keys, "coarsest", "sign", index.alias("index"), "n").groupBy(*keys, "coarsest", "sign", "index").agg(F.sum("n").alias("n")).where("n > 0")
        dense = cells.groupBy(*keys, "coarsest", "sign").agg(F.min("index").alias("low"), F.max("index").alias("high"), F.map_from_entries(F.collect_list(F.struct("index", "n"))).alias("m"))
        dense = dense.withColumn("counts", F.when(F.col("high") - F.col("low") < widest, F.transform(F.sequence("low", "high"), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))))
        zeros = scaled.groupBy(*keys).agg(F.sum("zero_count").alias("zeros"), F.min("scale").alias("coarsest"))
        one = lambda sign, value: F.max(F.when(F.col("sign") == sign, F.col(value)))
        both = dense.groupBy(*keys).agg(one(1, "low").alias("p_low"), one(1, "counts").alias("p"), one(-1, "low").alias("n_low"), one(-1, "counts").alias("n"), F.max(F.col("counts").isNull()).alias("wide"))
        joined = zeros.join(both, [k.strip("`") for k in keys], "left")
        none = F.array().cast("array<bigint>")
        value = exp_histogram_quantile(F.lit(phi), F.col("coarsest"), F.col("zeros"), F.coalesce("p_low", F.lit(0)), F.coalesce("p", none), F.coalesce("n_low", F.lit(0)), F.coalesce("n", none))
        return joined.select(*keys, F.when(F.coalesce("wide", F.lit(False)), F.lit(float("nan"))).otherwise(value).alias("value"))


def _union(tables: dict[str, DataFrame], *columns: Column) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.withColumn("_kind", F.lit(name)).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def metric_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct (kind, metric, unit, temporality); tables by kind."""
    return _union(tables, F.col("_kind").alias("kind"), F.col("metric"), F.col("unit"), F.col("temporality")).distinct()


def metric_series(tables: dict[str, DataFrame], metric: str) -> DataFrame:
    return _union({k: df.where(F.col("metric") == metric) for k, df in tables.items()}, F.col("attributes")).distinct()


def metric_dimensions(tables: dict[str, DataFrame], metric: str) -> DataFrame:
    """(label, value): distinct values of each string attribute and of service."""
    rows = _union({k: df.where(F.col("metric") == metric) for k, df in tables.items()}, F.col("service"), F.col("attributes")).distinct()
    own = F.map_filter(F.create_map(F.lit("service"), F.col("service")), lambda k, v: v.isNotNull())
    return rows.select(F.explode(F.concat(F.map_entries(own), F.map_entries(F.coalesce(string_map(F.col("attributes")), F.create_map().cast("map<string,string>"))))).alias("e")).select(F.col("e.key").alias("label"), F.col("e.value").alias("value")).distinct()


def metric_exemplars(tables: dict[str, DataFrame], metric: str) -> DataFrame:
    """One row per exemplar of the metric's points."""
    kind = "array<struct<time_unix_nano:bigint,value:double,trace_id:string,span_id:string>>"
    rows = _union({k: df.where((F.col("metric") == metric) & (F.col("exemplars") != "[]")) for k, df in tables.items()}, F.col("_kind").alias("kind"), F.col("service"), F.col("attributes"), F.col("exemplars"))
    return rows.select("kind", "service", "attributes", F.explode(F.from_json("exemplars", kind)).alias("x")).select("kind", "service", "attributes", "x.*")
