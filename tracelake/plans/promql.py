"""A bounded PromQL: selectors, rate, aggregations and histogram quantiles over rates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classic_histogram_quantile
from .common import Cursor, Diagnostic, EvalRange, labels_of, matcher, read_matchers, required, sorted_map, subset


@dataclass(frozen=True)
class Selector:
    metric: str
    matchers: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Rate:
    selector: Selector
    window: int


@dataclass(frozen=True)
class Aggregate:
    op: str
    inner: Selector | Rate | Aggregate
    keys: tuple[str, ...] = ()
    without: bool = False


@dataclass(frozen=True)
class Quantile:
    phi: float
    keys: tuple[str, ...]
    rate: Rate


_AGGREGATES = ("sum", "avg", "min", "max", "count")


def _selector(c: Cursor) -> Selector:
    name = c.name() or c.fail("expected a metric name")
    return Selector(name, tuple(read_matchers(c)) if c.peek("{") else ())


def _rate(c: Cursor) -> Rate:
    c.expect("(")
    selector = _selector(c)
    c.expect("[")
    window = c.duration()
    c.expect("]")
    c.expect(")")
    return Rate(selector, window)


def _grouping(c: Cursor) -> tuple[tuple[str, ...], bool] | None:
    word = c.keyword("by", "without")
    if not word:
        return None
    c.expect("(")
    keys = []
    while not c.take(")"):
        keys.append(c.name() or c.fail("expected a label"))
        if not c.peek(")"):
            c.expect(",")
    return tuple(keys), word == "without"


def _expression(c: Cursor):
    c.nest()
    try:
        if c.take("("):
            inner = _expression(c)
            c.expect(")")
            return inner
        back = c.at
        if op := c.keyword(*_AGGREGATES):
            if c.peek("(") or c.peek("by") or c.peek("without"):
                before = _grouping(c)
                c.expect("(")
                inner = _expression(c)
                c.expect(")")
                after = _grouping(c)
                if before and after:
                    c.fail("grouping stands both before and after")
                keys, without = before or after or ((), False)
                return Aggregate(op, inner, keys, without)
            c.at = back
        if c.keyword("rate"):
            return _rate(c)
        if c.keyword("histogram_quantile"):
            c.expect("(")
            phi = c.number()
            c.expect(",")
            inner = _expression(c)
            c.expect(")")
            if not (isinstance(inner, Aggregate) and inner.op == "sum" and isinstance(inner.inner, Rate) and not inner.without and "le" in inner.keys and inner.inner.selector.metric.endswith("_bucket")):
                c.fail("histogram_quantile takes sum by (le, ...) (rate(<metric>_bucket[...]))", "Unsupported")
            return Quantile(phi, tuple(k for k in inner.keys if k != "le"), inner.inner)
        return _selector(c)
    finally:
        c.depth -= 1


def parse(text: str):
    c = Cursor(text)
    out = _expression(c)
    c.end()
    return out


def _filtered(df: DataFrame, s: Selector, name: str, span: EvalRange, horizon: int) -> DataFrame:
    """The points of a selector that any instant can see, with their label map; time bounds stay on the bare column."""
    rows = df.where((F.col("metric") == name) & (F.col("time_ns") >= F.lit(span.start - horizon).cast("long")) & (F.col("time_ns") <= F.lit(span.end).cast("long")))
    rows = rows.withColumn("labels", labels_of(rows, True))
    for label, op, value in s.matchers:
        rows = rows.where(matcher(F.col("labels")[label], op, value))
    return rows


def _no_duplicates(points: DataFrame, policy: str) -> DataFrame:
    if policy == "last_wins":
        order = Window.partitionBy("series", "time_ns").orderBy(F.isnan("value").asc(), F.col("value").desc())
        return points.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    if policy == "error":
        others = [F.first(c).alias(c) for c in points.columns if c not in ("series", "time_ns")]
        once = points.groupBy("series", "time_ns").agg(*others, F.count("*").alias("_n"))
        return once.withColumn("time_ns", required(F.col("_n") == 1, "Duplicate", "duplicate samples of a series at one time", F.col("time_ns"))).drop("_n")
    return points


def extrapolated(points: DataFrame, keys: list[str], span: EvalRange, window: int) -> DataFrame:
    """Per key and instant, the per-second rate of a counter, with resets and extrapolation; value may be null.

    points: keys, time_ns, value.  One lag per series; the rest are aggregates that combine map-side, by pane and then
    by instant.  A fall of the counter counts where the sample before is in the window too: always, but for a pane's
    first sample, which is kept apart.
    """
    series = Window.partitionBy(*keys).orderBy("time_ns")
    rows = points.select(*keys, "time_ns", "value", F.lag("value").over(series).alias("pv"), F.lag("time_ns").over(series).alias("pt"))
    rows = rows.withColumn("pane", span.pane_of(F.col("time_ns"), window))
    fell = F.when(F.col("value") < F.col("pv"), F.col("pv")).otherwise(0.0)
    inner = F.col("pt") > F.col("pane") - F.lit(gcd(span.step, window)).cast("long")
    first, last = F.min(F.struct("time_ns", "value")), F.max(F.struct("time_ns", "value"))
    panes = rows.groupBy(*keys, "pane").agg(
        F.count("*").alias("n"), first.alias("a"), last.alias("z"), F.sum(F.when(inner, fell).otherwise(0.0)).alias("resets"),
        F.min_by(F.struct(F.col("pt").alias("t"), fell.alias("v")), "time_ns").alias("before"),
    )
    at = panes.withColumn("at", F.explode(span.instants_of(F.col("pane"), window)))
    crossed = F.when((F.col("before.t") > F.col("at") - F.lit(window).cast("long")) & (F.col("before.t") <= F.col("pane") - F.lit(gcd(span.step, window)).cast("long")), F.col("before.v")).otherwise(0.0)
    per = at.groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"), F.sum(F.col("resets") + crossed).alias("resets"))
    per = per.select(*keys, "at", "n", F.col("a.time_ns").alias("t0"), F.col("z.time_ns").alias("t1"), F.col("a.value").alias("v0"), F.col("z.value").alias("v1"), "resets")
    second = 1e9
    increase = F.col("v1") - F.col("v0") + F.col("resets")
    sampled = (F.col("t1") - F.col("t0")) / second
    average = sampled / (F.col("n") - 1)
    to_start = (F.col("t0") - (F.col("at") - F.lit(window).cast("long"))) / second
    to_end = (F.col("at") - F.col("t1")) / second
    to_start = F.when((increase > 0) & (F.col("v0") >= 0), F.least(to_start, sampled * F.col("v0") / increase)).otherwise(to_start)
    threshold = average * 1.1
    to_start = F.when(to_start >= threshold, average / 2).otherwise(to_start)
    to_end = F.when(to_end >= threshold, average / 2).otherwise(to_end)
    value = increase * ((sampled + to_start + to_end) / sampled / (window / second))
    return per.where("n >= 2 and t1 > t0").select(*keys, "at", value.alias("value"))


def _aggregate(vector: DataFrame, a: Aggregate) -> DataFrame:
    v = F.col("value")
    number = ~F.isnan(v)
    fold: Column = {
        "sum": F.sum(v), "avg": F.avg(v), "count": F.count("*").cast("double"),
        "min": F.coalesce(F.min(F.when(number, v)), F.lit(math.inf)), "max": F.coalesce(F.max(F.when(number, v)), F.lit(-math.inf)),
    }[a.op]
    return vector.groupBy(subset(F.col("labels"), list(a.keys), a.without).alias("labels"), "at").agg(fold.alias("value"))


class Compiler:
    """Plans over tables by name: metrics_gauge, metrics_sum, metrics_histogram."""

    def __init__(self, tables: dict[str, DataFrame], span: EvalRange, duplicates: str):
        self.tables, self.span, self.duplicates = tables, span, duplicates

    def vector(self, e) -> DataFrame:
        if isinstance(e, Selector):
            return self.selector(e)
        if isinstance(e, Rate):
            return self.rate(e)
        if isinstance(e, Aggregate):
            return _aggregate(self.vector(e.inner), e)
        return self.quantile(e)

    def _named(self, names: tuple[str, ...], s: Selector, metric: str, horizon: int) -> DataFrame:
        parts = [_filtered(self.tables[n], s, metric, self.span, horizon) for n in names if n in self.tables]
        if not parts:
            raise Diagnostic("NeedsResolution", f"no table for {metric}", 0)
        columns = [c for c in ("labels", "time_ns", "value", "temporality", "is_monotonic") if c in parts[0].columns]
        out = parts[0].select(*columns)
        for p in parts[1:]:
            out = out.unionByName(p.select(*columns))
        return out

    def selector(self, s: Selector) -> DataFrame:
        look = self.span.lookback
        rows = self._named(("metrics_gauge", "metrics_sum"), s, s.metric, look).withColumn("series", F.to_json("labels"))
        rows = _no_duplicates(rows, self.duplicates)
        latest = F.max_by(F.struct("time_ns", "value"), "time_ns").alias("x")
        panes = rows.groupBy("series", self.span.pane_of(F.col("time_ns"), look).alias("pane")).agg(latest)
        at = panes.withColumn("at", F.explode(self.span.instants_of(F.col("pane"), look)))
        out = at.groupBy("series", "at").agg(F.max_by("x.value", "x.time_ns").alias("value"))
        return out.select(F.from_json("series", "map<string,string>").alias("labels"), "at", "value")

    def rate(self, r: Rate) -> DataFrame:
        rows = self._named(("metrics_sum",), r.selector, r.selector.metric, r.window)
        fits = (F.upper("temporality") == "CUMULATIVE") & F.col("is_monotonic")
        rows = rows.withColumn("time_ns", required(fits, "SemanticMismatch", "rate requires a cumulative monotonic sum", F.col("time_ns")))
        rows = _no_duplicates(rows.select(sorted_map(subset(F.col("labels"), [], True)).alias("labels"), "time_ns", "value").withColumn("series", F.to_json("labels")), self.duplicates)
        rated = extrapolated(rows, ["series"], self.span, r.window)
        return rated.select(F.from_json("series", "map<string,string>").alias("labels"), "at", "value")

    def quantile(self, q: Quantile) -> DataFrame:
        s = q.rate.selector
        rows = _filtered(self.tables["metrics_histogram"], s, s.metric.removesuffix("_bucket"), self.span, q.rate.window)
        fits = (F.upper("temporality") == "CUMULATIVE") & (F.size("bucket_counts") == F.size("explicit_bounds") + 1)
        rows = rows.withColumn("time_ns", required(fits, "SemanticMismatch", "histogram_quantile requires cumulative histograms with one more count than bounds", F.col("time_ns")))
        rows = rows.select(F.to_json(sorted_map(subset(F.col("labels"), [], True))).alias("series"), "time_ns", "explicit_bounds", "bucket_counts")
        running = F.transform("bucket_counts", lambda _, i: F.aggregate(F.slice("bucket_counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b).cast("double"))
        rows = rows.withColumn("running", running).select("series", "time_ns", F.concat("explicit_bounds", F.array(F.lit(math.inf))).alias("les"), F.posexplode("running").alias("i", "value"))
        rows = rows.select("series", "time_ns", F.element_at("les", F.col("i") + 1).alias("le"), "value")
        rated = extrapolated(rows, ["series", "le"], self.span, q.rate.window)
        labels = subset(F.from_json("series", "map<string,string>"), list(q.keys))
        summed = rated.groupBy(labels.alias("labels"), "at", "le").agg(F.sum("value").alias("n"))
        return summed.groupBy("labels", "at").agg(classic_histogram_quantile(F.lit(q.phi), F.collect_list(F.struct("le", "n"))).alias("value"))


def promql(text: str, tables: dict[str, DataFrame], span: EvalRange, duplicates: str = "error") -> DataFrame:
    """(labels map, at, value) of a query; duplicates: error, last_wins or keep."""
    return Compiler(tables, span, duplicates).vector(parse(text)).select(sorted_map(F.col("labels")).alias("labels"), "at", "value")
