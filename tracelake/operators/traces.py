"""Trace queries: lookup, search, summaries, RED metrics and the waterfall."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matches
from ..sources.shared import materialized, spread
from .filters import Filtered, bucket, time_range
from .whole_traces import ancestor_pairs


#: A page of at most so many traces is broadcast.
MOST_PAGE = 100_000


def get_traces(spans: DataFrame, ids: list[str]) -> DataFrame:
    """All spans of the traces with these hexadecimal ids, in start order."""
    return spans.where(F.col("trace_id").isin([bytes.fromhex(i) for i in ids])).orderBy("trace_id", "start_time_ns", "span_id")


def summaries(spans: DataFrame) -> DataFrame:
    """One row per trace: start, duration, root (first parentless span, else the earliest), spans, errors."""
    order = F.struct(F.col("parent_span_id").isNotNull(), "start_time_ns", "span_id")
    root = F.min_by(F.struct("name", "service"), order)
    return (
        spans.groupBy("trace_id")
        .agg(
            F.min("start_time_ns").alias("start_time_ns"),
            F.max(F.col("start_time_ns") + F.col("duration_ns")).alias("_end"),
            F.max("start_time_ns").alias("latest_ns"),
            root.alias("_root"),
            F.count("*").alias("span_count"),
            F.coalesce(F.max(F.col("status_code") == "ERROR"), F.lit(False)).alias("has_error"),
        )
        .select("trace_id", "start_time_ns", (F.col("_end") - F.col("start_time_ns")).alias("duration_ns"), F.col("_root.name").alias("root_name"), F.col("_root.service").alias("root_service"), "span_count", "has_error", "latest_ns")
    )


@dataclass(frozen=True)
class SpanFilter(Filtered):
    def name(self, value: str):
        return self.where(F.col("name") == value)

    def name_matches(self, query: str):
        return self.where(matches(F.col("name"), query))

    def status(self, code: str):
        return self.where(F.col("status_code") == code)

    def kind(self, value: str):
        return self.where(F.col("kind") == value)

    def min_duration(self, ns: int):
        return self.where(F.col("duration_ns") >= F.lit(ns).cast("long"))

    def max_duration(self, ns: int):
        return self.where(F.col("duration_ns") <= F.lit(ns).cast("long"))


@dataclass(frozen=True)
class TraceQuery(SpanFilter):
    """Traces with a span that meets all predicates, newest first, 20 unless told otherwise."""

    limit: int | None = 20
    trace_start: tuple[int | None, int | None, bool] | None = None

    def started(self, start: int | None, end: int | None, inclusive: bool = False):
        """Of the trace's first span of all, not of the span that matches."""
        return replace(self, trace_start=(start, end, inclusive))

    def page(self, limit: int | None):
        return replace(self, limit=limit)

    def search(self) -> DataFrame:
        spans = self.df
        if self.predicates:
            spans = spans.join(self.rows().select("trace_id").distinct(), "trace_id", "left_semi")
        if self.trace_start:
            start, end, inclusive = self.trace_start
            # traces that start in the range have a span in it: fewer rows to aggregate, checked exactly below
            inside = self.df
            for p in time_range(F.col("start_time_ns"), start, end, inclusive):
                inside = inside.where(p)
            spans = spans.join(inside.select("trace_id").distinct(), "trace_id", "left_semi")
        if self.limit is not None:
            # rank by the latest start alone; only the traces of the page are summed up
            ranked = spans.groupBy("trace_id").agg(F.min("start_time_ns").alias("start_time_ns"), F.max("start_time_ns").alias("latest_ns"))
            if self.trace_start:
                for p in time_range(F.col("start_time_ns"), start, end, inclusive):
                    ranked = ranked.where(p)
            page = ranked.orderBy(F.col("latest_ns").desc(), "trace_id").limit(self.limit).select("trace_id")
            page = F.broadcast(page) if self.limit <= MOST_PAGE else page
            return summaries(self.df.join(page, "trace_id", "left_semi")).orderBy(F.col("latest_ns").desc(), "trace_id")
        out = summaries(spans)
        if self.trace_start:
            for p in time_range(F.col("start_time_ns"), start, end, inclusive):
                out = out.where(p)
        return out.orderBy(F.col("latest_ns").desc(), "trace_id")


@dataclass(frozen=True)
class SpanMetricsQuery(SpanFilter):
    """Calls, errors and duration quantiles per step and group; quantiles interpolate over all durations.

    approximate() gives ranks within 1 part in 10,000 without interpolation, of bounded state, for groups of very many spans.
    """

    step: int = 60_000_000_000
    by: tuple[str, ...] = ()
    exact: bool = True

    def group_by(self, *keys: str):
        return replace(self, by=keys)

    def every(self, step: int):
        return replace(self, step=max(1, step))

    def approximate(self):
        return replace(self, exact=False)

    def _key(self, key: str) -> Column:
        return F.col(key) if key in ("name", "kind", "status_code") else self.attr(key)

    def red(self) -> DataFrame:
        labels = [self._key(k).alias(k) for k in self.by]
        quantiles = [0.5, 0.95, 0.99]
        duration = F.col("duration_ns").cast("double")
        cut = F.percentile(duration, quantiles) if self.exact else F.percentile_approx(duration, quantiles, 10_000)
        grouped = self.rows().groupBy(bucket(F.col("start_time_ns"), self.step).alias("bucket"), *labels).agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") == "ERROR").alias("errors"), cut.alias("_q"))
        rate = F.when(F.col("calls") > 0, F.col("errors") / F.col("calls")).otherwise(0.0)
        return grouped.select("bucket", *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in self.by], "calls", "errors", rate.alias("error_rate"), *[F.col("_q")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(quantiles)])


def ancestors(spans: DataFrame, most_depth: int = 10_000) -> DataFrame:
    """(trace_id, span_id, ancestor_id): the strict ancestors of every span, each once, found where a trace's spans are together.

    Raises on a cycle, or on more than most_depth levels.
    """
    rows = spans.where("trace_id is not null").select("trace_id", "span_id", "parent_span_id")
    found = materialized(spread(rows, "trace_id").sortWithinPartitions("trace_id").mapInArrow(ancestor_pairs(most_depth), "trace_id binary, span_id binary, ancestor_id binary"))
    if found.where("ancestor_id is null").limit(1).count():
        raise ValueError("malformed trace: span parents form a cycle or are too deep")
    return found


def waterfall(spans: DataFrame) -> DataFrame:
    """Rows of each trace in start order, with offset and width as shares of the trace's duration."""
    first = Window.partitionBy("trace_id", "span_id").orderBy("start_time_ns", "name")
    rows = spread(spans.select("trace_id", "span_id", "parent_span_id", "name", "service", "start_time_ns", "duration_ns"), "trace_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    trace = Window.partitionBy("trace_id")
    start = F.min("start_time_ns").over(trace)
    total = F.greatest(F.max(F.col("start_time_ns") + F.col("duration_ns")).over(trace) - start, F.lit(1)).cast("double")
    place = F.row_number().over(trace.orderBy("start_time_ns", "span_id")) - 1
    rows = rows.select("trace_id", "span_id", "parent_span_id", "name", "service", place.alias("row"), ((F.col("start_time_ns") - start) / total).alias("_o"), (F.col("duration_ns") / total).alias("_w"))
    share = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    parent = rows.select("trace_id", F.col("span_id").alias("p_id"), F.col("row").alias("parent_row"))
    joined = rows.join(parent.withColumnRenamed("trace_id", "p_trace"), (F.col("trace_id") == F.col("p_trace")) & (F.col("parent_span_id") == F.col("p_id")), "left")
    return joined.select("trace_id", "row", "span_id", "name", "service", share("_o").alias("offset"), share("_w").alias("width"), "parent_row", (F.col("parent_span_id").isNotNull() & F.col("parent_row").isNull()).alias("malformed"))
