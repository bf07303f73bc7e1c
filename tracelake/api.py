"""One object over a store with the engine's verbs: ingest, SQL, typed queries, languages, statistics, housekeeping."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import register
from .operators import ExpHistogramQuery, HistogramQuery, LogQuery, MetricQuery, SpanMetricsQuery, TraceQuery, attribute_names, attribute_values, get_traces, metric_catalog, metric_dimensions, metric_exemplars, metric_series, waterfall
from .operators.attrstats import key_statistics
from .plans import EvalRange, LimitExceeded, logql, promql, traceql
from .sources import schema as S
from .sources.otlp import normalize_all
from .sources.shared import materialized
from .sources.store import Store
from .streaming import follow, tail


@dataclass(frozen=True)
class Receipt:
    """What an ingest took and what the duplicate guard dropped."""

    accepted: int
    rejected: int


@dataclass
class Engine:
    """refresh: on_query reads the newest files each time, a number is seconds a listing may be old, manual waits for refresh()."""

    store: Store
    refresh: str | float = "on_query"
    duplicates: str = "error"
    _tables: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)
    _sql: SparkSession | None = None

    def table(self, name: str) -> DataFrame:
        now = time.monotonic()
        held = self._tables.get(name)
        if held and (self.refresh == "manual" or isinstance(self.refresh, int | float) and now - held[0] < self.refresh):
            return held[1]
        df = self.store.read(name)
        self._tables[name] = (now, df)
        return df

    def _listing(self, name: str) -> list[str]:
        """The files behind table(name), so that SQL sees what the other queries do."""
        return sorted(self.table(name).inputFiles())

    def refresh_tables(self) -> None:
        self._tables.clear()

    def _metrics(self) -> dict[str, DataFrame]:
        return {S.KINDS[t]: self.table(t) for t in S.METRIC_TABLES}

    def _every(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in S.TABLES}

    # ingest
    def ingest_otlp(self, documents: DataFrame, column: str = "value", reject_duplicates: bool = False) -> dict[str, Receipt]:
        """Normalise OTLP JSON documents and append them; with reject_duplicates, metric points that are in the table already, or twice here, are dropped."""
        out = {}
        for t, rows in normalize_all(documents, column).items():
            total = rows.count()
            if not total:
                continue
            if reject_duplicates and t in S.METRIC_TABLES:
                keys = ["metric", "service", "attributes", "time_ns"]
                span = rows.agg(F.min("time_ns").alias("a"), F.max("time_ns").alias("b")).first()
                there = self.store.read(t).where((F.col("time_ns") >= span.a) & (F.col("time_ns") <= span.b)).select(*[F.col(k).alias(f"_{k}") for k in keys])
                same = F.lit(True)
                for k in keys:
                    same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
                rows = materialized(rows.dropDuplicates(keys).join(there, same, "left_anti"))
            kept = rows.count() if reject_duplicates and t in S.METRIC_TABLES else total
            self.store.append(rows, t)
            out[t] = Receipt(kept, total - kept)
        self.refresh_tables()
        return out

    def stream_otlp(self, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Follow a folder of files with one OTLP JSON document per line into the store, exactly once: a batch that is
        tried again replaces what its first try left.  The checkpoint's path names the stream."""
        stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

        def append(batch: DataFrame, number: int) -> None:
            for t, rows in normalize_all(batch).items():
                if rows.limit(1).count():
                    self.store.append_once(rows, t, f"{stream}{number}")

        lines = self.store.spark.readStream.text(path)
        return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    # raw SQL
    def query_sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """SQL over the tables, in a session of its own, where hex gives lower case."""
        if self._sql is None:
            self._sql = self.store.spark.newSession()
            register(self._sql, shadow=True)
        at = Store(self._sql, self.store.path, self.store.compression)
        for t in S.TABLES:
            at.read(t, self._listing(t)).createOrReplaceTempView(t)
        return self._sql.sql(text, args=args)

    def json_rows(self, text: str, args: dict | list | None = None) -> DataFrame:
        """The result of a SQL text as one JSON object a row; null columns are kept."""
        rows = self.query_sql(text, args)
        return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def pinned(self) -> Engine:
        """A reader whose tables stay as they are now."""
        return Engine(self.store, "manual", self.duplicates, _tables={t: (0.0, df) for t, df in self._every().items()})

    # typed queries
    def logs(self) -> LogQuery:
        return LogQuery(self.table("logs"))

    def search_logs(self, query: LogQuery) -> DataFrame:
        return query.collect_rows()

    def count_logs(self, query: LogQuery) -> DataFrame:
        return query.count()

    def log_volume(self, query: LogQuery, step: int, *keys: str) -> DataFrame:
        return query.volume_by(step, *keys) if keys else query.volume(step)

    def tail_logs(self, after_observed_ns: int | None = None, limit: int | None = None) -> DataFrame:
        return tail(self.table("logs"), after_observed_ns, limit)

    def follow_logs(self, after_observed_ns: int | None = None, where=None) -> DataFrame:
        """New log rows as a stream."""
        return follow(self.store.spark, self.store.path, after_observed_ns, where)

    def traces(self) -> TraceQuery:
        return TraceQuery(self.table("spans"), time="start_time_ns")

    def search_traces(self, query: TraceQuery) -> DataFrame:
        return query.search()

    def get_trace(self, *hex_ids: str) -> DataFrame:
        return get_traces(self.table("spans"), list(hex_ids))

    def trace_waterfall(self, hex_id: str) -> DataFrame:
        return waterfall(get_traces(self.table("spans"), [hex_id]))

    def span_metrics(self) -> SpanMetricsQuery:
        return SpanMetricsQuery(self.table("spans"), time="start_time_ns")

    def metric(self, name: str, kind: str = "gauge") -> MetricQuery:
        return MetricQuery(self.table(f"metrics_{kind}"), kind=kind).metric(name)

    def histogram(self, name: str) -> HistogramQuery:
        return HistogramQuery(self.table("metrics_histogram")).metric(name)

    def exp_histogram(self, name: str) -> ExpHistogramQuery:
        return ExpHistogramQuery(self.table("metrics_exp_histogram")).metric(name)

    def list_metrics(self) -> DataFrame:
        return metric_catalog(self._metrics()).orderBy("kind", "metric", "unit", "temporality")

    def metric_series(self, name: str) -> DataFrame:
        return metric_series(self._metrics(), name)

    def metric_dimensions(self, name: str) -> DataFrame:
        return metric_dimensions(self._metrics(), name).groupBy("label").agg(F.sort_array(F.collect_set("value")).alias("values"))

    def exemplars(self, name: str) -> DataFrame:
        return metric_exemplars({k: df for k, df in self._metrics().items() if "exemplars" in df.columns}, name)

    def list_attribute_keys(self) -> DataFrame:
        return attribute_names(self._every()).orderBy("name")

    def list_attribute_values(self, key: str) -> DataFrame:
        return attribute_values(self._every(), key).orderBy("value")

    def attribute_stats(self, table: str = "logs", **options) -> DataFrame:
        """Statistics by key; a file is a segment."""
        df = self.table(table).withColumn("segment", F.input_file_name())
        df = df if table != "spans" else df.withColumn("time_ns", F.col("start_time_ns"))
        return key_statistics(df, **options)

    # languages
    def promql(self, *texts: str, span: EvalRange) -> DataFrame:
        """Several queries at once, told apart by query_index."""
        tables = {t: self.table(t) for t in ("metrics_gauge", "metrics_sum", "metrics_histogram")}
        out = None
        for i, text in enumerate(texts):
            one = promql(text, tables, span, self.duplicates).select(F.lit(i).alias("query_index"), "labels", "at", "value")
            out = one if out is None else out.unionByName(one)
        return out

    def promql_for(self, kind: str, metric: str, *by: str, window: str = "5m") -> str:
        """The usual query of a metric by its kind: a gauge's average, a counter's rate, a histogram's 95th percentile."""
        keys = ", ".join(by)
        if kind == "gauge":
            return f"avg by ({keys}) ({metric})" if by else metric
        if kind == "sum":
            return f"sum by ({keys}) (rate({metric}[{window}]))"
        return f"histogram_quantile(0.95, sum by ({', '.join(('le', *by))}) (rate({metric}_bucket[{window}])))"

    def logql(self, text: str, span: EvalRange | None = None, **options) -> DataFrame:
        return logql(text, self.table("logs"), span, **options)

    def traceql(self, text: str, span: EvalRange | None = None, limit: int | None = None, most_traces: int | None = None) -> DataFrame:
        """With most_traces, a range that holds more traces is halved toward its end until it does not."""
        spans = self.table("spans")
        while span and most_traces is not None:
            inside = spans.groupBy("trace_id").agg(F.min("start_time_ns").alias("s")).where((F.col("s") >= span.start) & (F.col("s") <= span.end)).limit(most_traces + 1).count()
            if inside <= most_traces:
                break
            if span.end - span.start < 2:
                raise LimitExceeded(f"more than {most_traces} traces at one instant")
            span = EvalRange(span.end - (span.end - span.start) // 2, span.end, max(span.step, (span.end - span.start) // 1000 + 1))
        return traceql(text, spans, span, limit)

    # state
    def db_stats(self) -> DataFrame:
        return self.store.stats()

    def list_promoted_attributes(self) -> list[str]:
        return self.store.promoted()

    def set_promoted_attributes(self, keys: list[str]) -> None:
        self.store.set_promoted(keys)
        self.refresh_tables()

    def run_housekeeping(self, oldest_ns: int | None = None, most_bytes: int | None = None, most_partitions: int | None = None) -> dict[str, int]:
        """Retention, then compaction; how many day partitions each touched."""
        out = {"dropped": self.store.retain(oldest_ns, most_bytes), "rewritten": self.store.compact(most_partitions)}
        self.refresh_tables()
        return out
