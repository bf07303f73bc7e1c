"""The registered queries of the telemetry engine, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import surface
from .operators import ExpHistogramQuery, HistogramQuery, LogQuery, MetricQuery, SpanMetricsQuery, TraceQuery, attribute_names, attribute_values, metric_catalog, metric_dimensions, metric_exemplars, metric_series, summaries, waterfall
from .functions import floor_div
from .operators.attrstats import key_statistics
from .operators.traces import ancestors
from .plans import EvalRange, logql, promql, traceql
from .sources import adapters
from .sources.adapters import duck, view
from .sources.otlp import normalize
from .streaming import dedup_points, reassemble, remap, session_volume, sliding_volume, tumbling_volume

HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
#: The first instant of the test events, in nanoseconds.
T0 = 1_704_067_200_000_000_000
WEEK = EvalRange(T0 + DAY, T0 + 8 * DAY, 6 * HOUR, DAY)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _with(name: str, text: str, view_name: str | None = None) -> str:
    return f"with {name} as ({duck(view_name or name)}) {text}"


_TRACE = "lpad(lower(to_hex(trace)), 32, '0')"
_SPAN = "lpad(lower(to_hex({})), 16, '0')"


def _logs(spark: SparkSession, d: str) -> LogQuery:
    return LogQuery(view(spark, d, "logs"))


@_query(_with("logs", "select time_ns, service, severity_number, body from logs where severity_number >= 17 order by time_ns desc, service, body limit 100"))
def logs_search(spark, d):
    return _logs(spark, d).severity_at_least(17).collect_rows().select("time_ns", "service", "severity_number", "body")


@_query(_with("logs", "select time_ns, service, body from logs where service = 'click' order by time_ns, service, body limit 50 offset 25"))
def logs_paging(spark, d):
    return _logs(spark, d).service("click").forward().page(50, 25).collect_rows().select("time_ns", "service", "body")


@_query(_with("logs", f"select count(*) as count from logs where time_ns >= {T0 + DAY} and time_ns < {T0 + 9 * DAY} and attributes::json ->> 'k' is not null and cast(attributes::json ->> 'k' as double) > 50"))
def logs_count_range_attr(spark, d):
    return _logs(spark, d).range(T0 + DAY, T0 + 9 * DAY).attr_compare("k", ">", 50).count()


@_query(_with("logs", f"select (time_ns // {HOUR}) * {HOUR} as bucket, count(*) as count from logs group by 1"))
def logs_volume(spark, d):
    return _logs(spark, d).volume(HOUR)


@_query(_with("logs", f"select (time_ns // {HOUR}) * {HOUR} as bucket, service, count(*) as count from logs group by 1, 2"))
def logs_volume_by(spark, d):
    return _logs(spark, d).volume_by(HOUR, "service")


@_query(_with("logs", "select time_ns, body from logs where list_contains(regexp_split_to_array(lower(body), '[^a-z0-9]+'), 'error') and list_contains(regexp_split_to_array(lower(body), '[^a-z0-9]+'), '42')"))
def logs_matches(spark, d):
    return _logs(spark, d).matches("42 ERROR").rows().select("time_ns", "body")


@_query(_with("logs", "select service, count(*) as n from logs where body like '%user 1%' and not regexp_matches(body, 'user 1[5-9]') and service <> 'view' group by 1"))
def logs_string_predicates(spark, d):
    q = _logs(spark, d).string_predicate("body", "contains", "user 1").string_predicate("body", "not_regex", "user 1[5-9]").string_predicate("service", "ne", "view")
    return q.rows().groupBy("service").agg(F.count("*").alias("n"))


@_query(_with("logs", "select service, count(*) as n from logs where service in ('click', 'error') and not (service in ('error')) group by 1"))
def logs_attr_sets(spark, d):
    return _logs(spark, d).attr_in("service.name", ["click", "error"]).attr_not_in("service", ["error"]).attr_not_in("absent", ["x"]).rows().groupBy("service").agg(F.count("*").alias("n"))


@_query("select doc_id, source from documents where list_contains(regexp_split_to_array(lower(text), '[^\\pL\\pM\\pN]+'), 'the') and lang = 'en'")
def logs_documents_matches(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    from .functions import matches

    return docs.where((F.col("lang") == "en") & matches(F.col("text"), "the")).select("doc_id", "source")


def _gauge(spark, d) -> MetricQuery:
    return MetricQuery(view(spark, d, "metrics_gauge")).metric("event_value")


@_query(_with("g", f"select (time_ns // {DAY}) * {DAY} as bucket, service, round(avg(value), 6) as value from g group by 1, 2", "metrics_gauge"))
def metrics_range_avg(spark, d):
    return _gauge(spark, d).every(DAY).group_by("service").query_range().withColumn("value", F.round("value", 6))


@_query(_with("g", f"select (time_ns // {DAY}) * {DAY} as bucket, attributes::json ->> 'shard' as shard, max(value) as value from g where attributes::json ->> 'shard' <> 's3' group by 1, 2", "metrics_gauge"))
def metrics_range_by_attribute(spark, d):
    return _gauge(spark, d).every(DAY).label("shard", "!=", "s3").group_by("shard").using("max").query_range()


@_query(_with("g", f"select (time_ns // {DAY}) * {DAY} as bucket, round(sum(value) / 86400, 6) as value from g group by 1", "metrics_gauge"))
def metrics_rate_delta(spark, d):
    return _gauge(spark, d).every(DAY).using("rate").query_range().withColumn("value", F.round("value", 6))


@_query(_with("c", f"select (time_ns // {DAY}) * {DAY} as bucket, service, round((max(value) - min(value)) / 86400, 9) as value from c group by 1, 2", "metrics_sum"))
def metrics_rate_counter(spark, d):
    q = MetricQuery(view(spark, d, "metrics_sum"), kind="sum").metric("events_total")
    return q.every(DAY).group_by("service").using("rate_counter").query_range().withColumn("value", F.round("value", 9))


@_query(_with("g", f"select service, max(bucket) as bucket, arg_max(value, bucket) as value from (select (time_ns // {DAY}) * {DAY} as bucket, service, count(value)::double as value from g group by 1, 2) x group by 1", "metrics_gauge"))
def metrics_instant(spark, d):
    return _gauge(spark, d).every(DAY).group_by("service").using("count").instant()


@_query(_with("g", "select count(*) as n, round(sum(value), 4) as total from g", "metrics_gauge"))
def metrics_last_wins(spark, d):
    q = _gauge(spark, d)
    q = MetricQuery(q.df.unionByName(q.df.withColumn("value", F.col("value") - 1)).unionByName(q.df.withColumn("value", F.lit(float("nan")))))
    return q.deduplicated().rows().agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _metric_tables(spark, d) -> dict[str, DataFrame]:
    return {"gauge": view(spark, d, "metrics_gauge"), "sum": view(spark, d, "metrics_sum")}


@_query("select * from (values ('gauge', 'event_value', '1', cast(null as varchar)), ('sum', 'events_total', '1', 'CUMULATIVE')) t(kind, metric, unit, temporality)")
def metrics_catalog(spark, d):
    return metric_catalog(_metric_tables(spark, d))


@_query(_with("g", "select distinct attributes from g", "metrics_gauge"))
def metrics_series(spark, d):
    return metric_series(_metric_tables(spark, d), "event_value")


@_query(_with("g", "select distinct 'service' as label, service as value from g union select distinct 'shard', attributes::json ->> 'shard' from g", "metrics_gauge"))
def metrics_dimensions(spark, d):
    return metric_dimensions(_metric_tables(spark, d), "event_value")


@_query("select 'gauge' as kind, event_type as service, epoch_us(ts) * 1000 as time_unix_nano, cast(event_id as double) as value from events where event_id % 50 = 0")
def metrics_exemplars(spark, d):
    return metric_exemplars(_metric_tables(spark, d), "event_value").select("kind", "service", "time_unix_nano", "value")


_QUANTILE = """, q as (select {keys}, list_value(sum(bucket_counts[1]), sum(bucket_counts[2]), sum(bucket_counts[3]), sum(bucket_counts[4]), sum(bucket_counts[5])) as c from h group by {keys}),
 r as (select {keys}, c, list_value(c[1], c[1]+c[2], c[1]+c[2]+c[3], c[1]+c[2]+c[3]+c[4], c[1]+c[2]+c[3]+c[4]+c[5]) as s from q),
 p as (select {keys}, c, s, {phi} * s[5] as rank, case when s[1] >= {phi} * s[5] then 1 when s[2] >= {phi} * s[5] then 2 when s[3] >= {phi} * s[5] then 3 when s[4] >= {phi} * s[5] then 4 else 5 end as i from r)
 select {keys}, round(case when i = 5 then 400.0 when c[i] = 0 then list_value(50.0, 100.0, 200.0, 400.0)[i] else list_value(0.0, 50.0, 100.0, 200.0)[i] + (list_value(50.0, 100.0, 200.0, 400.0)[i] - list_value(0.0, 50.0, 100.0, 200.0)[i]) * (rank - (s[i] - c[i])) / c[i] end, 6)::double as value from p"""


@_query(f"with h0 as ({duck('metrics_histogram')}), h as (select *, (time_ns // {DAY}) * {DAY} as bucket from h0)" + _QUANTILE.format(keys="bucket, service", phi="0.9"))
def histogram_quantile_merged(spark, d):
    return HistogramQuery(view(spark, d, "metrics_histogram")).every(DAY).group_by("service").quantile(0.9).withColumn("value", F.round("value", 6))


@_query(f"with h as ({duck('metrics_histogram')})" + _QUANTILE.format(keys="time_ns, service", phi="0.5"))
def histogram_quantile_points(spark, d):
    return HistogramQuery(view(spark, d, "metrics_histogram")).group_by("service").quantile_per_point(0.5).withColumn("value", F.round("value", 6))


@_query("""with b as (select (epoch_us(ts) // 86400000000) * 86400000000000 as bucket, cast(floor(log2(value)) as bigint) as i, count(*) as n from events where value >= 1 group by 1, 2),
 s as (select *, sum(n) over (partition by bucket order by i) as upto, sum(n) over (partition by bucket) as total from b), h as (select *, row_number() over (partition by bucket order by i) as k from s where upto >= 0.5 * total)
 select bucket, round(pow(2, i) + (pow(2, i + 1) - pow(2, i)) * (0.5 * total - (upto - n)) / n, 6) as value from h where k = 1""")
def exp_histogram_quantile_merged(spark, d):
    """Points of scale 0 for odd users and of scale 1, which is brought to 0 again, for the others."""
    adapters.tables(spark, d, "events")
    events = spark.table("events").where("value >= 1").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    events = events.withColumn("scale", F.when(F.col("user_id") % 2 == 1, 0).otherwise(1)).withColumn("i", F.when(F.col("scale") == 0, F.floor(F.log2("value"))).otherwise(2 * F.floor(F.log2("value"))).cast("int"))
    cells = events.groupBy("hour", "scale", "i").agg(F.count("*").alias("n")).groupBy("hour", "scale").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    none = F.array().cast("array<bigint>")
    points = cells.select(
        (F.unix_micros("hour") * 1000).alias("time_ns"), F.lit("x").alias("metric"), F.lit(None).cast("string").alias("service"), F.lit("{}").alias("attributes"), "scale", F.lit(0).cast("long").alias("zero_count"),
        F.col("low").alias("positive_offset"), F.transform(F.sequence("low", "high"), lambda k: F.coalesce(F.col("m")[k], F.lit(0))).alias("positive_counts"), F.lit(0).alias("negative_offset"), none.alias("negative_counts"),
    )
    return ExpHistogramQuery(points).every(DAY).quantile(0.5).withColumn("value", F.round("value", 6))


_SUMMARY = """, r as (select *, row_number() over (partition by trace order by parent is not null, start_time_ns, span) as k from s)
 select {t} as trace_id, min(start_time_ns) as start_time_ns, max(start_time_ns + duration_ns) - min(start_time_ns) as duration_ns, max(case when k = 1 then name end) as root_name, max(case when k = 1 then service end) as root_service,
 count(*) as span_count, bool_or(status_code = 'ERROR') as has_error, max(start_time_ns) as latest_ns from r {where} group by trace""".replace("{t}", _TRACE)


@_query(f"with s as ({duck('span_rows')})" + _SUMMARY.replace("{where}", ""))
def trace_summaries(spark, d):
    return summaries(view(spark, d, "spans")).withColumn("trace_id", F.lower(F.hex("trace_id")))


@_query(f"with s as ({duck('span_rows')})" + _SUMMARY.replace("{where}", "where trace in (select trace from s where name = 'order' and status_code = 'ERROR' and duration_ns >= 200000000)") + " order by latest_ns desc, trace_id limit 20")
def trace_search(spark, d):
    q = TraceQuery(view(spark, d, "spans")).name("order").status("ERROR").min_duration(200_000_000)
    return q.search().withColumn("trace_id", F.lower(F.hex("trace_id")))


_FROM = 800_000_000_000_000_000


@_query(f"with s as ({duck('span_rows')}), t as (select trace, min(start_time_ns) as first from s where parent is not null group by trace) select {_TRACE} as trace_id, first as start_time_ns from t where first >= {_FROM} and first < {_FROM * 2}")
def trace_started_in_range(spark, d):
    spans = view(spark, d, "spans").where("parent_span_id is not null")
    return TraceQuery(spans).started(_FROM, 2 * _FROM).page(None).search().select(F.lower(F.hex("trace_id")).alias("trace_id"), "start_time_ns")


@_query(
    f"""with s as ({duck('span_rows')}) select (start_time_ns // {30 * DAY}) * {30 * DAY} as bucket, name, count(*) as calls, count(*) filter (where status_code = 'ERROR') as errors, count(*) filter (where status_code = 'ERROR') / count(*)::double as error_rate,
 round(quantile_cont(duration_ns::double, 0.5), 3) as p50, round(quantile_cont(duration_ns::double, 0.95), 3) as p95, round(quantile_cont(duration_ns::double, 0.99), 3) as p99 from s group by 1, 2"""
)
def span_red_metrics(spark, d):
    out = SpanMetricsQuery(view(spark, d, "spans")).every(30 * DAY).group_by("name").red()
    return out.select("bucket", "name", "calls", "errors", "error_rate", *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")])


@_query(
    f"""with s as ({duck('span_rows')}), w as (select *, row_number() over (partition by trace order by start_time_ns, {_SPAN.format('span')}) - 1 as row, min(start_time_ns) over (partition by trace) as t0, greatest(max(start_time_ns + duration_ns) over (partition by trace) - min(start_time_ns) over (partition by trace), 1) as total from s)
 select {_TRACE.replace('trace', 'a.trace')} as trace_id, a.row as row, a.name as name, round(least(greatest((a.start_time_ns - a.t0) / a.total::double, 0), 1), 9) as offset, round(least(greatest(a.duration_ns / a.total::double, 0), 1), 9) as width, b.row as parent_row from w a left join w b on a.trace = b.trace and a.parent = b.span"""
)
def trace_waterfall(spark, d):
    return waterfall(view(spark, d, "spans")).select(F.lower(F.hex("trace_id")).alias("trace_id"), F.col("row").cast("long").alias("row"), "name", F.round("offset", 9).alias("offset"), F.round("width", 9).alias("width"), F.col("parent_row").cast("long").alias("parent_row"))


@_query(f"""with recursive s as ({duck('span_rows')}), a as (select trace, span, parent as anc from s where parent is not null union all select a.trace, a.span, s.parent from a join s on a.trace = s.trace and a.anc = s.span where s.parent is not null)
 select {_TRACE} as trace_id, count(*) as pairs from a group by trace""")
def trace_ancestors(spark, d):
    return ancestors(view(spark, d, "spans")).groupBy(F.lower(F.hex("trace_id")).alias("trace_id")).agg(F.count("*").alias("pairs"))


@_query("select * from (values ('k'), ('shard'), ('service.name')) t(name)")
def attribute_keys(spark, d):
    return attribute_names({"logs": view(spark, d, "logs"), **_metric_tables(spark, d)})


@_query("select distinct 's' || (user_id % 4) as value from events")
def attribute_key_values(spark, d):
    return attribute_values({"logs": view(spark, d, "logs"), **_metric_tables(spark, d)}, "shard")


_INSTANTS = f", t as (select unnest(range({WEEK.start}, {WEEK.end} + 1, {WEEK.step})) as at_ns)"


@_query(
    _with("g", "", "metrics_gauge").rstrip() + _INSTANTS + f""", l as (select at_ns, service, attributes::json ->> 'shard' as shard, arg_max(value, time_ns) as v from t join g on time_ns > at_ns - {DAY} and time_ns <= at_ns where service <> 'view' group by 1, 2, 3)
 select service, at_ns, round(sum(v), 6) as value from l group by 1, 2"""
)
def promql_sum_of_selector(spark, d):
    out = promql('sum by (service) (event_value{service!="view"})', {"metrics_gauge": view(spark, d, "metrics_gauge")}, WEEK)
    return out.select(F.col("labels")["service"].alias("service"), F.col("at").alias("at_ns"), F.round("value", 6).alias("value"))


@_query(
    _with("c", "", "metrics_sum").rstrip() + _INSTANTS + f""", x as (select *, lag(value) over w as pv, lag(time_ns) over w as pt from c window w as (partition by service, attributes order by time_ns)),
 a as (select at_ns, service, attributes, count(*) as n, min(time_ns) as t0, max(time_ns) as t1, arg_min(value, time_ns) as v0, arg_max(value, time_ns) as v1, sum(case when value < pv and pt > at_ns - {DAY} then pv else 0 end) as resets from t join x on time_ns > at_ns - {DAY} and time_ns <= at_ns group by 1, 2, 3),
 b as (select *, v1 - v0 + resets as inc, (t1 - t0) / 1e9 as sampled, (t0 - (at_ns - {DAY})) / 1e9 as s0, (at_ns - t1) / 1e9 as e0 from a where n >= 2),
 e as (select *, sampled / (n - 1) as av, case when inc > 0 and v0 >= 0 then least(s0, sampled * v0 / inc) else s0 end as s1 from b),
 f as (select *, case when s1 >= av * 1.1 then av / 2 else s1 end as s2, case when e0 >= av * 1.1 then av / 2 else e0 end as e2 from e)
 select service, at_ns, round(sum(inc * ((sampled + s2 + e2) / sampled / 86400.0)), 9) as value from f group by 1, 2"""
)
def promql_rate(spark, d):
    out = promql("sum by (service) (rate(events_total[1d]))", {"metrics_sum": view(spark, d, "metrics_sum")}, WEEK)
    return out.select(F.col("labels")["service"].alias("service"), F.col("at").alias("at_ns"), F.round("value", 9).alias("value"))


@_query(_with("logs", "").rstrip() + _INSTANTS + f" select service, at_ns, count(*)::double as value from t join logs on time_ns > at_ns - {DAY} and time_ns <= at_ns where body like '%user 1%' group by 1, 2")
def logql_count_over_time(spark, d):
    out = logql('sum by (service) (count_over_time({service=~".*"} |= "user 1" [1d]))', view(spark, d, "logs"), WEEK)
    return out.select(F.col("labels")["service"].alias("service"), F.col("at").alias("at_ns"), "value")


@_query(_with("logs", "").rstrip() + _INSTANTS + f" select at_ns, round(count(*) / 86400.0, 9)::double as value from t join logs on time_ns + {HOUR} > at_ns - {DAY} and time_ns + {HOUR} <= at_ns where service = 'error' group by 1")
def logql_rate_offset(spark, d):
    out = logql('rate({service="error"} !~ "nothing" [1d] offset 1h)', view(spark, d, "logs"), WEEK)
    return out.select(F.col("at").alias("at_ns"), F.round("value", 9).alias("value"))


def _spanset(select: str) -> str:
    return f"with s as ({duck('span_rows')}), m as ({select}) select {_TRACE} as trace_id, string_agg({_SPAN.format('span')}, ',' order by {_SPAN.format('span')}) as span_ids from m group by trace"


def _traceql(spark, d, text: str) -> DataFrame:
    return traceql(text, view(spark, d, "spans")).select("trace_id", F.concat_ws(",", "span_ids").alias("span_ids"))


@_query(_spanset("select distinct trace, span from s where name = 'order' and status_code = 'ERROR' and duration_ns > 250000000"))
def traceql_select(spark, d):
    return _traceql(spark, d, '{ name = "order" && status = "ERROR" && duration > 250ms }')


@_query(_spanset("select distinct c.trace, c.span from s c join s p on c.trace = p.trace and c.parent = p.span where p.name = 'order' and p.status_code = 'OK' and c.name = 'line' and c.attributes::json ->> 'number' = '3'"))
def traceql_child(spark, d):
    return _traceql(spark, d, '{ name = "order" && status = "OK" } > { name = "line" && span.number = 3 }')


@_query(_spanset("select distinct c.trace, c.span from s c join s p on c.trace = p.trace and c.parent = p.span join s g on p.trace = g.trace and p.parent = g.span where g.service = 'BUILDING' and c.duration_ns > 90000"))
def traceql_descendant(spark, d):
    return _traceql(spark, d, '{ resource.service.name = "BUILDING" } >> { duration > 90us && name = "line" }')


@_query(_spanset("select distinct b.trace, b.span from s a join s b on a.trace = b.trace and a.parent = b.parent and a.span <> b.span where a.name = 'line' and a.duration_ns >= 100000 and b.name = 'line'"))
def traceql_sibling(spark, d):
    return _traceql(spark, d, '{ name = "line" && duration >= 100us } ~ { name = "line" }')


@_query(_spanset("select distinct trace, span from s where name = 'order' and (trace) in (select trace from s where name = 'order' group by trace having count(*) >= 12)"))
def traceql_count(spark, d):
    return _traceql(spark, d, '{ name = "order" } | count() >= 12')


@_query(_spanset("select distinct trace, span from s where ((name = 'order' and status_code = 'UNSET') or service = 'MACHINERY') and trace in (select trace from s where name = 'order' and status_code = 'UNSET') and trace in (select trace from s where service = 'MACHINERY')"))
def traceql_and(spark, d):
    return _traceql(spark, d, '{ name = "order" && status = "UNSET" } && { .segment = "MACHINERY" }')


@_query(_spanset("select trace, span from s where name = 'order' and span not in (select parent from s where parent is not null)"))
def traceql_not_parent(spark, d):
    return _traceql(spark, d, '{ name = "line" } !< { name = "order" }')


_US = "epoch_us(ts)"


@_query(f"select make_timestamp(({_US} // 21600000000) * 21600000000) as start, event_type as service, count(*) as count from events group by 1, 2")
def stream_tumbling(spark, d):
    return tumbling_volume(view(spark, d, "logs"), "6 hours", "service").select(F.col("start").cast("timestamp_ntz").alias("start"), "service", "count")


@_query(f"""select make_timestamp(s) as start, count(*) as count from (select unnest(range(({_US} // 21600000000) * 21600000000 - 64800000000, ({_US} // 21600000000) * 21600000000 + 1, 21600000000)) as s, {_US} as us from events) x where us >= s and us < s + 86400000000 group by 1""")
def stream_sliding(spark, d):
    return sliding_volume(view(spark, d, "logs"), "24 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "count")


@_query(f"""with l as (select user_id, {_US} as us, event_id, case when {_US} - lag({_US}) over w < 86400000000 then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by us, event_id) as k from l)
 select cast(user_id as varchar) as service, make_timestamp(min(us)) as start, count(*) as count from s group by user_id, k""")
def stream_session(spark, d):
    adapters.tables(spark, d, "events")
    logs = spark.sql("select unix_micros(cast(ts as timestamp)) * 1000 as time_ns, cast(user_id as string) as service from events")
    return session_volume(logs, "24 hours", "service").select("service", F.col("start").cast("timestamp_ntz").alias("start"), "count")


@_query("select count(*) as n from (select distinct event_type, user_id % 4, ts from events) x")
def stream_dedup(spark, d):
    points = view(spark, d, "metrics_gauge")
    return dedup_points(points.unionByName(points)).agg(F.count("*").alias("n"))


@_query("select conv_id, string_agg(text, '' order by turn) as line from conversations group by conv_id")
def stream_reassemble(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    chunks = rows.select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("ordinal"), (F.col("conv_id") * 1000 + F.col("turn")).alias("time_ns"), F.lit("stdout").alias("source"), "text")
    return reassemble(chunks).select(floor_div(F.col("time_ns"), 1000).alias("conv_id"), "line")


@_query("select event_id * 1000000 as time_ns, event_type as service, 'user ' || user_id as body, 17 as severity_number, '{\"k\":' || cast(event_id % 7 as varchar) || '}' as attributes from events where event_type = 'error'")
def log_remap(spark, d):
    """Lines as JSON, read back as records."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'")
    line = F.concat(F.lit('{"level":"ERR","msg":"user '), F.col("user_id"), F.lit('","k":'), F.col("event_id") % 7, F.lit("}"))
    out = remap(e.select(line.alias("line"), (F.col("event_id") * 1_000_000).alias("observed_time_ns"), F.col("event_type").alias("service")))
    return out.select("time_ns", "service", "body", F.col("severity_number").cast("int").alias("severity_number"), "attributes")


@_query("select count(*) as n, count(distinct body) as bodies, min(body) as first, sum(k) as total from (select 'event ' || event_id as body, user_id as k from events) x")
def otlp_logs(spark, d):
    """One OTLP JSON document per event, normalised to rows."""
    e = spark.read.parquet(f"{d}/events.parquet")
    record = F.concat(F.lit('{"timeUnixNano":"'), F.col("event_id") + 1, F.lit('","severityNumber":9,"body":{"stringValue":"event '), F.col("event_id"), F.lit('"},"attributes":[{"key":"k","value":{"intValue":"'), F.col("user_id"), F.lit('"}}]}'))
    text = F.concat(F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeLogs":[{"logRecords":['), record, F.lit("]}]}]}"))
    from .functions import json_get_num

    rows = normalize(e.select(text.alias("value")), "logs").where("service = 'shop'")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("body").alias("bodies"), F.min("body").alias("first"), F.sum(json_get_num(F.col("attributes"), "k")).cast("long").alias("total"))


@_query("""with a as (select event_type as segment, cast(props::json ->> 'k' as varchar) as value, epoch_us(ts) as us, event_id from events), v as (select value, count(distinct segment) as held, count(*) as n from a group by 1),
 u as (select count(distinct segment)::double as segments, count(*)::double as rows, (select count(distinct d) from (select min(us) // 86400000000 as d from a group by segment) x)::double as days from a),
 t as (select sum(n)::bigint as rows_present, count(*) as distinct_values, sum(held)::bigint as postings, avg(held) as mean_held from v),
 d as (select count(*) as n from (select distinct value, day from a join (select segment, min(us) // 86400000000 as day from a group by 1) f using (segment)) x)
 select 'k' as key, rows_present, 0::bigint as rows_string, segments::bigint as segments_present, distinct_values, postings, round(mean_held / segments, 9) as sigma_mean, round(rows_present / postings, 6) as repetition, round(d.n / days, 6) as distinct_24h,
 case when 0 < 0.9 then 'no' end as promote, case when postings / segments / distinct_values <= 0.25 then 'all' when (postings / segments) / (d.n / days) <= 0.25 then '24h' end as index_scale from t, u, d""")
def attribute_statistics(spark, d):
    logs = view(spark, d, "logs").withColumn("segment", F.col("service"))
    out = key_statistics(logs)
    return out.select("key", "rows_present", "rows_string", "segments_present", "distinct_values", "postings", F.round("sigma_mean", 9).alias("sigma_mean"), F.round("repetition", 6).alias("repetition"), F.round("distinct_24h", 6).alias("distinct_24h"), "promote", "index_scale")


# operators beside those above, each by itself


@_query(_with("logs", f"select service, count(*) as n from logs where service = 'click' and time_ns >= {T0 + DAY} and time_ns <= {T0 + 5 * DAY} group by 1"))
def logs_attr_eq(spark, d):
    return _logs(spark, d).attr_eq("service.name", "click").range_inclusive(T0 + DAY, T0 + 5 * DAY).rows().groupBy("service").agg(F.count("*").alias("n"))


@_query(_with("g", "select attributes::json ->> 'shard' as shard, count(*) as n from g where regexp_matches(attributes::json ->> 'shard', '^s[12]$') group by 1", "metrics_gauge"))
def metrics_attr_regex(spark, d):
    q = LogQuery(view(spark, d, "metrics_gauge")).attr_exists("shard").attr_regex("shard", "^s[12]$")
    return q.rows().groupBy(q.attr("shard").alias("shard")).agg(F.count("*").alias("n"))


@_query(_with("g", "select count(*) as n from g where attributes::json ->> 'shard' = 's3'", "metrics_gauge"))
def metrics_attr_matches(spark, d):
    return LogQuery(view(spark, d, "metrics_gauge")).attr_matches("shard", "S3").count().withColumnRenamed("count", "n")


@_query("select 0::bigint as n")
def logs_match_none(spark, d):
    return _logs(spark, d).match_none().count().withColumnRenamed("count", "n")


@_query(_with("logs", f"select count(*) as n from logs where time_ns >= {T0 + 9 * DAY} and time_ns <= {T0 + 10 * DAY}"))
def logs_since(spark, d):
    return _logs(spark, d).since(DAY, T0 + 10 * DAY).count().withColumnRenamed("count", "n")


def _observed(spark, d) -> DataFrame:
    """Log rows that arrive five seconds after their time, with ids of a trace and a span."""
    ids = {"trace_id": "unhex(lpad(hex(cast(split(body, ' ')[2] as bigint)), 32, '0'))", "span_id": "unhex(lpad(hex(cast(split(body, ' ')[2] as bigint) * 1000000007), 16, '0'))"}
    return view(spark, d, "logs").withColumn("observed_time_ns", F.col("time_ns") + 5_000_000_000).withColumns({k: F.expr(x) for k, x in ids.items()})


@_query(_with("logs", f"select time_ns, service, body from logs where time_ns + 5000000000 > {T0 + 20 * DAY} order by time_ns, body limit 40"))
def logs_observed_after(spark, d):
    from .streaming import tail

    out = LogQuery(_observed(spark, d)).observed_after(T0 + 20 * DAY).rows()
    return tail(out, T0 + 20 * DAY, 40).select("time_ns", "service", "body")


@_query(_with("logs", "select time_ns, service from logs where split_part(body, ' ', 3) = '17'"))
def logs_by_trace_id(spark, d):
    return LogQuery(_observed(spark, d)).trace_id("11".rjust(32, "0")).span_id(f"{17 * 1000000007:016x}").rows().select("time_ns", "service")


@_query(f"with l as ({duck('logs')}), s as ({duck('span_rows')}) select s.service, l.service as event, count(*) as n from l join s on cast(split_part(l.body, ' ', 3) as bigint) * 1000000007 = s.span group by 1, 2")
def logs_join_spans(spark, d):
    """Log records with the spans that they name."""
    spans = view(spark, d, "spans").select("span_id", F.col("service").alias("span_service"))
    return _observed(spark, d).join(spans, "span_id").groupBy(F.col("span_service").alias("service"), F.col("service").alias("event")).agg(F.count("*").alias("n"))


@_query(f"with s as ({duck('span_rows')}) select name, count(*) as n from s where kind = 'CLIENT' and duration_ns <= 150000000 group by 1")
def spans_by_kind_and_duration(spark, d):
    return TraceQuery(view(spark, d, "spans")).kind("CLIENT").max_duration(150_000_000).rows().groupBy("name").agg(F.count("*").alias("n"))


@_query(f"with s as ({duck('span_rows')}) select {_TRACE} as trace_id, name, start_time_ns, duration_ns from s where trace in (7, 12)")
def traces_get(spark, d):
    from .operators import get_traces

    out = get_traces(view(spark, d, "spans"), ["7".rjust(32, "0"), "c".rjust(32, "0")])
    return out.select(F.lower(F.hex("trace_id")).alias("trace_id"), "name", "start_time_ns", "duration_ns")


def _promql_fold(op: str):
    sql = _with("g", "", "metrics_gauge").rstrip() + _INSTANTS + f""", l as (select at_ns, service, attributes::json ->> 'shard' as shard, arg_max(value, time_ns) as v from t join g on time_ns > at_ns - {DAY} and time_ns <= at_ns group by 1, 2, 3)
 select shard, at_ns, round({op}(v)::double, 6) as value from l group by 1, 2"""

    def run(spark, d):
        out = promql(f"{op} without (service) (event_value)", {"metrics_gauge": view(spark, d, "metrics_gauge")}, WEEK)
        return out.select(F.col("labels")["shard"].alias("shard"), F.col("at").alias("at_ns"), F.round("value", 6).alias("value"))

    run.__name__ = f"promql_{op}_without"
    return _query(sql)(run)


for _op in ("avg", "min", "max", "count"):
    _promql_fold(_op)


@_query(_with("logs", f"select time_ns, service, body from logs where service = 'error' and regexp_matches(body, 'user [12]$') and time_ns >= {WEEK.start} and time_ns <= {WEEK.end} order by time_ns desc, body limit 100"))
def logql_lines(spark, d):
    out = logql('{service="error"} |~ "user [12]$"', view(spark, d, "logs"), WEEK)
    return out.select("time_ns", F.col("labels")["service"].alias("service"), "body")


@_query(_spanset("select distinct trace, span from s where (name = 'order' and status_code = 'UNSET') or (name = 'line' and duration_ns > 95000)"))
def traceql_or(spark, d):
    return _traceql(spark, d, '{ name = "order" && status = "UNSET" } || { name = "line" && duration > 95us }')


@_query(_spanset("select distinct p.trace, p.span from s c join s p on c.trace = p.trace and c.parent = p.span where c.name = 'line' and c.duration_ns >= 98000 and p.name = 'order'"))
def traceql_parent(spark, d):
    return _traceql(spark, d, '{ name = "line" && duration >= 98us } < { name = "order" }')


@_query(_spanset("select distinct g.trace, g.span from s c join s p on c.trace = p.trace and c.parent = p.span join s g on p.trace = g.trace and p.parent = g.span where c.name = 'line' and c.duration_ns >= 98000 and g.name = 'customer'"))
def traceql_ancestor(spark, d):
    return _traceql(spark, d, '{ name = "line" && duration >= 98us } << { name = "customer" }')


@_query(_spanset("select trace, span from s where name = 'order' and status_code = 'UNSET' union select c.trace, c.span from s c join s p on c.trace = p.trace and c.parent = p.span where p.name = 'order' and p.status_code = 'UNSET' and c.name = 'line'"))
def traceql_union_child(spark, d):
    return _traceql(spark, d, '{ name = "order" && status = "UNSET" } &> { name = "line" }')


@_query(_spanset("select s.trace, s.span from s join (select trace, parent, count(*) as n from s where parent is not null group by 1, 2) c on s.trace = c.trace and s.span = c.parent where s.name = 'order' and c.n >= 7"))
def traceql_child_count(spark, d):
    return _traceql(spark, d, '{ name = "order" && childCount >= 7 }')


@_query(_spanset("select s.trace, s.span from s join (select trace, max(case when parent is null then service end) as root from s group by 1) r using (trace) where s.name = 'order' and s.status_code = 'UNSET' and r.root = 'MACHINERY'"))
def traceql_root(spark, d):
    return _traceql(spark, d, '{ name = "order" && status = "UNSET" && rootServiceName = "MACHINERY" && rootName = "customer" }')


@_query(_with("logs", "select time_ns, 'ts=' || strftime(make_timestamp(time_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') || lpad((time_ns % 1000)::varchar, 3, '0') || 'Z level=' || severity_text || ' msg=\"' || body || '\" k=' || (attributes::json ->> 'k') as line from logs"))
def logs_rendered(spark, d):
    from .streaming import render_logfmt

    return render_logfmt(view(spark, d, "logs"))


@_query(_with("logs", f"select service, count(*) as n, min(time_ns) as first, max(time_ns) as last from logs where time_ns >= {T0 + 3 * DAY} and time_ns < {T0 + 6 * DAY} group by 1"))
def store_scan(spark, d):
    """The log table, written by day into a store and read over three of its days, after a compaction."""
    from .api import Engine
    from .sources.shared import folder
    from .sources.store import Store

    store = Store(spark, f"{folder(spark)}/store-{d.rstrip('/').rpartition('/')[2]}-{uuid.uuid4().hex}")
    rows = view(spark, d, "logs")
    store.append(rows.where("severity_number < 17"), "logs")
    store.append(rows.where("severity_number >= 17"), "logs")
    store.compact(4)
    q = Engine(store).logs().range(T0 + 3 * DAY, T0 + 6 * DAY)
    return q.rows().groupBy("service").agg(F.count("*").alias("n"), F.min("time_ns").alias("first"), F.max("time_ns").alias("last"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | surface.queries()


def oracle_sql() -> dict[str, str]:
    return _ORACLES | surface.oracle_sql()
