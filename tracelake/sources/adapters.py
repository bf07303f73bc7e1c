"""Telemetry views over the relational test tables.

Each view is the same plain SQL for both engines where the dialects allow it;
`duck` has the DuckDB text of a view, so that a check can compute from the
same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import spread
from .store import Store

_EMPTY = "'{}' as resource, '{}' as scope"

_LOGS = f"""select NS(ts) * 1000 as time_ns, cast(null as bigint) as observed_time_ns, event_type as service,
 cast(case when event_type = 'error' then 17 else 9 end as smallint) as severity_number,
 case when event_type = 'error' then 'ERROR' else 'INFO' end as severity_text,
 concat(event_type, ' user ', cast(user_id as TEXT)) as body, props as attributes, {_EMPTY} from events"""

_SHARD = """concat('{"shard":"s', cast(user_id % 4 as TEXT), '"}') as attributes"""
_POINT = f"cast(null as bigint) as start_time_ns, METRIC as metric, '1' as unit, event_type as service, {_SHARD}, {_EMPTY}, cast(0 as bigint) as flags"
_EXEMPLAR = """concat('[{"time_unix_nano":', cast(NS(ts) * 1000 as TEXT), ',"value":', cast(event_id as TEXT), ',"trace_id":"ab","span_id":"cd"}]')"""

_GAUGE = f"""select NS(ts) * 1000 as time_ns, {_POINT.replace("METRIC", "'event_value'")}, value, cast(null as TEXT) as temporality, cast(null as boolean) as is_monotonic,
 case when event_id % 50 = 0 then {_EXEMPLAR} else '[]' end as exemplars from events"""

_COUNTER = f"""select time_ns, start_time_ns, metric, unit, service, attributes, resource, scope, flags, cast((n - 1) % 100 + 1 as double) as value, 'CUMULATIVE' as temporality, true as is_monotonic, '[]' as exemplars from (
 select NS(ts) * 1000 as time_ns, {_POINT.replace("METRIC", "'events_total'")}, row_number() over (partition by event_type, user_id % 4 order by ts, event_id) as n from events) c"""

_SPANS = """select c_custkey as trace, c_custkey * 1000000007 as span, cast(null as bigint) as parent, 'customer' as name, 'SERVER' as kind, cast(694224000000000000 as bigint) as start_time_ns, cast(1000 as bigint) as duration_ns, 'UNSET' as status_code, c_mktsegment as service, '{"segment":"' || c_mktsegment || '"}' as attributes from customer
union all select o_custkey, o_orderkey * 16 + 1, o_custkey * 1000000007, 'order', 'CLIENT', NS(o_orderdate) * 1000, cast(floor(o_totalprice) as bigint) * 1000, case o_orderstatus when 'F' then 'ERROR' when 'O' then 'OK' else 'UNSET' end, o_orderpriority, '{"priority":"' || o_orderpriority || '"}' from orders
union all select o_custkey, l_orderkey * 16 + 2 + l_linenumber, l_orderkey * 16 + 1, 'line', 'INTERNAL', min(NS(l_shipdate)) * 1000, cast(sum(l_quantity) as bigint) * 1000, 'OK', 'warehouse', '{"number":' || cast(l_linenumber as TEXT) || '}' from lineitem join orders on l_orderkey = o_orderkey where l_linenumber < 14 group by o_custkey, l_orderkey, l_linenumber"""

_HISTOGRAM = f"""select hour_ns as time_ns, cast(null as bigint) as start_time_ns, 'event_latency' as metric, 'ms' as unit, service, '{{}}' as attributes, {_EMPTY}, cast(0 as bigint) as flags, total as count,
 ARRAY(cast(50 as double), cast(100 as double), cast(200 as double), cast(400 as double)) as explicit_bounds, ARRAY(b0, b1, b2, b3, b4) as bucket_counts, 'DELTA' as temporality from (
 select NS(ts) * 1000 - (NS(ts) * 1000) % 3600000000000 as hour_ns, event_type as service, count(*) as total, sum(case when value <= 50 then 1 else 0 end) as b0, sum(case when value > 50 and value <= 100 then 1 else 0 end) as b1,
 sum(case when value > 100 and value <= 200 then 1 else 0 end) as b2, sum(case when value > 200 and value <= 400 then 1 else 0 end) as b3, sum(case when value > 400 then 1 else 0 end) as b4 from events group by 1, 2) h"""

VIEWS = {"logs": _LOGS, "metrics_gauge": _GAUGE, "metrics_sum": _COUNTER, "span_rows": _SPANS, "metrics_histogram": _HISTOGRAM}


def duck(view: str) -> str:
    return VIEWS[view].replace("NS(", "epoch_us(").replace("TEXT", "varchar").replace("ARRAY(", "list_value(")


def _spark_sql(view: str) -> str:
    return VIEWS[view].replace("NS(", "tracelake_us(").replace("TEXT", "string").replace("ARRAY(", "array(")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


_SERVED: dict[str, dict[str, DataFrame]] = {}


def load(spark: SparkSession, sf_dir: str, path: str) -> Store:
    """The telemetry tables of a folder, written to a store once; view takes them from there afterwards, its files listed once."""
    store = Store(spark, path)
    names = ("logs", "spans", "metrics_gauge", "metrics_sum", "metrics_histogram")
    for name in names:
        store.append(view(spark, sf_dir, name), name)
    _SERVED[sf_dir] = {name: store.read(name) for name in names}
    return store


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry table over the test tables of a folder; spans has ids as 8 and 16 bytes."""
    if sf_dir in _SERVED:
        return _SERVED[sf_dir][name]
    needed = ("customer", "orders", "lineitem") if name in ("spans", "span_rows") else ("events",)
    tables(spark, sf_dir, *needed)
    if "lineitem" in needed:  # by order already for the join and the groups
        spread(spark.table("lineitem"), "l_orderkey").createOrReplaceTempView("lineitem")
    spark.sql("create or replace temporary function tracelake_us(t timestamp_ntz) returns bigint return unix_micros(cast(t as timestamp))")
    if name != "spans":
        return spark.sql(_spark_sql(name))
    rows = spark.sql(_spark_sql("span_rows"))
    to_id = lambda c, n: f"unhex(lpad(hex({c}), {n}, '0'))"
    return rows.selectExpr(
        f"{to_id('trace', 32)} as trace_id", f"{to_id('span', 16)} as span_id", f"{to_id('parent', 16)} as parent_span_id", "name", "kind", "start_time_ns", "duration_ns", "status_code", "cast(null as string) as status_message",
        "service", "attributes", "'{}' as resource", "'{}' as scope", "cast(null as string) as events", "cast(null as string) as links", "cast(null as string) as trace_state", "0L as flags",
    )
