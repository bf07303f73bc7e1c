"""Golden cases of the telemetry engine and equality with DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import json
import math
import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake import functions as fn
from tracelake import queries as engine
from tracelake.api import Engine
from tracelake.operators import ExpHistogramQuery, HistogramQuery, LogQuery, MetricQuery, SpanMetricsQuery, TraceQuery
from tracelake.operators.joins import interval_counts
from tracelake.operators.traces import ancestors
from tracelake.operators.whole_traces import whole
from tracelake.plans import Diagnostic, EvalRange, LimitExceeded, logql, promql, traceql
from tracelake.plans import logql as _logql_function
from tracelake.plans import traceql as _traceql_function
from tracelake.sources import schema, shared
from tracelake.sources.adapters import view
from tracelake.sources.otlp import decode, normalize
from tracelake.sources.shared import spread
from tracelake.sources.store import Store
from tracelake.streaming import reassemble, reassemble_stream, remap, render_logfmt, tail, tumbling_volume
from tracelake.streaming.lines import structured

DATA = "/root/testdata/sf0.001"
S = 1_000_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_matches(spark):
    text = F.lit("Connection-error: TIMEOUT été_42")
    assert one(spark, fn.matches(text, "timeout error")) and one(spark, fn.matches(text, "ÉTÉ 42")) and one(spark, fn.matches(text, ""))
    assert not one(spark, fn.matches(text, "err")) and one(spark, fn.matches(F.lit(None).cast("string"), "a")) is None
    assert one(spark, fn.matches(text, None)) is False


def test_json_access(spark):
    j = F.lit('{"s":"x","i":5,"d":1.5,"n":"500","b":true,"o":{},"http.route":"/a","z":null}')
    assert [one(spark, fn.json_get_str(j, k)) for k in ("s", "i", "http.route", "b", "absent", "z")] == ["x", None, "/a", None, None, None]
    odd = F.lit('{"a":"5d","b":" 7 ","c":"7.5e1","d":"-inf","e":"1_0","f":"+3"}')
    assert [one(spark, fn.json_get_num(odd, k)) for k in "abcdef"] == [None, None, 75.0, -math.inf, None, 3.0]
    assert [one(spark, fn.json_get_num(j, k)) for k in ("i", "d", "n", "s", "b", "o", "absent")] == [5.0, 1.5, 500.0, None, None, None, None]
    assert one(spark, fn.json_get_str(F.lit("not json"), "s")) is None
    fn.register(spark)
    row = spark.sql("select matches('a b', 'B') m, json_get_str('{\"k\":\"v\"}', 'k') s, json_get_num('{\"k\":\"7\"}', 'k') n, hex_lower(x'AB') h").first()
    assert (row.m, row.s, row.n, row.h) == (True, "v", 7.0, "ab")


def test_terms_are_cut_alike(spark):
    fn.register(spark)
    for text, query, want in (("यह हिन्दी है", "हिन्दी", True), ("naïve Café", "CAFÉ", True), ("x_1", "1", True), ("a-b", "ab", False), ("a", "?!", True)):
        assert one(spark, fn.matches(F.lit(text), query)) is want is spark.sql("select matches(:t, :q) m", args={"t": text, "q": query}).first().m


def test_sql_functions(spark):
    fn.register(spark)
    got = spark.sql("select histogram_quantile(0.5, array(1d, 5d), array(2d, 3d, 2d)) a, histogram_quantile(1d, array(1d, 5d), array(2d, 3d, 2d)) b, json_get_str(:j, :k) s, hex_lower(x'AB0C') h", args={"j": '{"a\\"]b":"z"}', "k": 'a"]b'}).first()
    assert tuple(got) == (pytest.approx(3.0), 5.0, "z", "ab0c")
    assert fn.parse_bytes("64MiB") == 64 << 20 and fn.parse_bytes("1.5kb") == 1500 and fn.parse_bytes("7") == 7
    with pytest.raises(ValueError):
        fn.parse_bytes("7 apples")


def test_canonical_json():
    assert fn.canonical_json({"b": 1, "a": [1.0, float("nan"), b"hi", None, True, "é"]}) == '{"a":[1.0,{"$f":"nan"},"aGk=",null,true,"é"],"b":1}'


def test_durations():
    assert fn.parse_duration("1h30m") == 5400 * S and fn.parse_duration("15", bare="s") == 15 * S
    with pytest.raises(ValueError):
        fn.parse_duration("1x")
    assert fn.severity_number("Warning") == 13 and fn.severity_name(18) == "ERROR"


def test_histogram_quantile(spark):
    q = lambda p, b, c: one(spark, fn.histogram_quantile(F.lit(p), F.array(*map(F.lit, b)).cast("array<double>"), F.array(*map(F.lit, c)).cast("array<bigint>")))
    got = [q(p, [1, 5], [2, 3, 2]) for p in (0.0, 0.1, 0.5, 0.99, 1.0)]
    assert got == pytest.approx([0.0, 0.35, 3.0, 5.0, 5.0])
    assert q(-0.1, [1], [1, 1]) == -math.inf and q(1.1, [1], [1, 1]) == math.inf and math.isnan(q(0.5, [1], [0, 0])) and math.isnan(q(math.nan, [1], [1, 1]))


def test_exp_histogram_quantile(spark):
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    q = lambda p, scale, zero, pos, neg, off=0: one(spark, fn.exp_histogram_quantile(F.lit(p), F.lit(scale), F.lit(zero), F.lit(off), longs(pos), F.lit(0), longs(neg)))
    assert [q(p, 0, 0, [4], []) for p in (0.0, 0.5, 1.0)] == pytest.approx([1.0, 1.5, 2.0])
    assert q(0.1, 0, 8, [2], []) == 0.0 and q(0.75, 0, 0, [2, 2], []) == pytest.approx(3.0) and q(0.5, 0, 0, [], [4]) == pytest.approx(-1.5)
    assert q(0.0, -10, 0, [4], []) == 1.0


def test_classic_quantile(spark):
    b = lambda *x: F.array(*[F.struct(F.lit(float(le)).alias("le"), F.lit(float(n)).alias("n")) for le, n in x])
    q = lambda p, *x: one(spark, fn.classic_histogram_quantile(F.lit(p), b(*x)))
    assert q(0.75, (1, 2), (2, 4), (math.inf, 4)) == pytest.approx(1.5) and q(1.0, (1, 2), (2, 4), (math.inf, 4)) == pytest.approx(2.0)
    assert math.isnan(q(0.5, (1, 1), (2, 2))) and q(0.5, (1, 2), (2, 1), (math.inf, 3)) == pytest.approx(0.75)
    assert q(0.5, (math.inf, 2), (1, 1), (1, 1), (2, 2)) == pytest.approx(0.5)


def points(spark, rows, table="metrics_sum", **fixed):
    """rows: (time, attributes, value)."""
    base = {"metric": "requests_total", "unit": "1", "service": None, "resource": "{}", "scope": "{}", "temporality": "CUMULATIVE", "is_monotonic": True, "exemplars": "[]"} | fixed
    df = spark.createDataFrame([(t, json.dumps(a), float(v)) for t, a, v in rows], "time_ns long, attributes string, value double")
    return schema.coerce(df.withColumns({k: F.lit(v) for k, v in base.items()}), table)


def samples(df):
    return sorted((tuple(sorted((r.labels or {}).items())), r.at, round(r.value, 12) if not math.isnan(r.value) else "nan") for r in df.collect())


def test_promql_rate_with_reset(spark):
    p = points(spark, [(10 * S, {}, 5), (20 * S, {}, 9), (30 * S, {}, 2), (40 * S, {}, 7)])
    assert samples(promql("rate(requests_total[50s])", {"metrics_sum": p}, EvalRange.instant(50 * S))) == [((), 50 * S, round(11 / 30, 12))]
    assert samples(promql("rate(requests_total[5s])", {"metrics_sum": p}, EvalRange.instant(42 * S))) == []


def test_promql_sum_of_rates(spark):
    rows = [(t * S, {"route": "/a", "instance": i}, v) for i, vs in (("x", (0, 10, 20)), ("y", (0, 5, 10))) for t, v in zip((10, 20, 30), vs, strict=True)]
    got = samples(promql("sum by (route) (rate(requests_total[30s]))", {"metrics_sum": points(spark, rows)}, EvalRange.instant(30 * S)))
    assert got == [((("route", "/a"),), 30 * S, 1.0)]
    gauge = points(spark, [(10 * S, {"route": "/a", "instance": "x"}, 2), (10 * S, {"route": "/a", "instance": "y"}, 3)], "metrics_gauge", temporality=None, is_monotonic=None)
    assert samples(promql("sum(requests_total) by (route)", {"metrics_gauge": gauge}, EvalRange.instant(10 * S))) == [((("route", "/a"),), 10 * S, 5.0)]
    assert len(samples(promql('max without (route) (requests_total{instance=~"x|z"})', {"metrics_gauge": gauge}, EvalRange.instant(10 * S)))) == 1


def test_promql_windows_and_nan(spark):
    g = points(spark, [(10 * S, {"k": "a"}, math.nan), (20 * S, {"k": "b"}, 4)], "metrics_gauge")
    t = {"metrics_gauge": g}
    assert samples(promql("requests_total", t, EvalRange(10 * S, 20 * S, 10 * S, 10 * S)))[0][1:] == (10 * S, "nan")
    assert len(samples(promql("requests_total", t, EvalRange(20 * S, 20 * S, S, 10 * S)))) == 1  # the left edge is open
    assert samples(promql("min(requests_total)", t, EvalRange(20 * S, 20 * S, S, 11 * S))) == [((), 20 * S, 4.0)]
    assert samples(promql("max(requests_total)", t, EvalRange.instant(10 * S))) == [((), 10 * S, -math.inf)]


def test_promql_histogram(spark):
    rows = [(t * S, c) for t, c in ((10, [1, 1, 0]), (20, [2, 2, 0]), (30, [3, 3, 0]))]
    df = spark.createDataFrame(rows, "time_ns long, bucket_counts array<long>").withColumns({"metric": F.lit("lat"), "attributes": F.lit('{"route":"/checkout"}'), "explicit_bounds": F.array(F.lit(1.0), F.lit(2.0)), "temporality": F.lit("CUMULATIVE")})
    out = promql("histogram_quantile(0.75, sum by (le, route) (rate(lat_bucket[30s])))", {"metrics_histogram": schema.coerce(df, "metrics_histogram")}, EvalRange.instant(30 * S))
    assert samples(out) == [((("route", "/checkout"),), 30 * S, 1.5)]


def test_promql_errors(spark):
    p = points(spark, [(10 * S, {}, 1), (10 * S, {}, 2)])
    with pytest.raises(Exception, match="duplicate"):
        promql("requests_total", {"metrics_sum": p}, EvalRange.instant(10 * S)).collect()
    assert samples(promql("requests_total", {"metrics_sum": p}, EvalRange.instant(10 * S), "last_wins"))[0][2] == 2.0
    with pytest.raises(Exception, match="cumulative"):
        promql("rate(requests_total[1m])", {"metrics_sum": points(spark, [(1, {}, 1)], temporality="DELTA")}, EvalRange.instant(10 * S)).collect()
    for text in ("a + b", "topk(1, a)", 'a{b="c",}', "sum by (a)(x) by (b)", "rate(a)", 'a{b="c"', "histogram_quantile(0.5, a)"):
        with pytest.raises(Diagnostic):
            promql(text, {"metrics_gauge": p}, EvalRange.instant(S))
    with pytest.raises(LimitExceeded):
        EvalRange(0, 11_001, 1)
    with pytest.raises(ValueError):
        promql('a{b=~"(?=x)"}', {"metrics_gauge": p}, EvalRange.instant(S))


def log_rows(spark, rows):
    return schema.coerce(spark.createDataFrame(rows, "time_ns long, service string, body string"), "logs")


def test_logql(spark):
    logs = log_rows(spark, [(6, "api", "ok"), (9, "api", "error"), (14, "api-server", "error")])
    count = lambda q, span, df=logs: samples(logql(q, df, span))
    assert [x[1:] for x in count('sum by (x) (count_over_time({} |= "error" [10ns]))', EvalRange(10, 20, 10))] == [(10, 1.0), (20, 1.0)]
    edge = log_rows(spark, [(t, "a", "x") for t in (0, 10, 20, 21)])
    assert [x[1:] for x in count("count_over_time({}[10ns])", EvalRange(10, 20, 10), edge)] == [(10, 1.0), (20, 1.0)]
    assert count('count_over_time({service=~"api"}[20ns])', EvalRange.instant(20)) == [((("service", "api"),), 20, 2.0)]
    offset = log_rows(spark, [(t, "a", "x") for t in (5, 6, 15)])
    assert [x[1:] for x in count("sum by (service) (count_over_time({}[10ns] offset 9ns))", EvalRange.instant(15), offset)] == [(15, 2.0)]
    line = log_rows(spark, [(1, "a", "connection error timeout")])
    hits = {'|? "timeout error"': 1, '|? "err"': 0, '|= "err"': 1, '!? "refused"': 1, '!? "error"': 0, '!? "error refused"': 1, '|~ "err.r"': 1, '!= "x" !~ "z$"': 1}
    assert {k: logql(k, line).count() for k in hits} == hits
    for text in ("{} | json", "rate({})", "avg by (a) (rate({}[1s]))"):
        with pytest.raises(Diagnostic):
            logql(text, line, EvalRange.instant(1))
    assert _logql_function is logql


def span_rows(spark, rows):
    """rows: id, parent, name, attributes."""
    to = lambda x: None if x is None else x.to_bytes(8, "big")
    data = [(bytes(15) + b"\x01", to(i), to(p), n, "SERVER", 100 + i, 50 * i, "OK", "svc", json.dumps(a)) for i, p, n, a in rows]
    df = spark.createDataFrame(data, "trace_id binary, span_id binary, parent_span_id binary, name string, kind string, start_time_ns long, duration_ns long, status_code string, service string, attributes string")
    return schema.coerce(df, "spans")


def test_traceql(spark):
    spans = span_rows(spark, [(1, None, "frontend", {"a": 1}), (2, 1, "mid", {"m": ["GET", "POST"]}), (3, 2, "database", {"a": "x", "f": 1.5})])

    def ids(text):
        rows = traceql(text, spans).collect()
        return [int(x, 16) for x in rows[0].span_ids] if rows else []

    cases = {
        '{ name = "frontend" } >> { name = "database" }': [3], '{ name = "frontend" } > { }': [2], '{ name = "database" } << { }': [1, 2], '{ name = "database" } < { }': [2],
        "{ } !< { }": [3], '{ name = "frontend" } &> { }': [1, 2], "{ } ~ { }": [], "{ } !> { }": [1], "{ span.a = 1 }": [1], "{ span.a != 1 }": [3], "{ span.a = 1.0 }": [1], "{ .a = nil }": [2],
        "{ .a != nil }": [], '{ .a =~ "x" }': [3], '{ .m = "POST" }': [2], '{ .m != "POST" }': [], '{ .m !~ "PUT" }': [2], "{ .f > 1 }": [3], "{ childCount = 1 }": [1, 2], "{ duration >= 100ns }": [2, 3],
        '{ rootName = "frontend" } | count() = 3': [1, 2, 3], "{ } | count() < 3": [], '{ name = "x" } || { name = "mid" } && { name = "database" }': [2, 3], '{ name = "mid" } && { name = "none" }': [],
        '{ name =~ "data.*" && kind = "SERVER" }': [3], '{ status = error }': [], '{ status = OK && span:id = "0000000000000001" }': [1], "{ traceDuration > 100ns }": [1, 2, 3],
    }
    assert {k: ids(k) for k in cases} == cases
    with pytest.raises(ValueError, match="cycle"):
        ancestors(span_rows(spark, [(1, 2, "a", {}), (2, 1, "b", {})]))
    for text in ("{ name }", "{ foo.bar = 1 }", "{", "{} >>> {}", "{} | avg()"):
        with pytest.raises(Diagnostic):
            traceql(text, spans)
    assert _traceql_function is traceql


def test_typed_metrics(spark):
    delta = points(spark, [(0, {}, 3), (S, {}, 3), (2 * S, {}, 3)], temporality="DELTA")
    q = MetricQuery(delta, kind="sum").metric("requests_total").every(3 * S)
    assert [r.value for r in q.using("rate").query_range().collect()] == [3.0] and [r.value for r in q.query_range().collect()] == [9.0]
    assert [r.value for r in q.using("count").query_range().collect()] == [3.0]
    counter = points(spark, [(0, {}, 10), (S, {}, 13), (2 * S, {}, 16)])
    assert [r.value for r in MetricQuery(counter).every(3 * S).using("rate_counter").query_range().collect()] == [2.0]
    both = points(spark, [(0, {}, math.nan), (0, {}, 2), (0, {}, 7)])
    assert [r.value for r in MetricQuery(both).deduplicated().rows().collect()] == [7.0]


def test_histograms(spark):
    df = spark.createDataFrame([(0, [10, 0, 0]), (1, [0, 0, 10])], "time_ns long, bucket_counts array<long>").withColumns({"metric": F.lit("h"), "attributes": F.lit("{}"), "explicit_bounds": F.array(F.lit(1.0), F.lit(5.0))})
    q = HistogramQuery(schema.coerce(df, "metrics_histogram"))
    assert sorted(r.value for r in q.quantile_per_point(0.5).collect()) == [0.5, 5.0] and [r.value for r in q.quantile(0.5).collect()] == [1.0]
    rows = [(0, 1, 2, [8]), (1, 0, 0, [2])]
    df = spark.createDataFrame(rows, "time_ns long, scale int, positive_offset int, positive_counts array<long>").withColumns({"metric": F.lit("e"), "attributes": F.lit("{}"), "zero_count": F.lit(0), "negative_offset": F.lit(0), "negative_counts": F.array().cast("array<bigint>")})
    e = ExpHistogramQuery(schema.coerce(df, "metrics_exp_histogram")).every(S)
    assert [r.value for r in e.quantile(0.5).collect()] == [2.75] and e.quantile_per_point(0.5).count() == 2


def test_logs_and_traces(spark):
    logs = log_rows(spark, [(i, "a" if i % 2 else None, f"line {i}") for i in range(10)])
    page = LogQuery(logs).forward().page(4, 4)
    got = page.collect_rows().collect()
    assert [r.time_ns for r in got] == [4, 5, 6, 7] and page.next_offset(len(got)) == 8 and page.next_offset(3) is None
    assert {(r.service, r["count"]) for r in LogQuery(logs).volume_by(100, "service").collect()} == {("", 5), ("a", 5)}
    assert LogQuery(logs).match_none().count().first()[0] == 0 and LogQuery(logs).attr_in("x", []).rows().count() == 0
    assert LogQuery(logs).range(2, 5).rows().count() == 3 and LogQuery(logs).range_inclusive(2, 5).rows().count() == 4
    spans = span_rows(spark, [(1, None, "root", {}), (2, 1, "late", {})])
    assert TraceQuery(spans).name("late").started(101, 102).search().count() == 1 and TraceQuery(spans).name("late").started(102, 200).search().count() == 0
    red = SpanMetricsQuery(spans).every(S).group_by("service").red().first()
    assert (red.calls, red.errors, red.error_rate, red.p50) == (2, 0, 0.0, 75.0)


OTLP = {
    "resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [{"timeUnixNano": "5", "severityNumber": 99, "body": {"kvlistValue": {"values": [{"key": "b", "value": {"intValue": "1"}}]}}, "traceId": "00"}]}]}],
    "resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "0" * 31 + "1", "spanId": "0" * 15 + "2", "startTimeUnixNano": "10", "endTimeUnixNano": "5", "kind": 2, "events": [{"timeUnixNano": "7", "name": "e"}]}]}]}],
    "resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "cpu", "gauge": {"dataPoints": [{"timeUnixNano": "100", "asDouble": 0.5}]}}, {"name": "requests", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [{"timeUnixNano": "100", "asInt": "42"}]}}]}]}],
}


def test_otlp(spark):
    rows = dict((t, r) for t, r in decode(json.dumps(OTLP)))
    log, span = rows["logs"], rows["spans"]
    assert (log["service"], log["severity_number"], log["body"], log["trace_id"], log["scope"]) == ("shop", 24, '{"b":1}', None, '{"name":"lib"}')
    assert (span["duration_ns"], span["kind"], span["status_code"], span["parent_span_id"], span["links"]) == (0, "SERVER", "UNSET", None, None)
    assert (rows["metrics_sum"]["value"], rows["metrics_sum"]["temporality"], rows["metrics_gauge"].get("temporality")) == (42.0, "CUMULATIVE", None)
    df = spark.createDataFrame([(json.dumps(OTLP),), (None,)], "value string")
    assert normalize(df, "metrics_gauge").count() == 1 and normalize(df, "spans").columns == [n for n, _ in schema.columns("spans")]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    day = 86_400 * S
    rows = [(d * day + i, "svc", json.dumps({"k": f"v{i}", "n": i})) for d in range(3) for i in range(5)]
    logs = spark.createDataFrame(rows, "time_ns long, service string, attributes string")
    store.append(logs, "logs")
    before = sorted(r.time_ns for r in LogQuery(store.read("logs")).attr_eq("k", "v3").rows().collect())
    store.set_promoted(["k", "body", "k", "n"])
    assert store.promoted() == ["k", "n"]
    store.append(logs.withColumn("time_ns", F.col("time_ns") + 100), "logs")
    assert sorted(r.time_ns for r in LogQuery(store.read("logs")).attr_eq("k", "v3").rows().collect()) == sorted(before + [t + 100 for t in before])
    assert store.compact() == 3 and store.compact() == 0
    read = store.read("logs")
    assert read.where("k = 'v3'").count() == 6 and read.where("n is not null").count() == 0 and read.count() == 30
    assert store.export("logs", 0, day).read_all().num_rows == 10
    copy = store.snapshot(str(tmp_path / "copy"))
    assert store.retain(oldest_ns=day) == 1 and store.read("logs").count() == 20 and copy.read("logs").count() == 30
    assert store.retain(most_bytes=1) == 2 and store.read("logs").count() == 0
    assert store.stats().where("rows > 0").count() == 0
    copy.register()
    assert spark.sql("select count(*) from logs where time_ns < 1000").first()[0] == 10


def test_engine(spark, tmp_path):
    engine_ = Engine(Store(spark, str(tmp_path / "db")))
    docs = spark.createDataFrame([(json.dumps(OTLP),)], "value string")
    assert engine_.ingest_otlp(docs)["metrics_sum"].accepted == 1
    again = engine_.ingest_otlp(docs.unionByName(docs), reject_duplicates=True)
    assert (again["metrics_gauge"].accepted, again["metrics_gauge"].rejected, again["logs"].accepted) == (0, 2, 2)
    assert engine_.query_sql("select count(*) as n from logs where matches(body, :q)", {"q": "b"}).first().n == 3
    assert engine_.list_metrics().count() == 2 and engine_.metric("cpu").every(S).query_range().first().value == 0.5
    assert [r.value for r in engine_.promql("requests", "sum(cpu)", span=EvalRange.instant(100)).orderBy("query_index").collect()] == [42.0, 0.5]
    assert engine_.traceql("{ kind = \"SERVER\" }", EvalRange(0, 100, 1), most_traces=5).count() == 1
    assert engine_.logql("{service=\"shop\"}").count() == 3 and engine_.list_attribute_values("service.name").collect()[0].value == "shop"
    assert engine_.promql_for("sum", "requests", "service") == "sum by (service) (rate(requests[5m]))"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(OTLP) + "\n")
    engine_.stream_otlp(str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
    assert engine_.logs().count().first()[0] == 4 and engine_.tail_logs(limit=2).count() == 2
    engine_.set_promoted_attributes(["k"])
    assert engine_.run_housekeeping()["rewritten"] > 0 and engine_.db_stats().where("rows > 0").count() == 4


def test_streaming_reassembly_and_follow(spark, tmp_path):
    rows = [("a", 0, 1, "out", "hel", False), ("b", 0, 2, "err", "one ", False), (None, 0, 3, "out", "whole", True)], [("b", 1, 4, "err", "two", True), ("a", 1, 5, "out", "lo", True)]
    kind = "chunk_id string, ordinal int, time_ns long, source string, text string, last boolean"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "chunks" / str(i)))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "chunks"))
    reassemble_stream(stream).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("lines").collect()) == [(1, "out", "hello"), (2, "err", "one two"), (3, "out", "whole")]
    store = Store(spark, str(tmp_path / "store"))
    logs = lambda *at: schema.coerce(spark.createDataFrame([(t, t, f"b{t}") for t in at], "time_ns long, observed_time_ns long, body string"), "logs")
    engine_ = Engine(store)
    run = lambda: engine_.follow_logs(5).writeStream.format("parquet").option("path", str(tmp_path / "followed")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    followed = lambda: sorted(r.body for r in spark.read.parquet(str(tmp_path / "followed")).collect())
    store.append(logs(3, 7), "logs")
    run()
    assert followed() == ["b7"]
    store.append(logs(9), "logs")
    assert store.compact() == 1
    run()  # what a compaction has rewritten is not new
    assert store.read("logs").count() == 3 and followed() == ["b7", "b9"]


def test_compaction_switches_at_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    logs = lambda *at: schema.coerce(spark.createDataFrame([(t, f"b{t}") for t in at], "time_ns long, body string"), "logs")
    store.append(logs(1, 2), "logs")
    store.append(logs(3), "logs")
    pinned = store.snapshot_files()
    real = Store._rename

    def crash(self, a, b):
        if "_new-" in a:
            raise OSError("lost")
        real(self, a, b)

    monkeypatch.setattr(Store, "_rename", crash)
    with pytest.raises(OSError):
        store.compact()
    assert sorted(r.body for r in store.read("logs").collect()) == ["b1", "b2", "b3"]  # the new file is not taken yet
    monkeypatch.setattr(Store, "_rename", real)
    assert store.compact() == 1 and store.compact() == 0
    assert sorted(r.body for r in store.read("logs").collect()) == ["b1", "b2", "b3"] and len(store.files("logs")) == 1
    store.append(logs(4), "logs")
    assert store.compact() == 1 and store.read("logs").count() == 4
    assert pinned.listing["logs"] != tuple(store.files("logs"))


def test_a_batch_is_appended_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    day = 86_400 * S
    logs = schema.coerce(spark.createDataFrame([(t * day, f"b{t}") for t in range(3)], "time_ns long, body string"), "logs")
    real, moves = Store._rename, []

    def crash(self, a, b):
        moves.append(b)
        if len(moves) == 2:
            raise OSError("lost")
        real(self, a, b)

    monkeypatch.setattr(Store, "_rename", crash)
    with pytest.raises(OSError):
        store.append_once(logs, "logs", "x1")
    monkeypatch.setattr(Store, "_rename", real)
    for _ in range(2):
        store.append_once(logs, "logs", "x1")
        assert sorted(r.body for r in store.read("logs").collect()) == ["b0", "b1", "b2"]
    assert [r["body"] for b in store.export("logs", day, None) for r in b.to_pylist()] == ["b1", "b2"]


def test_lines(spark):
    s = structured('{"level":"warn","msg":"hi","ts":"1970-01-01T00:00:01Z","trace_id":"' + "0" * 32 + '","x":1}', 2 * S)
    assert (s["severity_number"], s["body"], s["time_ns"], s["attributes"], len(s["trace_id"])) == (13, "hi", S, '{"x":1}', 16)
    s = structured('level=info msg="a b" user=7', 0)
    assert (s["severity_number"], s["body"], s["attributes"]) == (9, "a b", '{"user":"7"}')
    s = structured("E0102 10:11:12.5 77 main.go:5] boom", 0)
    assert (s["severity_number"], s["body"]) == (17, "boom")
    new_year = 1_767_225_600 * S  # 2026-01-01
    assert structured("W1231 23:59:58.250000 7 a.go:1] x", new_year)["time_ns"] == new_year - 1_750_000_000
    s = structured("I20251231 23:59:59.000001 28133 glog.cc:70] hello", new_year)
    assert (s["time_ns"], s["body"], s["severity_number"]) == (new_year - S + 1000, "hello", 9)
    assert structured("just words", 3)["body"] == "just words" and structured("started a=1 b=2", 3)["body"] == "started"
    assert structured('{"ts": 1e18, "msg": "far"}', 5)["time_ns"] == 5
    df = spark.createDataFrame([("level=error msg=x", 9, "s"), (None, None, None)], "line string, observed_time_ns long, service string")
    assert {r.severity_number for r in remap(df).collect()} == {17, 0}
    chunks = spark.createDataFrame([("c", 1, 20, "out", "lo"), ("c", 0, 10, "err", "hel"), (None, 0, 5, "out", "whole")], "chunk_id string, ordinal int, time_ns long, source string, text string")
    assert sorted(tuple(r) for r in reassemble(chunks).collect()) == [(5, "out", "whole"), (10, "err", "hello")]
    wide = spark.createDataFrame([("c", i, i, "out", "ééé", i == 4) for i in range(6)], "chunk_id string, ordinal int, time_ns long, source string, text string, last boolean")
    assert [r.line for r in reassemble(wide, 13).orderBy("time_ns").collect()] == ["éééééé", "éééééé", "ééé"]
    logs = schema.coerce(spark.createDataFrame([(1_000_000_123, 5, 17, "a \"b\"", '{"k":"v w","n":"1"}'), (2, 9, 9, "ok", "{}")], "time_ns long, observed_time_ns long, severity_number int, body string, attributes string"), "logs")
    text = {r.time_ns: r.line for r in render_logfmt(logs).collect()}
    assert text[1_000_000_123] == 'ts=1970-01-01T00:00:01.000000123Z level=ERROR msg="a \\"b\\"" k="v w" n=1'
    assert [r.body for r in tail(logs, 5).collect()] == ["ok"]


def test_streams_equal_batches(spark, tmp_path):
    logs = log_rows(spark, [(i * S, "a", "x") for i in range(100)]).select("time_ns", "service")
    logs.write.parquet(str(tmp_path / "in"))
    stream = tumbling_volume(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in")), "10 seconds", "service", delay="1 minute")
    q = stream.writeStream.format("memory").queryName("volume").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("volume").collect())) == sorted(map(tuple, tumbling_volume(logs, "10 seconds", "service").collect()))


def _norm(v):
    if v is None or v == "":
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def _rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(_norm, r)) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert _rows(engine.queries()[name](spark, DATA).toArrow()) == _rows(con.sql(engine.oracle_sql()[name]).to_arrow_table())


def test_interval_counts_pair_nothing(spark):
    rng = random.Random(5)
    points = [(rng.choice([None, rng.randrange(-9_000, 9_000), 7]),) for _ in range(400)]
    intervals = [(rng.randrange(60), a, a + rng.randrange(-5, 4_000)) for a in (rng.randrange(-9_000, 9_000) for _ in range(200))] + [(None, 7, 8), (99, 20_000, 30_000), (98, None, 8)]
    p, i = spark.createDataFrame(points, "at long"), spark.createDataFrame(intervals, "id long, start long, end long")
    want = {}
    for k, a, b in intervals:
        if n := sum(a is not None and t is not None and a <= t < b for (t,) in points):
            want[k] = want.get(k, 0) + n
    for width in (1, 3_000, 5_000_000):
        assert dict(interval_counts(p, i, "at", "start", "end", ["id"], width).collect()) == want
    plan = engine.queries()["join_interval"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # it paired every error with the purchases of ten hours


def _random_spans(rng):
    """Traces with missing parents, ids that occur twice, null ids and one large trace; no cycles: parents have lower ids."""
    to = lambda x, n: None if x is None else x.to_bytes(n, "big")
    rows = []
    for trace in range(30):
        for span in range(1, rng.choice([2, 6, 300 if trace == 7 else 12])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                parent = rng.choice([None, 0, rng.randrange(1, span + 1) - 1, max(1, span - 1) if span > 1 else None])
                rows.append((trace, span, parent, rng.choice("abc"), rng.randrange(1000)))
    return rows, [(to(t, 16), to(s, 8), to(p, 8), n, "SERVER", at, 1, "OK", "svc", "{}") for t, s, p, n, at in rows] + [(None, to(1, 8), None, "a", "SERVER", 5, 1, "OK", "svc", "{}"), (to(3, 16), None, to(1, 8), "b", "SERVER", 5, 1, "OK", "svc", "{}")]


_SPANS_DDL = "trace_id binary, span_id binary, parent_span_id binary, name string, kind string, start_time_ns long, duration_ns long, status_code string, service string, attributes string"


def _above(rows):
    parents = {}
    for t, s, p, *_ in rows:
        parents.setdefault((t, s), set()).add((t, p))
    out = {}
    for k in sorted(parents):  # parents have lower ids
        out[k] = {x for p in parents[k] if p in parents for x in {p} | out[p]}
    return parents, out


def _spanset_by_hand(query, rows, parents, above):
    if isinstance(query, str):
        return {(t, s) for t, s, _, n, _ in rows if n == query}
    if query[0] == "count":
        inner = _spanset_by_hand(query[1], rows, parents, above)
        n = {}
        for t, s, _, name, _ in rows:
            n.setdefault(t, []).append((t, s)) if name == query[1] else None
        return {x for x in inner if len(n[x[0]]) >= query[2]}
    op, a, b = query
    left, right = _spanset_by_hand(a, rows, parents, above), _spanset_by_hand(b, rows, parents, above)
    if op == "||":
        return left | right
    if op == "&&":
        return {x for x in left | right if x[0] in {t for t, _ in left} & {t for t, _ in right}}
    bare = op.lstrip("&!")
    hit = {
        ">": lambda x: parents[x] & left, "<": lambda x: any(x in parents[y] for y in left), ">>": lambda x: above[x] & left, "<<": lambda x: any(x in above[y] for y in left),
        "~": lambda x: any(y != x and y[0] == x[0] and {p for p in parents[y] & parents[x] if p[1] is not None} for y in left),
    }[bare]
    matched = {x for x in right if bool(hit(x)) != ("!" in op)}
    return left | matched if "&" in op else matched


def test_traceql_equals_sets_by_hand(spark):
    rng = random.Random(11)
    rows, data = _random_spans(rng)
    spans = schema.coerce(spark.createDataFrame(data, _SPANS_DDL), "spans").repartition(5)
    parents, above = _above(rows)
    text = lambda q: f'{{ name = "{q}" }}' if isinstance(q, str) else f"({text(q[1])}) {q[0]} ({text(q[2])})"
    queries = [(op, "a", "b") for op in ("||", "&&", ">", ">>", "<", "<<", "~", "!>", "!>>", "!<", "!<<", "!~", "&>", "&>>", "&<", "&<<", "&~", "&!>", "&!>>", "&!~")] + [("&&", ("||", "a", "b"), ("!>>", "c", "a")), ("<<", ("&>", "a", "b"), ("||", "c", "b")), ("~", ("&&", "a", "c"), "a")]
    for q in queries:
        got = {(int(r.trace_id, 16), int(s, 16)) for r in traceql(text(q), spans).collect() for s in r.span_ids}
        assert got == _spanset_by_hand(q, rows, parents, above), q
    counted = traceql('{ name = "a" } | count() >= 3', spans).collect()
    assert {(int(r.trace_id, 16), int(s, 16)) for r in counted for s in r.span_ids} == _spanset_by_hand(("count", "a", 3), rows, parents, above)
    first, last = {}, {}
    for t, *_, at in rows + [(3, None, None, "b", 5)]:
        first[t], last[t] = min(at, first.get(t, at)), max(at, last.get(t, at))
    whole = traceql("{ } || { }", spans).collect()
    assert [(int(r.trace_id, 16), r.start_time_ns) for r in whole] == [(t, first[t]) for t in sorted(first, key=lambda t: (-last[t], t))]
    page = traceql("{ } || { }", spans, EvalRange(3, 400, 1), limit=4).collect()
    assert page == [r for r in whole if 3 <= r.start_time_ns <= 400][:4]
    cyclic = span_rows(spark, [(1, 2, "a", {}), (2, 1, "b", {})])
    with pytest.raises(ValueError, match="cycle"):
        traceql('{ name = "a" } >> { name = "b" }', cyclic)
    assert traceql('{ name = "a" } >> { name = "none" }', cyclic).collect() == []
    assert [r.span_ids for r in traceql('{ name = "a" } > { name = "b" }', cyclic).collect()] == [[f"{2:016x}"]]


def test_traces_come_whole_from_batches():
    t = pa.table({"trace_id": pa.array([bytes([i // 7]) for i in range(100)]), "x": range(100)})
    for size in (1, 3, 7, 50, 100):
        parts = [p.column("x").to_pylist() for p in whole(iter(t.to_batches(size)))]
        assert sum(parts, []) == list(range(100)) and all(p[0] % 7 == 0 and (p[-1] % 7 == 6 or p[-1] == 99) for p in parts)
        assert size == 100 or max(map(len, parts)) <= max(2 * size, 7) + size


def test_traceql_brings_traces_together_once(spark):
    """No joins of spans with themselves: their sorts and hash tables added up in one task."""
    for name in ("traceql_select", "traceql_child_count", "traceql_root", "traceql_and", "traceql_or", "traceql_count", "traceql_child", "traceql_descendant", "traceql_ancestor", "traceql_parent", "traceql_sibling", "traceql_not_parent", "traceql_union_child"):
        plan = engine.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan, name


def test_shares_of_a_shuffle_do_not_grow(spark, tmp_path):
    df = spark.range(1000).withColumn("pad", F.repeat(F.md5(F.col("id").cast("string")), 1000))
    df.write.parquet(str(tmp_path / "t"))
    size = sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "t/*.parquet")))
    assert spread(spark.read.parquet(str(tmp_path / "t")), "id").rdd.getNumPartitions() == -(-size // shared.SPREAD_BYTES)
    big = shared.SPREAD_BYTES
    try:
        shared.SPREAD_BYTES = size // 9
        assert spread(spark.read.parquet(str(tmp_path / "t")), "id").rdd.getNumPartitions() in (9, 10)
    finally:
        shared.SPREAD_BYTES = big
    assert spread(spark.createDataFrame([(1,)], "id long"), "id").rdd.getNumPartitions() >= 1


def test_spans_are_spread_by_order(spark):
    for df in (view(spark, DATA, "spans"), *(engine.queries()[name](spark, DATA) for name in ("span_red_metrics", "trace_summaries", "trace_search", "logs_join_spans"))):
        assert "RepartitionByExpression [l_orderkey" in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_waterfall_is_shuffled_by_trace_once(spark):
    plan = engine.queries()["trace_waterfall"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [trace_id") == 2  # the rows and their parents


def test_ancestors_equal_sets_by_hand(spark):
    rows, data = _random_spans(random.Random(12))
    spans = schema.coerce(spark.createDataFrame(data, _SPANS_DDL), "spans").repartition(5)
    got = [tuple(int.from_bytes(x, "big") for x in r) for r in ancestors(spans).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, s, a) for (t, s), above in _above(rows)[1].items() for _, a in above}
    chain = span_rows(spark, [(i, i - 1 or None, "a", {}) for i in range(1, 61)])
    assert ancestors(chain).count() == 60 * 59 // 2 and ancestors(chain, 59).count() == 60 * 59 // 2
    with pytest.raises(ValueError, match="too deep"):
        ancestors(chain, 58)
