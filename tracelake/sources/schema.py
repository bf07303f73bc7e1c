"""The seven telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CONTEXT = "attributes string, resource string, scope string"
_POINT = f"time_ns long, start_time_ns long, metric string, unit string, service string, {_CONTEXT}, flags long"

#: Table names and columns, in order.
DDL = {
    "logs": f"time_ns long, observed_time_ns long, service string, severity_number short, severity_text string, body string, {_CONTEXT}, trace_id binary, span_id binary, flags long",
    "spans": f"trace_id binary, span_id binary, parent_span_id binary, name string, kind string, start_time_ns long, duration_ns long, status_code string, status_message string, service string, {_CONTEXT}, events string, links string, trace_state string, flags long",
    "metrics_gauge": f"{_POINT}, value double, temporality string, is_monotonic boolean, exemplars string",
    "metrics_sum": f"{_POINT}, value double, temporality string, is_monotonic boolean, exemplars string",
    "metrics_histogram": f"{_POINT}, count long, sum double, min double, max double, explicit_bounds array<double>, bucket_counts array<long>, temporality string, exemplars string",
    "metrics_exp_histogram": f"{_POINT}, count long, sum double, min double, max double, scale int, zero_count long, zero_threshold double, positive_offset int, positive_counts array<long>, negative_offset int, negative_counts array<long>, temporality string, exemplars string",
    "metrics_summary": f"{_POINT}, count long, sum double, quantiles array<double>, values array<double>, temporality string",
}
TABLES = tuple(DDL)
METRIC_TABLES = tuple(t for t in TABLES if t.startswith("metrics_"))
KINDS = {"metrics_gauge": "gauge", "metrics_sum": "sum", "metrics_histogram": "histogram", "metrics_exp_histogram": "exp_histogram", "metrics_summary": "summary"}


def columns(table: str) -> list[tuple[str, str]]:
    out, depth, at = [], 0, ""
    for c in DDL[table] + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = at.strip().partition(" ")
            out.append((name, kind))
            at = ""
        else:
            at += c
    return out


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


RESERVED = frozenset(name for t in TABLES for name, _ in columns(t)) | {"table", "day", "time", "start_time", "observed_time"}


def time_column(table: str) -> str:
    return "start_time_ns" if table == "spans" else "time_ns"


def promoted(keys: list[str]) -> list[str]:
    """The keys that become columns: not reserved, first occurrence only, in order."""
    return list(dict.fromkeys(k for k in keys if k not in RESERVED))


def coerce(df: DataFrame, table: str, promote: list[str] = ()) -> DataFrame:
    """df with the table's columns by name, absent ones null, and the promoted string columns."""
    have = set(df.columns)
    kinds = [*columns(table), *((k, "string") for k in promoted(list(promote)))]
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(k).alias(n) for n, k in kinds])
