"""A bounded LogQL: line queries, count_over_time and rate, and sum by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matches
from ..operators.filters import attr_field, checked_regex
from .common import Cursor, EvalRange, matcher, read_matchers, sorted_map, subset

#: Streams by service only, unless a caller maps other labels.
SERVICE_ONLY = {"service": ("service", "")}


@dataclass(frozen=True)
class Lines:
    matchers: tuple[tuple[str, str, str], ...]
    filters: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Over:
    function: str
    lines: Lines
    window: int
    offset: int
    keys: tuple[str, ...] | None


def _lines(c: Cursor) -> Lines:
    matchers = tuple(read_matchers(c)) if c.peek("{") else ()
    filters = []
    while op := c.take("|=", "|~", "|?", "!=", "!~", "!?"):
        filters.append((op, c.string()))
    if c.peek("|"):
        c.fail("parser stages are not supported", "Unsupported")
    return Lines(matchers, tuple(filters))


def parse(text: str) -> Lines | Over:
    c = Cursor(text)
    if c.peek("{") or c.peek("|") or c.peek("!"):
        out: Lines | Over = _lines(c)
    else:
        keys = None
        if grouped := c.keyword("sum"):
            if not c.keyword("by"):
                c.fail("only sum by (...) is supported", "Unsupported")
            c.expect("(")
            names = []
            while not c.take(")"):
                names.append(c.name() or c.fail("expected a label"))
                if not c.peek(")"):
                    c.expect(",")
            keys = tuple(names)
            c.expect("(")
        function = c.keyword("count_over_time", "rate") or c.fail("expected count_over_time or rate", "Unsupported")
        c.expect("(")
        lines = _lines(c)
        c.expect("[")
        window = c.duration()
        c.expect("]")
        offset = c.duration() if c.keyword("offset") else 0
        c.expect(")")
        if grouped:
            c.expect(")")
        out = Over(function, lines, window, offset, keys)
    c.end()
    return out


def line_filter(line: Column, op: str, value: str) -> Column:
    kind = op[1]
    test = F.contains(line, F.lit(value)) if op in ("|=", "!=") else line.rlike(checked_regex(value)) if kind == "~" else matches(line, value)
    return ~test if op[0] == "!" else test


def _selected(lines: Lines, logs: DataFrame, streams: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with their stream labels; a label that no stream has is '' for all rows."""
    if any(not k for k in streams):
        raise ValueError("stream labels need names")
    source = {"service": lambda k: F.col("service"), "attribute": lambda k: attr_field(logs, k), "resource": lambda k: attr_field(logs, k, "resource")}
    columns = {label: source[kind](key) for label, (kind, key) in streams.items()}
    rows = logs
    for label, op, value in lines.matchers:
        rows = rows.where(matcher(columns.get(label, F.lit("")), op, value))
    for op, value in lines.filters:
        rows = rows.where(line_filter(F.col("body"), op, value))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in sorted(columns.items())])
    return rows.withColumn("labels", F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())))


def logql(text: str, logs: DataFrame, span: EvalRange | None = None, streams: dict[str, tuple[str, str]] | None = None, limit: int | None = 100) -> DataFrame:
    """Lines (newest first) of a line query, or (labels, at, value) of a metric query over span."""
    query = parse(text)
    streams = SERVICE_ONLY if streams is None else streams
    if isinstance(query, Lines):
        rows = _selected(query, logs, streams)
        if span:
            rows = rows.where((F.col("time_ns") >= F.lit(span.start).cast("long")) & (F.col("time_ns") <= F.lit(span.end).cast("long")))
        out = rows.select("time_ns", "labels", "body").orderBy(F.col("time_ns").desc(), "body")
        return out if limit is None else out.limit(limit)
    if span is None:
        raise ValueError("a metric query needs an evaluation range")
    low, high = span.start - query.offset - query.window, span.end - query.offset
    rows = _selected(query.lines, logs.where((F.col("time_ns") >= F.lit(low).cast("long")) & (F.col("time_ns") <= F.lit(high).cast("long"))), streams)
    labels = F.col("labels") if query.keys is None else sorted_map(subset(F.col("labels"), list(query.keys)))
    shifted = F.col("time_ns") + F.lit(query.offset).cast("long")
    panes = rows.select(labels.alias("labels"), span.pane_of(shifted, query.window).alias("pane")).groupBy("labels", "pane").agg(F.count("*").alias("n"))
    counted = panes.select("labels", "n", F.explode(span.instants_of(F.col("pane"), query.window)).alias("at")).groupBy("labels", "at").agg(F.sum("n").alias("n"))
    value = F.col("n") / (query.window / 1e9) if query.function == "rate" else F.col("n").cast("double")
    return counted.select("labels", "at", value.alias("value"))
