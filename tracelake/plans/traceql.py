"""A bounded TraceQL: spansets, boolean and structural operators and count, evaluated over whole traces in one pass."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hex_lower
from ..operators.filters import checked_regex
from ..operators.traces import summaries
from ..operators.whole_traces import spansets
from ..sources.shared import materialized, spread
from .common import Cursor, EvalRange


@dataclass(frozen=True)
class Predicate:
    scope: str  # intrinsic, span, resource, instrumentation, event, link
    field: str
    op: str
    value: str | float | int | bool | None


@dataclass(frozen=True)
class Select:
    predicates: tuple[Predicate, ...]


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Structural:
    op: str  # > >> < << ~
    negated: bool
    union: bool
    left: object
    right: object


@dataclass(frozen=True)
class Count:
    inner: object
    op: str
    n: float


_STRUCTURAL = ("!>>", "!>", "!<<", "!<", "!~", "&!>>", "&!>", "&!~", "&>>", "&>", "&<<", "&<", "&~", ">>", ">", "<<", "<", "~")
#: Intrinsic fields and their other spellings.
_INTRINSICS = {
    "name": "name", "duration": "duration", "status": "status", "statusMessage": "statusMessage", "kind": "kind", "childCount": "childCount", "span:id": "span:id", "trace:id": "trace:id",
    "traceDuration": "traceDuration", "trace:duration": "traceDuration", "rootServiceName": "rootServiceName", "trace:rootService": "rootServiceName", "rootName": "rootName", "trace:rootName": "rootName",
    "span:name": "name", "span:duration": "duration", "span:status": "status", "span:statusMessage": "statusMessage", "span:kind": "kind", "span:childCount": "childCount",
}
_SCOPES = ("span", "resource", "instrumentation", "event", "link")
_COMPARE = ("=~", "!~", "!=", ">=", "<=", "=", ">", "<")


def _predicate(c: Cursor) -> Predicate:
    name = c.name() or c.fail("expected a field")
    if name in _INTRINSICS:
        scope, field = "intrinsic", _INTRINSICS[name]
    elif name.startswith(".") and len(name) > 1:
        scope, field = "span", name[1:]
    elif (head := name.partition("."))[0] in _SCOPES and head[2]:
        scope, field = head[0], head[2]
    else:
        c.fail(f"unknown field {name!r}", "Unsupported")
    op = c.take(*_COMPARE) or c.fail("expected a comparison")
    if c.peek('"'):
        return Predicate(scope, field, op, c.string())
    if field in ("duration", "traceDuration") and (d := c.try_duration()) is not None:
        return Predicate(scope, field, op, d)
    c.skip()
    if c.at < len(c.text) and (c.text[c.at].isdigit() or c.text[c.at] in "+-"):
        n = c.number()
        return Predicate(scope, field, op, int(n) if n.is_integer() else n)
    word = c.name() or c.fail("expected a value")
    return Predicate(scope, field, op, {"nil": None, "true": True, "false": False}.get(word, word))


def _primary(c: Cursor):
    c.nest()
    if c.take("("):
        inner = _or(c)
        c.expect(")")
        c.depth -= 1
        return inner
    c.expect("{")
    predicates = []
    while not c.take("}"):
        predicates.append(_predicate(c))
        if not c.peek("}"):
            c.expect("&&")
    c.depth -= 1
    return Select(tuple(predicates))


def _structural(c: Cursor):
    left = _primary(c)
    while not c.peek("&&") and (op := c.take(*_STRUCTURAL)):
        plain = op.lstrip("&!")
        left = Structural(plain, "!" in op, op[0] == "&", left, _primary(c))
    return left


def _and(c: Cursor):
    left = _structural(c)
    while c.take("&&"):
        left = Both(left, _structural(c))
    return left


def _or(c: Cursor):
    left = _and(c)
    while c.take("||"):
        left = Either(left, _and(c))
    return left


def parse(text: str):
    c = Cursor(text)
    out = _or(c)
    if c.take("|"):
        c.expect("count")
        c.expect("(")
        c.expect(")")
        out = Count(out, c.take(">=", "<=", "!=", "=", ">", "<") or c.fail("expected a comparison"), c.number())
    c.end()
    return out


def _text_test(text: Column, op: str, value) -> Column:
    """A comparison of a string field; other types of value differ from every string."""
    if value is None:
        return text.isNull() if op == "=" else F.lit(False)
    if not isinstance(value, str):
        return text.isNotNull() & F.lit(op == "!=")
    if op in ("=~", "!~"):
        test = text.rlike(f"^(?:{checked_regex(value)})$")
        test = ~test if op == "!~" else test
    else:
        test = {"=": text == value, "!=": text != value, ">": text > value, ">=": text >= value, "<": text < value, "<=": text <= value}[op]
    return F.coalesce(test, F.lit(False))


def _number_test(number: Column, op: str, value) -> Column:
    if value is None:
        return number.isNull() if op == "=" else F.lit(False)
    if isinstance(value, bool | str):
        return number.isNotNull() & F.lit(op == "!=")
    if op in ("=~", "!~"):
        return F.lit(False)
    v = F.lit(value)
    test = {"=": number == v, "!=": number != v, ">": number > v, ">=": number >= v, "<": number < v, "<=": number <= v}[op]
    nan = F.isnan(number.cast("double"))
    return F.coalesce(F.when(nan, F.lit(op == "!=")).otherwise(test), F.lit(False))


def _variant_test(v: Column, op: str, value) -> Column:
    """A comparison of a JSON value: numbers coerce, other mixes are unequal; arrays ask for any element, or for none with != and !~."""
    kind = F.schema_of_variant(v)
    if value is None:
        return (v.isNull() | F.coalesce(kind == "VOID", F.lit(False))) if op == "=" else F.lit(False)
    missing = v.isNull() | (kind == "VOID")

    def scalar(x: Column, op: str) -> Column:
        k = F.schema_of_variant(x)
        text, number = F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "double")
        is_text, is_number, is_bool = k == "STRING", k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), k == "BOOLEAN"
        other = F.lit(op == "!=")
        if isinstance(value, bool):
            truth = F.try_variant_get(x, "$", "boolean")
            return F.when(is_bool, (truth == value) if op == "=" else (truth != value) if op == "!=" else F.lit(False)).otherwise(other)
        if isinstance(value, str):
            return F.when(is_text, _text_test(text, op, value)).otherwise(other if op not in ("=~", "!~") else F.lit(False))
        return F.when(is_number, _number_test(number, op, value)).otherwise(other)

    items = F.try_variant_get(v, "$", "array<variant>")
    positive = {"!=": "=", "!~": "=~"}.get(op, op)
    any_ = F.exists(items, lambda x: F.coalesce(scalar(x, positive), F.lit(False)))
    of_array = ~any_ if op in ("!=", "!~") else any_
    return F.coalesce(F.when(missing, F.lit(False)).when(kind.startswith("ARRAY"), of_array).otherwise(scalar(v, op)), F.lit(False))


def _member(json_text: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json_text), "$[" + json.dumps(key) + "]", "variant")


def _items_test(json_text: Column, p: Predicate) -> Column:
    """Whether any event or link, with its own fields and its attributes in one namespace, meets the predicate."""
    items = F.try_variant_get(F.try_parse_json(json_text), "$", "array<variant>")
    path = "$[" + json.dumps(p.field) + "]"

    def one(x: Column) -> Column:
        own = F.coalesce(F.try_variant_get(x, path, "variant"), F.try_variant_get(F.try_variant_get(x, "$.attributes", "variant"), path, "variant"))
        return _variant_test(own, p.op, p.value)

    return F.coalesce(F.exists(items, one), F.lit(False))


class Compiler:
    """Spans are the complete traces to search; leaves are the selections of a query, in order of their names."""

    def __init__(self, spans: DataFrame):
        self.spans = spans
        self.leaves: list[Select] = []

    def plan(self, e) -> tuple:
        """The query as tuples, each selection by its number."""
        if isinstance(e, Select):
            if e not in self.leaves:
                self.leaves.append(e)
            return "select", self.leaves.index(e)
        if isinstance(e, Count):
            return "count", self.plan(e.inner), e.op, e.n
        if isinstance(e, Structural):
            return "structural", self.plan(e.left), self.plan(e.right), e.op, e.negated, e.union
        return "either" if isinstance(e, Either) else "both", self.plan(e.left), self.plan(e.right)

    def rows(self, *leaves: Select) -> DataFrame:
        """The spans with what predicates of these selections ask for beside the span itself."""
        rows = self.spans
        fields = {p.field for s in leaves for p in s.predicates if p.scope == "intrinsic"}
        if "childCount" in fields:
            children = self.spans.where("parent_span_id is not null").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("_children"))
            rows = rows.join(children, ["trace_id", "span_id"], "left").withColumn("_children", F.coalesce("_children", F.lit(0)))
        if fields & {"traceDuration", "rootServiceName", "rootName"}:
            whole = summaries(self.spans).select("trace_id", F.col("duration_ns").alias("_trace"), F.col("root_name").alias("_root"), F.col("root_service").alias("_root_service"))
            rows = rows.join(whole, "trace_id")
        return rows

    def test(self, s: Select, of_span: bool = False) -> Column:
        """Whether a row of rows() meets the selection; of_span leaves predicates on the whole trace or on children out."""
        out = F.lit(True)
        for p in s.predicates:
            if not (of_span and p.scope == "intrinsic" and p.field in ("childCount", "traceDuration", "rootServiceName", "rootName")):
                out &= self._test(p)
        return F.coalesce(out, F.lit(False))

    def _test(self, p: Predicate) -> Column:
        if p.scope == "intrinsic":
            if p.field in ("duration", "childCount", "traceDuration"):
                return _number_test(F.col({"duration": "duration_ns", "childCount": "_children", "traceDuration": "_trace"}[p.field]), p.op, p.value)
            text = {"name": "name", "status": "status_code", "statusMessage": "status_message", "kind": "kind", "rootServiceName": "_root_service", "rootName": "_root"}
            return _text_test(F.col(text[p.field]) if p.field in text else hex_lower(F.col(p.field.replace(":", "_"))), p.op, p.value)
        if p.scope == "resource" and p.field in ("service.name", "service"):
            return _text_test(F.col("service"), p.op, p.value)
        if p.scope in ("event", "link"):
            return _items_test(F.col(f"{p.scope}s"), p)
        return _variant_test(_member(F.col({"span": "attributes", "resource": "resource", "instrumentation": "scope"}[p.scope]), p.field), p.op, p.value)

    def evaluate(self, e) -> DataFrame:
        """(trace_id, start_time_ns, latest, span_ids): one pass that marks each span with the selections it meets and brings traces together."""
        plan = self.plan(e)
        rows = self.rows(*self.leaves).where("trace_id is not null")
        related = ["parent_span_id"] if _relates(e) else []
        rows = rows.select("trace_id", "span_id", *related, "start_time_ns", *[self.test(s).alias(f"_leaf{i}") for i, s in enumerate(self.leaves)])
        found = spread(rows, "trace_id").sortWithinPartitions("trace_id").mapInArrow(spansets(plan, len(self.leaves)), "trace_id binary, start_time_ns long, latest long, span_ids array<binary>")
        found = materialized(found)  # sorting samples its input, which would evaluate twice
        if found.where("span_ids is null").limit(1).count():
            raise ValueError("malformed trace: span parents form a cycle")
        return found.withColumn("span_ids", F.array_sort(F.transform("span_ids", hex_lower)))


def _relates(e) -> bool:
    return isinstance(e, Structural) or any(_relates(x) for x in vars(e).values() if isinstance(x, Both | Either | Count | Structural))


#: With at most so many traces that can have a result, only their spans are brought together.
MOST_CANDIDATES = 100_000


def _candidates(e, spans: DataFrame) -> DataFrame:
    """Ids of traces that can have a result: each leaf that must match has a span that passes its own predicates, by one pass.

    Predicates on the whole trace or on children are left to the evaluation.
    """
    c = Compiler(spans)

    def can(p: tuple) -> Column:
        if p[0] == "select":
            return F.col(f"_leaf{p[1]}")
        if p[0] == "count":
            return can(p[1])  # only traces with matches are counted
        left, right = can(p[1]), can(p[2])
        if p[0] == "either" or p[0] == "structural" and p[5]:
            return left | right
        return right if p[0] == "structural" and p[4] else left & right

    wanted = can(c.plan(e))
    names = [f"_leaf{i}" for i in range(len(c.leaves))]
    rows = spans.where(functools.reduce(lambda a, b: a | b, [c.test(s, True) for s in c.leaves]))
    marked = rows.select("trace_id", *[c.test(s, True).alias(n) for n, s in zip(names, c.leaves, strict=True)])
    return marked.groupBy("trace_id").agg(*[F.max(n).alias(n) for n in names]).where(wanted).select("trace_id")


def traceql(text: str, spans: DataFrame, span: EvalRange | None = None, limit: int | None = None) -> DataFrame:
    """(trace_id hex, start_time_ns, span_ids) of the traces that start in the range and have a selected span, newest first."""
    query = parse(text)
    inside = spans
    if span:
        # a trace that starts in the range has a span in it; that it starts there is checked below
        bounds = (F.col("start_time_ns") >= F.lit(span.start).cast("long")) & (F.col("start_time_ns") <= F.lit(span.end).cast("long"))
        inside = spans.join(spans.where(bounds).select("trace_id").distinct(), "trace_id", "left_semi")
    few = materialized(_candidates(query, inside))
    if few.count() <= MOST_CANDIDATES:
        inside = inside.join(F.broadcast(few), "trace_id", "left_semi")
    out = Compiler(inside).evaluate(query)
    if span:
        out = out.where(bounds)
    out = out.orderBy(F.col("latest").desc(), "trace_id")
    out = out if limit is None else out.limit(limit)
    return out.select(hex_lower(F.col("trace_id")).alias("trace_id"), "start_time_ns", "span_ids")
