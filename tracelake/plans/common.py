"""Cursor, evaluation range and window plan shared by the languages."""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNITS


class Diagnostic(ValueError):
    """kind: Syntax, Unsupported, NeedsResolution or SemanticMismatch; at: the place in the text."""

    def __init__(self, kind: str, message: str, at: int):
        super().__init__(f"{kind} at {at}: {message}")
        self.kind, self.at = kind, at


class LimitExceeded(ValueError):
    pass


#: Default limits of an evaluation.
MOST_POINTS, MOST_DEPTH, INSTANT_LOOKBACK = 11_000, 128, 300_000_000_000


@dataclass(frozen=True)
class EvalRange:
    """Instants start, start + step .. up to end, in nanoseconds."""

    start: int
    end: int
    step: int
    lookback: int = INSTANT_LOOKBACK

    def __post_init__(self):
        if self.end < self.start or self.step <= 0:
            raise ValueError("an evaluation range needs start <= end and a positive step")
        if self.points > MOST_POINTS:
            raise LimitExceeded(f"more than {MOST_POINTS} points")

    @classmethod
    def instant(cls, at: int) -> EvalRange:
        return cls(at, at, 1)

    @property
    def points(self) -> int:
        return (self.end - self.start) // self.step + 1

    def instants_of(self, ns: Column, window: int) -> Column:
        """The instants whose left-open, right-closed window holds a sample: an array to explode, so that windows
        are an equi-grouping and never a theta join."""
        start, step, last = F.lit(self.start).cast("long"), F.lit(self.step).cast("long"), F.lit(self.points - 1).cast("long")
        first = F.greatest(F.lit(0).cast("long"), _div(ns - start + step - 1, step))
        final = F.least(last, _div(ns + F.lit(window).cast("long") - 1 - start, step))
        return F.when(first <= final, F.transform(F.sequence(first, final), lambda k: start + k * step)).otherwise(F.array().cast("array<bigint>"))


    def pane_of(self, ns: Column, window: int) -> Column:
        """The end of the pane that holds a sample.  Panes are as wide as the greatest common divisor of step and window,
        so every sample of a pane is in the same windows: aggregate by pane first, then explode panes to instants."""
        width = gcd(self.step, window)
        start, w = F.lit(self.start).cast("long"), F.lit(width).cast("long")
        return start + _div(ns - start + w - 1, w) * w


def _div(a: Column, b: Column) -> Column:
    """Floored integer division of longs, exact beyond 2**53."""
    return F.call_function("div", a - F.pmod(a, b), b)


def required(test: Column, kind: str, message: str, value: Column) -> Column:
    """value where test holds; else the query fails when it runs, without a job of its own to find out."""
    return F.when(F.coalesce(test, F.lit(False)), value).otherwise(F.raise_error(F.lit(f"{kind}: {message}")).cast("long"))


class Cursor:
    """A text read from left to right; white space before tokens is skipped."""

    _name = re.compile(r"[A-Za-z0-9_:.\-]+")
    _duration = re.compile(r"(?:\d+(?:ns|us|µs|ms|s|m|h|d))+")
    _number = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|inf|Inf|NaN)")

    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0

    def skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def fail(self, message: str, kind: str = "Syntax"):
        raise Diagnostic(kind, message, self.at)

    def peek(self, token: str) -> bool:
        self.skip()
        return self.text.startswith(token, self.at)

    def take(self, *tokens: str) -> str | None:
        self.skip()
        for t in tokens:
            if self.text.startswith(t, self.at):
                self.at += len(t)
                return t
        return None

    def expect(self, token: str) -> None:
        if not self.take(token):
            self.fail(f"expected {token!r}")

    def _match(self, pattern: re.Pattern) -> str | None:
        self.skip()
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
            return m[0]
        return None

    def name(self) -> str | None:
        return self._match(self._name)

    def keyword(self, *words: str) -> str | None:
        """One of the words, if it is the whole next name."""
        back = self.at
        if (found := self.name()) in words:
            return found
        self.at = back
        return None

    def duration(self) -> int:
        text = self._match(self._duration)
        if not text:
            self.fail("expected a duration")
        return sum(int(n) * UNITS[u.replace("µ", "u")] for n, u in re.findall(r"(\d+)(ns|us|µs|ms|s|m|h|d)", text))

    def try_duration(self) -> int | None:
        back = self.at
        try:
            return self.duration()
        except Diagnostic:
            self.at = back
            return None

    def number(self) -> float:
        text = self._match(self._number)
        if text is None:
            self.fail("expected a number")
        return float(text)

    def string(self) -> str:
        self.expect('"')
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == '"':
                return "".join(out)
            if c == "\\":
                e = self.text[self.at : self.at + 1]
                if e not in ('"', "\\", "n", "r", "t"):
                    self.fail("unknown escape")
                out.append({"n": "\n", "r": "\r", "t": "\t"}.get(e, e))
                self.at += 1
            else:
                out.append(c)
        self.fail("string does not end")

    def nest(self) -> None:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise LimitExceeded("expression is nested too deeply")

    def end(self) -> None:
        self.skip()
        if self.at < len(self.text):
            self.fail("unsupported construct after the expression", "Unsupported")


def labels_of(df: DataFrame, name: bool) -> Column:
    """Sorted label map of a row: service, __name__ and every string attribute; attributes win."""
    from ..functions.jsonattr import string_map

    own = [F.struct(F.lit("service").alias("key"), F.col("service").alias("value"))]
    own += [F.struct(F.lit("__name__").alias("key"), F.col("metric").alias("value"))] if name else []
    fixed = F.filter(F.array(*own), lambda x: x["value"].isNotNull())
    attributes = F.map_entries(F.coalesce(string_map(F.col("attributes")), F.create_map().cast("map<string,string>")))
    kept = F.filter(fixed, lambda x: ~F.exists(attributes, lambda a: a["key"] == x["key"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, attributes)))


def subset(labels: Column, keys: list[str], without: bool = False) -> Column:
    """The labels to group by; __name__ is never one."""
    if without:
        return F.map_filter(labels, lambda k, v: ~k.isin(*keys, "__name__"))
    return F.map_filter(labels, lambda k, v: k.isin(*keys) if keys else F.lit(False))


def sorted_map(labels: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(labels)))


def matcher(text: Column, op: str, value: str) -> Column:
    """A label matcher: regular expressions are anchored, a missing label reads ''."""
    from ..operators.filters import checked_regex

    text = F.coalesce(text, F.lit(""))
    test = text == value if op in ("=", "!=") else text.rlike(f"^(?:{checked_regex(value)})$")
    return ~test if op.startswith("!") else test


def read_matchers(c: Cursor) -> list[tuple[str, str, str]]:
    out = []
    c.expect("{")
    if c.take("}"):
        return out
    while True:
        label = c.name() or c.fail("expected a label")
        op = c.take("=~", "!~", "!=", "=") or c.fail("expected a matcher")
        out.append((label, op, c.string()))
        if c.take("}"):
            return out
        c.expect(",")
