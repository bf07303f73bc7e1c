"""Predicates shared by the typed queries, as Columns that push down where Spark can push them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_get_num, json_get_str, matches

LOOKAROUND = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?>|[*+?}]\+")


def checked_regex(pattern: str) -> str:
    """Patterns of the linear-time dialect only: no look-around, back-references or possessive quantifiers."""
    if LOOKAROUND.search(pattern):
        raise ValueError(f"unsupported regular expression: {pattern!r}")
    re.compile(pattern)
    return pattern


def attr_field(df: DataFrame, key: str, source: str = "attributes") -> Column:
    """An attribute as a string: the service column, a promoted column with the JSON behind it, or the JSON."""
    if key in ("service", "service.name") and source == "attributes":
        return F.col("service")
    from_json = json_get_str(F.col(source), key)
    if source == "attributes" and key in df.columns:
        return F.coalesce(F.col(f"`{key}`"), from_json)
    return from_json


def bucket(ns: Column, step: int) -> Column:
    """The bucket's start, by division that truncates toward zero."""
    step = F.lit(max(1, step)).cast("long")
    return ns - ns % step


def time_range(ns: Column, start: int | None, end: int | None, inclusive: bool = False) -> list[Column]:
    """Half-open unless inclusive; an unbounded side makes no predicate, so the bare column can be pushed down."""
    out = [] if start is None else [ns >= F.lit(start).cast("long")]
    if end is not None:
        out.append(ns <= F.lit(end).cast("long") if inclusive else ns < F.lit(end).cast("long"))
    return out


_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


@dataclass(frozen=True)
class Filtered:
    """A table with collected predicates."""

    df: DataFrame
    predicates: tuple[Column, ...] = ()
    time: str = field(default="time_ns", kw_only=True)

    def where(self, *predicates: Column):
        return replace(self, predicates=(*self.predicates, *predicates))

    def rows(self) -> DataFrame:
        out = self.df
        for p in self.predicates:
            out = out.where(p)
        return out

    def attr(self, key: str, source: str = "attributes") -> Column:
        return attr_field(self.df, key, source)

    def range(self, start: int | None = None, end: int | None = None):
        return self.where(*time_range(F.col(self.time), start, end))

    def range_inclusive(self, start: int | None = None, end: int | None = None):
        return self.where(*time_range(F.col(self.time), start, end, True))

    def since(self, duration: int, now: int):
        return self.range(now - duration, now + 1)

    def match_none(self):
        return self.where(F.lit(False))

    def service(self, name: str):
        return self.where(F.col("service") == name)

    def attr_eq(self, key: str, value: str):
        return self.where(self.attr(key) == value)

    def attr_exists(self, key: str):
        return self.where(self.attr(key).isNotNull())

    def attr_matches(self, key: str, query: str):
        return self.where(matches(self.attr(key), query))

    def attr_in(self, key: str, values: list[str]):
        return self.where(self.attr(key).isin(list(values)) if values else F.lit(False))

    def attr_not_in(self, key: str, values: list[str]):
        return self.where(self.attr(key).isNull() | ~self.attr(key).isin(list(values))) if values else self

    def attr_compare(self, key: str, op: str, value: float):
        return self.where(_COMPARE[op](json_get_num(F.col("attributes"), key), F.lit(float(value))))

    def attr_regex(self, key: str, pattern: str):
        return self.where(self.attr(key).rlike(checked_regex(pattern)))

    def label(self, key: str, op: str, value: str):
        """= != =~ !~ on a label that reads '' when it is missing; regular expressions are unanchored."""
        text = F.coalesce(self.attr(key), F.lit(""))
        test = text == value if op in ("=", "!=") else text.rlike(checked_regex(value))
        return self.where(~test if op in ("!=", "!~") else test)
