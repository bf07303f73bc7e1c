"""Log queries: search, count and volume."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matches
from .filters import Filtered, bucket, checked_regex


@dataclass(frozen=True)
class LogQuery(Filtered):
    """Predicates over the table logs; newest first, 100 rows unless told otherwise."""

    backward: bool = True
    by_observed: bool = False
    limit: int | None = 100
    offset: int = 0

    def _set(self, **kw):
        from dataclasses import replace

        return replace(self, **kw)

    def severity_at_least(self, number: int):
        return self.where(F.col("severity_number") >= number)

    def matches(self, query: str):
        return self.where(matches(F.col("body"), query))

    def trace_id(self, hex_id: str):
        return self.where(F.col("trace_id") == F.unhex(F.lit(hex_id)))

    def span_id(self, hex_id: str):
        return self.where(F.col("span_id") == F.unhex(F.lit(hex_id)))

    def observed_after(self, ns: int):
        return self.where(F.col("observed_time_ns") > F.lit(ns).cast("long"))

    def string_predicate(self, kind: str, op: str, value: str, key: str | None = None):
        """kind: body, service, attribute, resource; op: eq, ne, regex, not_regex, contains, not_contains, matches, not_matches."""
        column = {"body": lambda: F.col("body"), "service": lambda: F.col("service"), "attribute": lambda: self.attr(key), "resource": lambda: self.attr(key, "resource")}[kind]()
        text = F.coalesce(column, F.lit(""))
        plain = op.removeprefix("not_") if op != "ne" else "eq"
        test = {"eq": lambda: text == value, "regex": lambda: text.rlike(checked_regex(value)), "contains": lambda: F.contains(text, F.lit(value)), "matches": lambda: matches(column, value)}[plain]()
        return self.where(~test if op == "ne" or op.startswith("not_") else test)

    def forward(self):
        return self._set(backward=False)

    def order_observed(self):
        return self._set(by_observed=True)

    def page(self, limit: int | None, offset: int = 0):
        return self._set(limit=limit, offset=offset)

    def collect_rows(self) -> DataFrame:
        """The page, ordered by time (or arrival, nulls last) with all of identity as tiebreaker."""
        key = F.col("observed_time_ns" if self.by_observed else "time_ns")
        order = key.desc_nulls_last() if self.backward else key.asc_nulls_last()
        out = self.rows().orderBy(order, "service", "body", "attributes")
        out = out.offset(self.offset) if self.offset else out
        return out if self.limit is None else out.limit(self.limit)

    def next_offset(self, rows: int) -> int | None:
        """Where the next page begins; None when this one was not full."""
        return self.offset + rows if self.limit is not None and rows == self.limit else None

    def count(self) -> DataFrame:
        """The number of matching rows, whatever the page."""
        return self.rows().agg(F.count("*").alias("count"))

    def volume(self, step: int) -> DataFrame:
        return self.rows().groupBy(bucket(F.col(self.time), step).alias("bucket")).agg(F.count("*").alias("count"))

    def volume_by(self, step: int, *keys: str) -> DataFrame:
        """Rows per bucket and label values; a missing label reads '' after grouping."""
        labels = [self.attr(k).alias(k) for k in keys]
        grouped = self.rows().groupBy(bucket(F.col(self.time), step).alias("bucket"), *labels).agg(F.count("*").alias("count"))
        return grouped.select("bucket", *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(k) for k in keys], "count")
