"""Quantiles of histograms, as higher-order functions on their arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(counts: Column) -> Column:
    """Running sums of an array of doubles."""
    return F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0.0), lambda a, b: a + b))


def histogram_quantile(phi: Column, bounds: Column, counts: Column) -> Column:
    """Quantile of explicit buckets: bounds has one element less than counts.

    NaN for a NaN phi or no observations, -inf below 0, +inf above 1.  Values
    spread evenly inside a bucket; the first one begins at 0, or at its bound
    when that is negative; the last one gives the greatest bound.
    """
    phi = phi.cast("double")
    c = F.transform(counts, lambda x: x.cast("double"))
    n = F.size(bounds)

    def estimate(running: Column) -> Column:
        total = F.element_at(running, -1)
        rank = phi * total
        at = F.array_position(F.transform(running, lambda x: x >= rank), True).cast("int")
        upper = F.get(bounds, at - 1)
        lower = F.when(at == 1, F.least(F.get(bounds, F.lit(0)), F.lit(0.0))).otherwise(F.get(bounds, at - 2))
        own = F.get(c, at - 1)
        before = F.get(running, at - 1) - own
        inside = F.when(own == 0, upper).otherwise(lower + (upper - lower) * ((rank - before) / own))
        beyond = F.when(n == 0, F.lit(math.inf)).otherwise(F.get(bounds, n - 1))
        return F.when(total == 0, F.lit(math.nan)).when((at == 0) | (at > n), beyond).otherwise(inside)

    value = F.when(F.size(counts) == 0, F.lit(math.nan)).otherwise(_let(_running(c), estimate))
    out = F.when(F.isnan(phi), F.lit(math.nan)).when(phi < 0, F.lit(-math.inf)).when(phi > 1, F.lit(math.inf)).otherwise(value)
    return F.when(phi.isNotNull() & bounds.isNotNull() & counts.isNotNull(), out)


def exp_histogram_quantile(phi: Column, scale: Column, zero_count: Column, positive_offset: Column, positive_counts: Column, negative_offset: Column, negative_counts: Column) -> Column:
    """Quantile of a base-2 exponential histogram: negatives from the farthest, the zero bucket, then positives."""
    phi = phi.cast("double")
    base = F.pow(F.lit(2.0), -scale.cast("double"))

    def edge(i: Column) -> Column:
        return F.pow(F.lit(2.0), i.cast("double") * base)

    def cell(count: Column, low: Column, high: Column) -> Column:
        return F.struct(count.cast("double").alias("n"), low.cast("double").alias("low"), high.cast("double").alias("high"))

    negative = F.reverse(F.transform(negative_counts, lambda x, i: cell(x, -edge(negative_offset + i + 1), -edge(negative_offset + i))))
    zero = F.array(cell(zero_count, F.lit(0.0), F.lit(0.0)))
    positive = F.transform(positive_counts, lambda x, i: cell(x, edge(positive_offset + i), edge(positive_offset + i + 1)))

    def estimate(cells: Column) -> Column:
        total = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x["n"])
        rank = phi * total

        def walk(s: Column, x: Column) -> Column:
            inside = x["low"] + (x["high"] - x["low"]) * ((rank - s["seen"]) / x["n"])
            edge_ = F.when(F.abs(x["low"]) < math.inf, x["low"]).otherwise(x["high"])
            value = F.when(F.isnan(inside) | (F.abs(inside) == math.inf), edge_).otherwise(inside)
            hit = s["value"].isNull() & (x["n"] > 0) & (s["seen"] + x["n"] >= rank)
            return F.struct((s["seen"] + x["n"]).alias("seen"), F.when(hit, value).otherwise(s["value"]).alias("value"))

        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("value"))
        return F.when(total == 0, F.lit(math.nan)).otherwise(F.aggregate(cells, start, walk)["value"])

    cells = F.filter(F.concat(negative, zero, positive), lambda x: x["n"] > 0)
    return F.when(F.isnan(phi), F.lit(math.nan)).when(phi < 0, F.lit(-math.inf)).when(phi > 1, F.lit(math.inf)).otherwise(_let(cells, estimate))


def classic_histogram_quantile(phi: Column, buckets: Column) -> Column:
    """Quantile of cumulative buckets array<struct<le: double, n: double>>.

    Buckets are sorted and equal bounds added; there must be two and the last
    must be +Inf, else NaN.  Counts that fall are raised to the one before.
    """
    phi = phi.cast("double")
    ordered = F.array_sort(buckets)

    def joined(s: Column, x: Column) -> Column:
        same = (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["le"] == x["le"])
        added = F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(x["le"].alias("le"), (F.try_element_at(s, F.lit(-1))["n"] + x["n"]).alias("n"))))
        return F.when(same, added).otherwise(F.concat(s, F.array(F.struct(x["le"].alias("le"), x["n"].alias("n")))))

    empty = F.array().cast("array<struct<le:double,n:double>>")
    merged = F.aggregate(ordered, empty, joined)

    def repaired(b: Column) -> Column:
        return F.transform(b, lambda x, i: F.struct(x["le"].alias("le"), F.array_max(F.transform(F.slice(b, F.lit(1), i + 1), lambda y: y["n"])).alias("n")))

    def estimate(b: Column) -> Column:
        n = F.size(b)
        total = F.element_at(b, -1)["n"]
        rank = phi * total
        at = F.array_position(F.transform(F.slice(b, F.lit(1), n - 1), lambda x: x["n"] >= rank), True).cast("int")
        upper, lower = F.get(b, at - 1)["le"], F.when(at == 1, F.lit(0.0)).otherwise(F.get(b, at - 2)["le"])
        before = F.when(at == 1, F.lit(0.0)).otherwise(F.get(b, at - 2)["n"])
        own = F.get(b, at - 1)["n"] - before
        inside = F.when((at == 1) & (upper <= 0), upper).when(own == 0, lower).otherwise(lower + (upper - lower) * ((rank - before) / own))
        return F.when((total == 0) | F.isnan(total), F.lit(math.nan)).when(at == 0, F.get(b, n - 2)["le"]).otherwise(inside)

    ready = _let(merged, lambda b: F.when((F.size(b) < 2) | (F.element_at(b, -1)["le"] != math.inf), F.lit(math.nan)).otherwise(_let(repaired(b), estimate)))
    return F.when(F.isnan(phi), F.lit(math.nan)).when(phi < 0, F.lit(-math.inf)).when(phi > 1, F.lit(math.inf)).otherwise(F.when(F.size(buckets) == 0, F.lit(math.nan)).otherwise(ready))
