"""Benchmark decontamination by winnowing (operator 3).

DataFrame functions only.  From each run of ``n - k + 1`` consecutive k-word
grams of a document, the one whose first word has the smallest hash, the
leftmost of equals, is kept as a fingerprint with its place, so every span of
n words has one that depends on the span's words alone, and only the grams
kept are hashed whole.  Each n-word window of a benchmark item is indexed
under its own fingerprint.  Documents' fingerprints are joined with the index,
and each hit is extended to the full window and compared word for word, so the
result is exact: all windows are found, and none that only share a hash.

Items of fewer than n words are one window each.  They are looked up under
their first word, at every place of a document that has one of those words.

One pass over all texts counts the words and leaves the rows that hit; only
texts with a hit are then read again, by doc_id and text hash, where those are
counted beforehand: at most ``broadcast_texts`` are broadcast, more are joined
by shuffle.  The index is broadcast when the benchmark, counted beforehand, has
at most ``broadcast_windows`` windows, else joined by shuffle.

Defined cases: null or empty text has no words and is clean; an empty or null
item has no window; a null item_id is not listed; equal rows get equal
results, one each; an empty benchmark leaves all documents clean; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import few, stored

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII: lower() changes A-Z alone, and costs less
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _BETWEEN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(last: Column) -> Column:
    """1 .. last, or nothing."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _less(values: Column, many: int) -> Column:
    """values without the last many."""
    return F.slice(values, 1, F.greatest(F.size(values) - many, F.lit(0)))


def fingerprints(w: Column, n: int, k: int) -> Column:
    """array<struct<p,h>>: of each run of n-k+1 grams the leftmost with the smallest hash of its first word, once each."""
    run = n - k + 1
    ranks = F.transform(_less(w, k - 1), lambda x, i: F.shiftleft(F.hash(x).cast("long"), 32) + i)  # the place breaks ties

    def pick(r: Column) -> Column:
        least = F.transform(_less(r, run - 1), lambda x, i: F.least(x, *[F.get(r, i + j) for j in range(1, run)])) if run > 1 else r
        at = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.transform(F.array_distinct(least), lambda x: F.struct((at(x) + 1).alias("p"), F.xxhash64(*[F.get(w, at(x) + j) for j in range(k)]).alias("h")))

    return let(ranks, pick)


def benchmark_windows(bench: DataFrame, n: int) -> DataFrame:
    """(item_id, len, window): the distinct windows of each item, as arrays of words."""
    w = bench.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    starts = F.when(F.size("w") >= n, _upto(F.size("w") - (n - 1))).otherwise(_upto(F.least(F.size("w"), F.lit(1))))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, n))).alias("window")).select("item_id", F.size("window").alias("len"), "window").distinct()


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10, k: int = 5, broadcast_windows: int = 200_000, broadcast_texts: int = 200_000) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items (sorted as strings) of every document."""
    windows = stored(benchmark_windows(bench, n))
    lengths = {r["len"]: r["many"] for r in windows.groupBy("len").agg(F.count("*").alias("many")).collect()}  # n rows at most
    hint = F.broadcast if sum(lengths.values()) <= broadcast_windows else (lambda x: x)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    none = F.array().cast("array<string>")
    if not lengths:
        zero = F.lit(0).cast("long")
        return source.select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("long").alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), none.alias("items"))
    full = windows.where(F.col("len") == n).select(F.explode(fingerprints(F.col("window"), n, k)).alias("f"))
    full = full.select(F.col("f.h").alias("i_h"), (F.col("f.p") - 1).alias("offset"), F.lit(n).alias("len"))
    heads = windows.where(F.col("len") < n).select(F.xxhash64(F.element_at("window", 1)).alias("i_h"), F.lit(0).alias("offset"), "len")
    index = full.unionByName(heads).distinct()

    def places(w: Column) -> Column:
        """array<struct<p,h>>: first minus the number of words, under a hash that spreads the rows; then what is looked up."""
        out = [F.array(F.struct((-F.size(w)).alias("p"), F.xxhash64("doc_id", "text_hash").alias("h")))]
        if n in lengths:
            out.append(fingerprints(w, n, k))
        if any(x < n for x in lengths):
            out.append(F.transform(w, lambda x, i: F.struct((i + 1).alias("p"), F.xxhash64(x).alias("h"))))
        return F.concat(*out)

    own = source.select("doc_id", "text_hash", let(words(F.col("text")), places).alias("places"))  # outer: no filter is inferred that computes them again
    own = own.select("doc_id", "text_hash", F.explode_outer("places").alias("f")).select("doc_id", "text_hash", "f.p", "f.h")
    seen = own.join(hint(index), (F.col("p") > 0) & (F.col("h") == F.col("i_h")), "left").select("doc_id", "text_hash", "p", (F.col("p") - F.col("offset")).alias("s"), "len")
    seen = stored(seen.where("p <= 0 or s >= 1"))
    stats = seen.where("p <= 0").select("doc_id", "text_hash", (-F.col("p")).cast("long").alias("n_words"))
    candidates = seen.where("p > 0").groupBy(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).agg(F.collect_set(F.struct("s", "len")).alias("ats"))
    candidates = stored(candidates)
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))
    texts = source.join(few(candidates.select("c_id", "c_hash"), broadcast_texts), same, "left_semi").join(candidates, same)
    at = let(words(F.col("text")), lambda w: F.transform("ats", lambda a: F.struct(a["s"].alias("s"), a["len"].alias("len"), F.slice(w, a["s"], a["len"]).alias("words"))))
    spans = texts.select("doc_id", "text_hash", F.explode(at).alias("x"))
    spans = spans.where(F.size("x.words") == F.col("x.len"))  # a span that ends with its text is no short item
    exact = spans.join(hint(windows.select("item_id", "window")), F.col("x.words") == F.col("window"))

    def cover(state: Column, x: Column) -> Column:
        last = x["s"] + x["len"]
        more = F.greatest(last - F.greatest(state["last"], x["s"]), F.lit(0))
        return F.struct(F.greatest(state["last"], last).alias("last"), (state["n"] + more).alias("n"))

    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("n"))
    hit = exact.groupBy(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash")).agg(
        F.sort_array(F.collect_set(F.struct("x.s", "x.len"))).alias("covers"), F.sort_array(F.collect_set("item_id")).alias("items")
    )
    hit = hit.select("h_id", "h_hash", F.aggregate("covers", start, cover)["n"].alias("n_hit"), "items")
    out = stats.join(hit, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
    items = F.coalesce("items", none)
    return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
