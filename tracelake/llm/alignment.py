"""Line dedup by pairwise alignment (operator 4).

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed.  A
document's link keys are the hashes of the shortest runs of lines, from each
line on, that have ``least_words`` words: a long line is a key by itself, short
lines, which are common, only together with what follows them.  Keys that
several documents hold tell which documents overlap.  A rare key, one that
occurs at most ``rare`` times in all, pairs each holder with every earlier one.
A frequent key pairs each holder with the key's earliest holder, so it gives
one pair fewer than it has holders, however many they are.  Every pair is
aligned by patience diff, and aligned common blocks of at least ``least_words``
words are deleted from the later document.

An alignment keeps the order of lines, so it leaves a block that was moved, and
a frequent key's holder is not aligned with all others.  What is left of that
kind goes by an exact step: a run of lines whose key an earlier document holds
is deleted where the alignments have not deleted it; ``n_moved`` counts its lines.
So of every run of ``least_words`` words one copy stays, the earliest holder's.

Earlier means the smaller doc_id (then text hash).  Blocks are compared with
the earlier document as it came, not with what is left of it.

Defined cases: null text has no lines and stays null; empty texts and lines
without words are never deleted; rows equal in doc_id and text are one
document and keep or lose the same lines; a null doc_id counts as smallest; an
empty table gives an empty result; other columns are carried unchanged, ones
named as the results are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._store import few, stored, unused
from .decontaminate import let


def _hashed(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, x in t.slices(batch.column("text"), t.SMALL):
                first, last = x.words()
                h = t.span_hash(t.prefix_hash(t.LOWER[x.data]), first, last)
                start, _ = x.lines()
                word_at = np.append(np.searchsorted(first, start), len(first))
                words = np.diff(word_at)
                line = t.span_hash(t.prefix_hash(h), word_at[:-1], word_at[1:])
                line_at = x.line_bounds()
                full = np.flatnonzero(words > 0)
                doc = t.owner(line_at)[full]
                place = full - line_at[:-1][doc]
                at = np.searchsorted(full, line_at)
                # the shortest run of full lines from each on that has enough words
                total = np.append(0, np.cumsum(words[full]))
                end = np.searchsorted(total, total[:-1] + least_words, side="left")
                enough = (end < len(total)) & (end <= at[1:][doc])
                own = np.flatnonzero(enough)
                key = t.span_hash(t.prefix_hash(line[full], 0x9E3779B97F4A7C15), own, end[own], 0x9E3779B97F4A7C15)
                key_at = np.append(0, np.cumsum(np.bincount(doc[own], minlength=x.n)))
                text_hash = t.span_hash(t.prefix_hash(x.data), x.offsets[:-1], x.offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array(t.as_long(text_hash)),
                        t.list_column(t.as_long(line[full]), at, pa.int64()), t.list_column(words[full].astype(np.int32), at, pa.int32()),
                        t.list_column(place.astype(np.int32), at, pa.int32()), t.list_column(t.as_long(key), key_at, pa.int64()),
                        t.list_column((own - at[:-1][doc[own]]).astype(np.int32), key_at, pa.int32()), t.list_column((end[own] - own).astype(np.int32), key_at, pa.int32()),
                    ],
                    ["doc_id", "text_hash", "lines", "words", "places", "keys", "first", "size"],
                )

    return run


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sub-list with rising second members, of pairs that rise in the first: patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(pile[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            pile.append(i)
        else:
            tops[k], pile[k] = y, i
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(one: list, two: list) -> list[tuple[int, int]]:
    """Matched places of two sequences by patience diff.

    Equal heads and tails match; between them, elements that are unique in
    both anchor the alignment and the gaps are aligned alike.  A gap without
    any is aligned by pairing the n-th occurrences of each element.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and one[a] == two[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        n, m = Counter(one[a:b]), Counter(two[c:d])
        at = {two[j]: j for j in range(c, d) if m[two[j]] == 1}
        anchors = _longest_rising([(i, at[one[i]]) for i in range(a, b) if n[one[i]] == 1 and one[i] in at])
        if not anchors:
            seen: Counter = Counter()
            nth = {}
            for j in range(c, d):
                nth[two[j], seen[two[j]]] = j
                seen[two[j]] += 1
            seen = Counter()
            pairs = []
            for i in range(a, b):
                if (key := (one[i], seen[one[i]])) in nth:
                    pairs.append((i, nth[key]))
                seen[one[i]] += 1
            found += _longest_rising(pairs)
            continue
        for i, j in anchors:
            todo.append((a, i, c, j))
            found.append((i, j))
            a, c = i + 1, j + 1
        todo.append((a, b, c, d))
    return sorted(found)


def common_blocks(later: list, earlier: list, words: list[int], least_words: int) -> list[int]:
    """Places of `later` inside aligned runs of at least least_words words."""
    out: list[int] = []
    run: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if run and sum(words[x] for x in run) >= least_words:
                out += run
            run = []
        run.append(i)
        before = (i, j)
    return out


def _aligned(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, deleted = [], []
            names = ("lines", "words", "places", "other")
            for i, (lines, words, places, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if out := common_blocks(lines, other, words, least_words):
                    ids.append(i)
                    deleted.append([places[x] for x in out])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), batch.column("text_hash").take(pa.array(ids, pa.int64())), pa.array(deleted, pa.list_(pa.int32()))], ["doc_id", "text_hash", "places"])

    return run


def _text_hash(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in t.slices(batch.column("text"), t.SMALL):
                h = t.span_hash(t.prefix_hash(x.data), x.offsets[:-1], x.offsets[1:])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in batch.schema.names), pa.array(t.as_long(h))], [*batch.schema.names, name])

    return run


def deleted_lines(docs: DataFrame, least_words: int = 20, rare: int = 8, hot_pairs: int = 1000, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, places, n_partners, n_moved): the lines to delete, counted from 0, of each document that loses some."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, text_hash long, lines array<long>, words array<int>, places array<int>, keys array<long>, first array<int>, size array<int>"
    hashed = stored(texts.mapInArrow(_hashed(least_words), kinds).where(F.size("lines") > 0).dropDuplicates(["doc_id", "text_hash"]).withColumn("id", F.struct("doc_id", "text_hash")))
    keys = hashed.select("id", F.explode(F.arrays_zip("keys", "first", "size")).alias("x")).select("id", F.col("x.keys").alias("key"), "x.first", "x.size")
    shared = keys.groupBy("key").agg(F.min("id").alias("earliest"), F.max("id").alias("latest"), F.count("*").alias("occurs")).where("earliest <> latest").drop("latest")
    held = stored(keys.join(shared, "key"))
    # rare keys: every two holders; frequent ones: each holder with the earliest
    holders = held.where(F.col("occurs") <= rare).groupBy("key").agg(F.collect_set("id").alias("ids"))
    every = holders.select("ids", F.explode("ids").alias("id")).select("id", F.explode("ids").alias("earlier")).where("earlier < id")
    first = held.where((F.col("occurs") > rare) & (F.col("id") != F.col("earliest"))).select("id", F.col("earliest").alias("earlier"))
    pairs = stored(every.unionByName(first).distinct())
    # a document that is the earlier one of very many pairs is copied for each `hot_pairs` of them
    hot = pairs.groupBy(F.col("earlier").alias("h_id")).agg(F.ceil(F.count("*") / hot_pairs).cast("int").alias("copies")).where("copies > 1")
    hot = few(stored(hot), most_broadcast)
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(hot, F.col("earlier") == F.col("h_id"), "left").select("id", "earlier", F.pmod(F.xxhash64("id"), copies).cast("int").alias("part"))
    others = hashed.join(pairs.select(F.col("earlier").alias("id")).distinct(), "id", "left_semi").join(hot, F.col("id") == F.col("h_id"), "left")
    others = others.select(F.col("id").alias("earlier"), F.col("lines").alias("other"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    joined = dealt.join(hashed.select("id", "doc_id", "text_hash", "lines", "words", "places"), "id").join(others, ["earlier", "part"])
    aligned = stored(joined.select("doc_id", "text_hash", "lines", "words", "places", "other").mapInArrow(_aligned(least_words), "doc_id long, text_hash long, places array<int>"))
    lines = aligned.select("doc_id", "text_hash", F.explode("places").alias("place")).distinct()
    # runs that an earlier document holds, whatever the alignments have found
    runs = held.where("id <> earliest").groupBy("id").agg(F.collect_set(F.struct("first", "size")).alias("runs"))
    run_lines = runs.join(hashed.select("id", "doc_id", "text_hash", "places"), "id")
    run_lines = run_lines.select("doc_id", "text_hash", F.explode(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.slice("places", r["first"] + 1, r["size"]))))).alias("place"))
    both = lines.withColumn("by_run", F.lit(0)).unionByName(run_lines.withColumn("by_run", F.lit(1)))
    both = both.groupBy("doc_id", "text_hash", "place").agg(F.min("by_run").alias("moved"))
    gone = both.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("place")).alias("places"), F.sum("moved").alias("n_moved"))
    partners = aligned.groupBy(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash")).agg(F.count("*").alias("n_partners"))
    out = gone.join(partners, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")), "left")
    return out.select("doc_id", "text_hash", "places", F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"), "n_moved")


RESULTS = ("n_lines", "n_deleted", "n_partners", "n_moved")


def dedup_lines(docs: DataFrame, least_words: int = 20, rare: int = 8, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs with text less the deleted lines, and n_lines, n_deleted, n_partners, n_moved.

    The deletions are broadcast when their rows and lines, counted beforehand, are at most most_broadcast.
    """
    gone = stored(deleted_lines(docs, least_words, rare, most_broadcast=most_broadcast))
    size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    docs = docs.drop(*RESULTS)
    own, g_id, g_hash, places, partners, moved = unused(docs.columns, "hash", "g_id", "g_hash", "places", "partners", "moved")
    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    hashed = docs.mapInArrow(_text_hash(own), f"{kinds}, `{own}` long")
    gone = gone.toDF(g_id, g_hash, places, partners, moved)
    gone = F.broadcast(gone) if size[0] + size[1] <= most_broadcast else gone
    joined = hashed.join(gone, F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.col(own) == F.col(g_hash)), "left")
    lines = F.split("text", "\n", -1)
    left = let(lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(places)), lambda i: F.get(ls, i)), "\n"))
    return joined.select(
        *[F.when(F.col(places).isNotNull(), left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_deleted"),
        F.coalesce(partners, F.lit(0)).cast("long").alias("n_partners"),
        F.coalesce(moved, F.lit(0)).cast("long").alias("n_moved"),
    )
