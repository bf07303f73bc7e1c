"""Language-model scoring by prediction by partial matching (operator 8).

Training counts every run of ``ORDER`` context bytes and the byte that follows
it, over all training documents, and sums them by key.  Each shorter context's
counts are sums of the longer ones', so the levels form a trie whose symbol
sets are nested: what follows a context also follows its suffixes.  A byte is
coded at the longest known context that has seen it; every level passed costs
its escape (method C: distinct symbols against occurrences), and symbols of
the longer context are excluded from the shorter one's counts.  The end of a
text is coded as a symbol of its own, so probabilities of texts sum to one.

No count is dropped.  A byte's probability depends on its context and symbol
alone, so it is worked out once for each distinct pair of the documents, in
groups of the context's last two bytes: a group holds all its longer contexts,
and the two levels of shorter ones, 65,792 entries at most, are sent whole.
The results stay a distributed table, like the unigram counts of words.  Only
the most frequent entries of each (``most_entries`` for each level of the
trie, and ``most_words``) are sent to the executors, and the other bytes and
words of a document are joined with the tables.

Defined cases: null text is empty and is still one end token; rows with equal
doc_id and text get equal results, one each; with no training documents words
are unknown and bytes uniform; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._store import stored

ORDER = 5
_PAD, _END = 0xFE, 0xFF  # never bytes of UTF-8
_END_WORD = np.uint64(0x5851F42D4C957F2D)
_SLOTS = 21


def _keys(x: t.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of each byte and of each end, as integers; and the documents' bounds in them."""
    n = np.diff(x.offsets)
    bound = np.zeros(x.n + 1, np.int64)
    np.cumsum(n + 1, out=bound[1:])
    room = bound + ORDER * np.arange(x.n + 1)
    seq = np.full(room[-1], _PAD, np.uint8)
    doc = np.repeat(np.arange(x.n), n)
    seq[np.arange(len(x.data)) + (room[:-1] + ORDER - x.offsets[:-1])[doc]] = x.data
    seq[room[1:] - 1] = _END
    key = np.zeros(max(len(seq) - ORDER, 0), np.uint64)
    for i in range(ORDER + 1):
        key = (key << np.uint64(8)) | seq[i : len(seq) - ORDER + i]
    own = np.ones(len(key), bool)  # places whose last byte is a symbol, not padding
    for i in range(ORDER):
        at = room[1:-1] - ORDER + i
        own[at] = False
    return key[own], bound


def _count(values: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.concatenate([v[0] for v in values])
    n = np.concatenate([v[1] for v in values])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _words(x: t.Texts) -> tuple[np.ndarray, np.ndarray]:
    first, last = x.words()
    return t.span_hash(t.prefix_hash(t.LOWER[x.data]), first, last), x.bounds(first)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of contexts with symbols (kind 1): n in the documents to learn from, seen in all."""
    words: list = []
    grams: list = []
    docs = 0
    for batch in batches:
        flags = np.array(batch.column("learn").to_pylist(), bool)
        for a, b, x in t.slices(batch.column("text")):
            learn = flags[a:b]
            docs += int(learn.sum())
            h, at = _words(x)
            words.append(np.unique(h[np.repeat(learn, np.diff(at))], return_counts=True))
            keys, bound = _keys(x)
            own = np.repeat(learn, np.diff(bound)).astype(np.uint64)
            grams.append(np.unique((keys << np.uint64(1)) | own, return_counts=True))
            if len(grams) >= 8:
                words, grams = [_count(words)], [_count(grams)]
    if docs:
        words.append((np.array([_END_WORD]), np.array([docs])))
    for kind, parts in ((0, words), (1, grams)):
        key, seen = _count(parts)
        n = np.where(key & np.uint64(1), seen, 0) if kind else seen
        key = key >> np.uint64(kind)
        for a in range(0, len(key), 50_000):
            part = slice(a, a + 50_000)
            columns = [pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(t.as_long(key[part])), pa.array(n[part].astype(np.int64)), pa.array(seen[part].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "n", "seen"])


def _threshold(counts: DataFrame, most: int) -> int:
    """An n so that at most `most` rows have n or more, the least one up to the width of a step; no more than that many ever.

    Steps are single counts up to 4,096 and 64th parts of a doubling beyond, so there are about 7,500 at most.
    """
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 4096)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("many"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    total, least = 0, None
    for r in sorted(rows, key=lambda r: -r["high"]):
        total += r["many"]
        if total > most:
            return r["high"] + 1
        least = r["low"]
    return 0 if least is None else min(least, 1)


def _arrays(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    table = rows.select("key", value).toArrow()
    key, values = table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column(value).to_numpy()
    order = np.argsort(key)
    return key[order], values[order]


class Trie:
    """Levels 0..ORDER of (context, symbol) counts, each with its contexts' totals."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = levels
        self.contexts = []
        for d, (key, n) in enumerate(levels):
            context = key >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(key) else np.zeros(0, np.int64)
            lower = np.zeros(len(key), np.int64)
            if d and len(key):  # counts of the same symbols one level down
                below, n_below = levels[d - 1]
                short = key & np.uint64((1 << 8 * d) - 1)
                at = np.minimum(np.searchsorted(below, short), max(len(below) - 1, 0))
                lower = np.where(below[at] == short, n_below[at], 0)
            add = (lambda v, f=first: np.add.reduceat(v, f)) if len(first) else (lambda v: np.zeros(0, np.int64))
            self.contexts.append((context[first], add(n), add(np.ones(len(key), np.int64)), add(lower)))

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol after its context."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        gone_kinds = np.zeros(len(keys), np.int64)  # symbols excluded by the longer context
        gone_count = np.zeros(len(keys), np.int64)  # and their count at this level
        for d in range(ORDER, -1, -1):
            if not len(open_):
                break
            key = keys[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
            contexts, total, kinds, lower = self.contexts[d]
            at, known = self._find(contexts, key >> np.uint64(8))
            if not len(contexts):
                continue
            n = np.where(known, total[at] - gone_count, 0)
            new = np.where(known, kinds[at] - gone_kinds, 0)
            place, found = self._find(self.levels[d][0], key)
            found &= known
            sum_ = np.maximum(n + new, 1)
            hit = open_[found]
            out[hit] += np.log10(self.levels[d][1][place[found]] / sum_[found])
            escape = ~found & known & (new > 0)
            out[open_[escape]] += np.log10(new[escape] / sum_[escape])
            rest = ~found
            gone_kinds = np.where(known, kinds[at], gone_kinds)[rest]
            gone_count = np.where(known, lower[at], 0)[rest]
            open_ = open_[rest]
        if len(open_):
            out[open_] -= np.log10(np.maximum(256 - gone_kinds, 1))
        return out


def _group(key: np.ndarray) -> np.ndarray:
    """The last two bytes of the context."""
    return (key >> np.uint64(8)) & np.uint64(0xFFFF)


def _probabilities(shared):
    """log10 probability of each key; rows come sorted by group, and no group is parted."""

    def values(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, n, seen = (np.concatenate(c) for c in zip(*parts, strict=True))
        learnt = n > 0
        own = [_count([(key[learnt] & np.uint64((1 << 8 * (d + 1)) - 1), n[learnt])]) for d in range(2, ORDER + 1)]
        return pa.RecordBatch.from_arrays([pa.array(t.as_long(key)), pa.array(seen), pa.array(Trie([*shared.value, *own]).log10(key))], ["key", "seen", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy().view(np.uint64)
            n, seen = batch.column("n").to_numpy(), batch.column("seen").to_numpy()
            cut = 0
            if rows + len(key) >= 500_000:  # all but the last group are whole
                group = _group(key)
                cut = int(np.searchsorted(group, group[-1]))
                if parts and (cut or _group(parts[-1][0][-1:])[0] != group[0]):
                    yield values([*parts, (key[:cut], n[:cut], seen[:cut])])
                    parts, rows = [], 0
                else:
                    cut = 0
            parts.append((key[cut:], n[cut:], seen[cut:]))
            rows += len(key) - cut
        if parts:
            yield values(parts)

    return run


class Table:
    """The log10 probabilities of some keys; those of other keys are not numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def log10(self, keys: np.ndarray) -> np.ndarray:
        at, found = Trie._find(self.keys, keys)
        return np.where(found, self.values[at], np.nan) if len(self.keys) else np.full(len(keys), np.nan)


def _many(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, key), and how often each is there."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, np.int64)
    return doc[first], key[first], np.diff(np.append(first, len(key)))


class Scorer:
    """A trie or table behind a direct-mapped table of results, so that most bytes cost one look-up."""

    def __init__(self, trie: Trie | Table):
        self.trie = trie
        self.key = np.full(1 << _SLOTS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.zeros(1 << _SLOTS)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            value = self.trie.log10(new)
            out[miss] = value[back]
            at = self._slot(new)
            self.key[at], self.value[at] = new, value
            wrong = self._slot(self.key[at]) != at  # cannot be; kept keys map to their own slot
            assert not wrong.any()
            self.value[at] = value[np.searchsorted(new, self.key[at])]
        return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot, n_hot, total, distinct = shared.value
        scorer = Scorer(Table(*table))
        norm = np.log10(total + 0.5 * (distinct + 1))
        value = np.log10(n_hot + 0.5) - norm
        for batch in batches:
            for a, b, x in t.slices(batch.column("text")):
                keys, bound = _keys(x)
                log10 = scorer.log10(keys)
                unknown = np.isnan(log10)
                score = np.add.reduceat(np.where(unknown, 0.0, log10), bound[:-1])
                rare_grams = _many(t.owner(bound)[unknown], keys[unknown])
                h, at = _words(x)
                doc = t.owner(at)
                place, known = Trie._find(hot, h)
                base = np.bincount(doc, weights=np.where(known, value[place] if len(hot) else 0.0, 0.0), minlength=x.n)
                rare_words = _many(doc[~known], h[~known])
                doc, key, many = (np.concatenate(c) for c in zip(rare_words, rare_grams, strict=True))
                kind = np.repeat(np.array([0, 1], np.int32), [len(rare_words[0]), len(rare_grams[0])])
                order = np.argsort(doc, kind="stable")
                rare_at = np.append(0, np.cumsum(np.bincount(doc, minlength=x.n)))
                rare = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(t.as_long(key[order])), pa.array(many[order].astype(np.int32))], ["kind", "key", "many"])
                text_hash = t.span_hash(t.prefix_hash(x.data), x.offsets[:-1], x.offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(t.as_long(text_hash)), pa.array(np.diff(at) + 1), pa.array(t.count_in(known, at)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), rare)],
                    ["doc_id", "text_hash", "n_tokens", "hot_known", "hot_score", "hot_bytes", "rare"],
                )

    return run


def score(docs: DataFrame, learn_from: Column, most_entries: int = 400_000, most_words: int = 300_000) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of each document; learn_from marks those to learn from."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    counts = texts.select("text", "learn").mapInArrow(_gather, "kind int, key long, n long, seen long")
    counts = stored(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")))
    words, grams = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n", "seen")
    summed = words.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = summed["total"] or 0, summed["distinct"]
    pairs = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n"))
    second = _arrays(pairs, "n")  # 65,536 rows at most
    first = _count([(second[0] & np.uint64(0xFF), second[1])])
    group = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    sorted_ = grams.repartition(group).sortWithinPartitions(group)
    values = stored(sorted_.mapInArrow(_probabilities(context.broadcast([first, second])), "key long, seen long, value double"))
    least_seen = _threshold(values.select(F.col("seen").alias("n")), (ORDER + 1) * most_entries)
    table = _arrays(values.where(F.col("seen") >= least_seen), "value")
    least = _threshold(words, most_words)
    hot, n_hot = _arrays(words.where(F.col("n") >= least), "n")
    end = F.lit(int(_END_WORD.astype(np.int64)))
    shared = context.broadcast((table, hot, n_hot, total, distinct))
    base = stored(texts.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, text_hash long, n_tokens long, hot_known long, hot_score double, hot_bytes double, rare array<struct<kind:int,key:long,many:int>>"))
    exploded = base.select("doc_id", "text_hash", F.posexplode("rare").alias("i", "item")).select("doc_id", "text_hash", "item.*", (F.col("i") == 0).cast("int").alias("first"))
    rare_words = words.where((F.col("n") < least) & (F.col("key") != end)).select(F.lit(0).alias("w_kind"), F.col("key").alias("w_key"), F.col("n").alias("w_n"), F.lit(None).cast("double").alias("w_value"))
    rare_grams = values.where(F.col("seen") < least_seen).select(F.lit(1).alias("w_kind"), F.col("key").alias("w_key"), F.lit(None).cast("long").alias("w_n"), F.col("value").alias("w_value"))
    joined = exploded.join(rare_words.unionByName(rare_grams), (F.col("kind") == F.col("w_kind")) & (F.col("key") == F.col("w_key")), "left")
    norm = F.log10(F.lit(total + 0.5 * (distinct + 1)))
    word = F.col("kind") == 0
    per = joined.groupBy(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash")).agg(
        F.sum("first").alias("copies"),  # equal rows are summed together
        F.sum(F.when(word & F.col("w_n").isNotNull(), F.col("many")).otherwise(0)).alias("known"),
        F.sum(F.when(word, F.col("many") * (F.log10(F.coalesce("w_n", F.lit(0)) + 0.5) - norm))).alias("rest"),
        F.sum(F.when(~word, F.col("many") * F.col("w_value"))).alias("bytes"),
    )
    end_count = words.where(F.col("key") == end).select("n").first()
    ends = end_count["n"] if end_count else 0
    out = base.drop("rare").join(per, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")), "left")
    known, rest, bytes_ = (F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0)) for c in ("known", "rest", "bytes"))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("hot_known") + known + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_score") + rest + F.log10(F.lit(ends + 0.5)) - norm).alias("base_score"),
        (F.col("hot_bytes") + bytes_).alias("score"),
    )
