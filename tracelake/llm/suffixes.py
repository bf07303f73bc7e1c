"""Removal of repeated byte strings by a distributed suffix merge sort (operator 7).

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else in the corpus.  Sorting all suffixes would move the corpus many
times, so suffixes are sampled by content: in every window of ``length`` bytes
the first smallest hash of 8 bytes marks a suffix, and equal windows mark the
same one.  A suffix whose first ``gram`` bytes occur once in the corpus (they
are counted by hash first) cannot lie in a repeated window and is dropped.  The
grams that occur again go to the texts as a Bloom filter; what it lets on
besides is sorted with the others and meets no equal.  More than ``most_grams``
of them would overfill it; then the suffixes' places are joined to the texts.

The others are sorted by a common-prefix-aware merge sort: each task sorts its
suffixes, computes their common prefixes and sends, for each key range, a run
of front-coded suffixes (common prefix length and the rest) with the bytes to
their left; equal suffixes with equal left bytes are one entry with a list of
places.  A range merges its runs with a loser tree that keeps each contender's
common prefix with the last winner and never compares those bytes again.  In
the merged order suffixes that share the gram stand together, and a suffix's
longest common prefix with its neighbours bounds how far right a window that
repeats can reach.  Only windows inside that bound are compared, by hash, with
those of their group.  The windows of one suffix that repeat overlap, so they
give one span.

Documents with equal text are read once: all of their bytes repeat.  Texts are
moved only where a filter finds that they may lose bytes, or may be copies
that are too many to send to all executors.  Ranges
are cut by a bounded sample of suffixes; a run is flushed at ``run_entries``
entries.  A group's different contexts are held by one task, packed, at some 400
bytes each; its windows are hashed in pieces and compared in passes by hash
value, of ``most_windows`` each at most.

Defined cases: null text is empty; texts under ``length`` bytes lose nothing;
rows equal in doc_id and text repeat each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from . import bloom
from ._store import few, stored


def anchors(x: t.Texts, length: int, gram: int) -> np.ndarray:
    """Places of the suffixes that mark the windows of `length` bytes inside documents."""
    data, n = x.data, len(x.data)
    if n < length:
        return np.zeros(0, np.int64)
    g = np.zeros(n - 7, np.uint64)
    for i in range(8):
        g = (g << np.uint64(8)) | data[i : n - 7 + i]
    low = np.uint64((1 << 32) - 1)
    h = (t.mix(g) & ~low) | np.arange(len(g), dtype=np.uint64)  # the place decides between equal grams
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if width > have:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    inside = np.zeros(n + 1, np.int64)
    size = np.diff(x.offsets)
    full = size >= length
    np.add.at(inside, x.offsets[:-1][full], 1)
    np.add.at(inside, x.offsets[1:][full] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return np.unique((h[starts] & low).astype(np.int64))


def _grams(length: int, gram: int):
    """How often the gram of a suffix occurs in a slice, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, x in t.slices(batch.column("text"), t.SMALL):
                at = anchors(x, length, gram)
                key, times = np.unique(t.span_hash(t.prefix_hash(x.data), at, at + gram), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.as_long(key)), pa.array(times.astype(np.int64))], ["key", "times"])

    return run


def _placed(length: int, gram: int, grams: np.ndarray):
    """The texts with the places of their suffixes whose gram is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in t.slices(batch.column("text"), t.SMALL):
                at = anchors(x, length, gram)
                at = at[bloom.might(grams, t.span_hash(t.prefix_hash(x.data), at, at + gram))]
                doc = np.searchsorted(x.offsets, at, side="right") - 1
                many = np.bincount(doc, minlength=x.n)
                own = np.flatnonzero(many)
                places = t.list_column((at - x.offsets[doc]).astype(np.int32), np.append(0, np.cumsum(many[own])), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a).take(pa.array(own)) for c in ("ref", "text")), places], ["ref", "text", "places"])

    return run


def _marked(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column("ref")
            for a, b, x in t.slices(batch.column("text")):
                at = anchors(x, length, gram)
                if not len(at):
                    continue
                h = t.span_hash(t.prefix_hash(x.data), at, at + gram)
                doc = np.searchsorted(x.offsets, at, side="right") - 1
                own = refs.slice(a, b - a).to_numpy(zero_copy_only=False)[doc]
                place = (at - x.offsets[doc]).astype(np.int32)
                # what repeats in this slice is known to: it is spread by a key of its own, and one row stands for it
                gram_of, back, many = np.unique(h, return_inverse=True, return_counts=True)
                known = many[back] > 1
                key = np.where(known, t.mix(own.view(np.uint64) ^ t.mix(at.astype(np.uint64))), h)
                stand = gram_of[many > 1]
                absent = np.concatenate([np.zeros(len(own), bool), np.ones(len(stand), bool)])
                filler = np.zeros(len(stand), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, filler]), mask=absent),
                        pa.array(np.concatenate([place, filler.astype(np.int32)])),
                        pa.array(t.as_long(np.concatenate([key, stand]))),
                        pa.array(np.concatenate([1 + known, 2 + filler]).astype(np.int32)),
                    ],
                    ["ref", "place", "key", "times"],
                )

    return run


def _contexts(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Suffix, bytes to its left, document and place."""
    for text, places, ref in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("places").to_pylist(), batch.column("ref").to_pylist(), strict=True):
        for p in places:
            yield text[p : p + length], text[max(0, p - length + gram) : p], ref, p


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which `at` bytes are known."""
    end = min(len(a), len(b))
    while at < end:
        step = min(end - at, 32)
        if a[at : at + step] == b[at : at + step]:
            at += step
            continue
        while a[at] == b[at]:
            at += 1
        break
    return at


def _pack(entries: list[tuple[bytes, bytes, list[int], list[int]]]) -> bytes:
    """A sorted run, front-coded."""
    common, rest, left, before = [], [], [], b""
    for key, *_ in entries:
        n = _common(before, key, 0)
        common.append(n)
        rest.append(key[n:])
        before = key
    left = [e[1] for e in entries]
    numbers = [np.array(v, np.int32) for v in ([len(entries)], common, [len(r) for r in rest], [len(v) for v in left], [len(e[2]) for e in entries])]
    refs = np.array([r for e in entries for r in e[2]], np.int64)
    places = np.array([p for e in entries for p in e[3]], np.int32)
    raw = b"".join([*(v.tobytes() for v in numbers), refs.tobytes(), places.tobytes(), *rest, *left])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the entry before, key, (left, refs, places)) of a run, in order."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    common, rest, left, many = np.frombuffer(raw, np.int32, 4 * n, 4).reshape(4, n).tolist()
    at = 4 + 16 * n
    total = sum(many)
    refs = np.frombuffer(raw, np.int64, total, at).tolist() if total else []
    places = np.frombuffer(raw, np.int32, total, at + 8 * total).tolist() if total else []
    at += 12 * total
    at_left, first, key = at + sum(rest), 0, b""
    for c, r, v, m in zip(common, rest, left, many, strict=True):
        key = key[:c] + raw[at : at + r]
        yield c, key, (raw[at_left : at_left + v], refs[first : first + m], places[first : first + m])
        at, at_left, first = at + r, at_left + v, first + m


def _runs(length: int, gram: int, splitters: list[bytes], run_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int, int]] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            ranges: dict[int, list] = {}
            before = None
            for key, left, ref, place in held:
                if before is not None and before[0] == key and before[1] == left:
                    before[2].append(ref)
                    before[3].append(place)
                else:
                    before = (key, left, [ref], [place])
                    ranges.setdefault(bisect_right(splitters, key), []).append(before)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(ranges), pa.int32()), pa.array([_pack(e) for e in ranges.values()], pa.binary())], ["range", "run"])

        for batch in batches:
            for context in _contexts(batch, length, gram):
                held.append(context)
                if len(held) >= run_entries:
                    yield flush()
        if held:
            yield flush()

    return run


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """One sorted sequence of sorted runs, with each key's common prefix with the key before it.

    A loser tree: known[i] is what contender i shares with the last winner.  Of
    two contenders the one that shares more is smaller; only equal ones are
    compared, from there on, and the loser keeps what it shares with its victor.
    """
    k = 1
    while k < max(len(runs), 1):
        k *= 2
    key: list[bytes | None] = [None] * k
    load: list[tuple | None] = [None] * k
    known = [0] * k
    for i, r in enumerate(runs):
        if (first := next(r, None)) is not None:
            _, key[i], load[i] = first
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = key[a], key[b]
        if x is None:
            return b, a
        if y is None or known[a] > known[b]:
            return a, b
        if known[a] < known[b]:
            return b, a
        n = _common(x, y, known[a])
        if x[n : n + 1] <= y[n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(k))
    node = k // 2
    while node:
        following = []
        for i in range(0, len(winners), 2):
            win, lose = play(winners[i], winners[i + 1])
            tree[node + i // 2] = lose
            following.append(win)
        winners, node = following, node // 2
    best = winners[0]
    while key[best] is not None:
        yield known[best], key[best], load[best]
        if (entry := next(runs[best], None)) is None:
            key[best] = None
        else:
            known[best], key[best], load[best] = entry
        node = (best + k) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


class _Contexts:
    """Contexts of one or more groups in sorted order, packed in pieces, and which of their windows repeat."""

    def __init__(self, length: int, gram: int, piece: int = 1000, most_windows: int = 4_000_000):
        self.length, self.reach, self.piece, self.most = length, length - gram, piece, most_windows
        self.clear()

    def clear(self) -> None:
        self.loose: list[list] = []  # [suffix, left bytes, documents, places, what it shares with a neighbour]
        self.packed: list[tuple] = []
        self.size = 0

    def add(self, key: bytes, left: bytes, docs: list[int], places: list[int], shared: int) -> None:
        """shared: the common prefix with the context before in the group, 0 for the first."""
        self.size += 1
        if shared and self.loose:
            self.loose[-1][4] = max(self.loose[-1][4], shared)
        if len(self.loose) > self.piece:
            self._pack(self.loose[:-1])
            self.loose = self.loose[-1:]
        self.loose.append([key, left, docs, places, shared])

    def _pack(self, rows: list[list]) -> None:
        flat = np.frombuffer(b"".join(r[1].rjust(self.reach, b"\0") + r[0].ljust(self.length, b"\0") for r in rows), np.uint8)
        many = np.array([len(r[2]) for r in rows])
        docs, places = np.array([d for r in rows for d in r[2]], np.int64), np.array([p for r in rows for p in r[3]], np.int32)
        left, right, shared = (np.array(x, np.int16) for x in ([len(r[1]) for r in rows], [len(r[0]) for r in rows], [r[4] for r in rows]))
        # offsets of the suffix in a window: from where the window fits, or may repeat, to where it fits
        fit = np.maximum(0, self.length - right)
        low, high = np.maximum(fit, self.length - shared), np.minimum(left, self.reach)
        self.packed.append((flat, many, docs, places, low, high, np.where((many > 1) & (fit <= high), fit, self.length + 1), np.where((many > 1) & (fit <= high), high, -1)))

    def _windows(self, x: tuple, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and offset of the windows to compare whose hash falls to this pass."""
        flat, low, high = x[0], x[4], x[5]
        width = self.reach + self.length
        matrix = flat.reshape(-1, width)
        size = np.maximum(high - low + 1, 0)
        row = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size) + np.repeat(low, size)
        with np.errstate(over="ignore"):
            prefix = np.zeros((len(size), width + 1), np.uint64)
            np.cumsum((matrix.astype(np.uint64) + np.uint64(1)) * t.powers(t._BASE, width)[:width], axis=1, out=prefix[:, 1:])
            start = self.reach - offset
            h = (prefix[row, start + self.length] - prefix[row, start]) * t.powers(t._INV, width)[start] + offset.astype(np.uint64) * np.uint64(t._STEP)
        value = t.mix(h)
        if parts > 1:
            own = np.flatnonzero(value % np.uint64(parts) == part)
            value, row, offset = value[own], row[own], offset[own]
        return value, row, offset

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document, start and end of the span that repeats around each place."""
        if self.loose:
            self._pack(self.loose)
        base = np.append(0, np.cumsum([len(x[1]) for x in self.packed]))
        total = sum(int(np.maximum(x[5] - x[4] + 1, 0).sum()) for x in self.packed)
        many = np.concatenate([x[1] for x in self.packed]) if self.packed else np.zeros(0, np.int64)
        least, most = (np.concatenate([x[i] for x in self.packed]).astype(np.int64) if self.packed else np.zeros(0, np.int64) for i in (6, 7))
        parts = max(1, -(-total // self.most))
        for part in range(parts if total else 0):
            found = [self._windows(x, part, parts) for x in self.packed]
            value = np.concatenate([f[0] for f in found])
            row = np.concatenate([f[1] + b for f, b in zip(found, base[:-1], strict=True)])
            offset = np.concatenate([f[2] for f in found])
            if not len(value):
                continue
            order = np.argsort(value, kind="stable")
            first = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1]))
            hit = np.repeat(np.add.reduceat(many[row[order]], first) > 1, np.diff(np.append(first, len(value))))
            at = order[hit]
            np.minimum.at(least, row[at], offset[at])
            np.maximum.at(most, row[at], offset[at])
        for x, b in zip(self.packed, base[:-1], strict=True):
            low, high = (np.repeat(v[b : b + len(x[1])], x[1]) for v in (least, most))
            own = high >= 0
            yield x[2][own], x[3][own] - high[own], x[3][own] - low[own] + self.length
        self.clear()


def _merged(length: int, gram: int, batch_entries: int = 1000, most_windows: int = 4_000_000):
    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = _Contexts(length, gram, most_windows=most_windows)
        now: list | None = None  # the last context of the group, not yet held
        alone, shared = True, 0

        def close() -> None:
            if now and (not alone or len(now[2]) > 1):
                held.add(*now, shared)
            if held.size >= batch_entries:
                found.extend(held.spans())

        runs = [_unpack(b) for b in table.column("run").to_pylist()]
        for common, key, (left, docs, places) in merge(runs):
            if common < gram:
                close()
                now = None
            if now is None:
                now, alone, shared = [key, left, list(docs), list(places)], True, 0
            elif now[0] == key and now[1] == left:
                now[2].extend(docs)
                now[3].extend(places)
            else:
                held.add(*now, shared)
                now, alone, shared = [key, left, list(docs), list(places)], False, common
        close()
        found.extend(held.spans())
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"ref": pa.array(columns[0], pa.int64()), "start": pa.array(columns[1].astype(np.int32)), "end": pa.array(columns[2].astype(np.int32))})

    return run


def _heads(length: int, gram: int, size: int = 24):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c[0][:size] for c in _contexts(batch, length, gram)], pa.binary())], ["head"])

    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for a, b, x in t.slices(batch.column("text")):
                raw, removed, kept = x.data.tobytes(), [], []
                columns = (batch.column(c).slice(a, b - a).to_pylist() for c in ("spans", "whole"))
                for first, last, spans, all_ in zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), *columns, strict=True):
                    size = last - first
                    runs = [(0, size)] if all_ and size >= length else union([(s["start"], s["end"]) for s in spans or []])
                    at, parts = first, []
                    for start, end in runs:
                        parts.append(raw[at : first + start])
                        at = first + end
                    removed.append([{"start": start, "end": end} for start, end in runs])
                    kept.append(b"".join([*parts, raw[at:last]]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(x.offsets)), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return run


def _joined(spans: str) -> Column:
    """Sorted spans as maximal runs."""
    kind = "array<struct<start:int,end:int>>"

    def add(s: Column, x: Column) -> Column:
        meets = x["start"] <= s["last"]["end"]
        longer = F.struct(s["last"]["start"].alias("start"), F.greatest(s["last"]["end"], x["end"]).alias("end"))
        return F.struct(F.when(meets, s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))).alias("done"), F.when(meets, longer).otherwise(x).alias("last"))

    start = F.struct(F.array().cast(kind).alias("done"), F.get(spans, F.lit(0)).alias("last"))
    folded = F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), start, add, lambda s: F.concat(s["done"], F.array(s["last"])))
    return F.when(F.size(spans) == 0, F.array().cast(kind)).otherwise(folded)


def _without(long_: DataFrame, extra: DataFrame, most_ids: int):
    """The rows of long_, and the step on batches that leaves of them those not in extra; where extra is not few, only rows that may be in it are moved."""
    if (n := extra.count()) <= most_ids:
        return long_.join(F.broadcast(extra), ["doc_id", "ref"], "left_anti").select("ref", "text"), iter
    row = F.xxhash64("doc_id", "ref").alias("row")
    known = bloom.built(extra.select(row), n)
    all_ = long_.select("doc_id", "ref", "text", row)
    moved = all_.mapInArrow(bloom.rows(known, "row", True), all_.schema).join(extra, ["doc_id", "ref"], "left_anti")
    rows = all_.select("ref", "text", "row", F.lit(False).alias("sure")).unionByName(moved.select("ref", "text", "row", F.lit(True).alias("sure")))
    return rows, bloom.rows(known, "row", False, "sure")


def remove_repeated(docs: DataFrame, length: int = 200, gram: int = 48, run_entries: int = 30_000, range_entries: int = 40_000, sampled_heads: int = 50_000, most_windows: int = 4_000_000, most_ids: int = 200_000, most_grams: int = bloom.MOST_BITS // 6) -> DataFrame:
    """doc_id, n_bytes, removed (maximal spans) and kept (the remaining bytes) of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("ref", F.xxhash64(F.sha2("text", 256)))
    long_ = texts.where(F.octet_length("text") >= length)
    classes = long_.groupBy(F.col("ref").alias("c_ref")).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    copies = stored(classes.where("rows > 1").select("c_ref", "first"))
    extra = stored(long_.select("doc_id", "ref").join(few(copies, most_ids), F.col("ref") == F.col("c_ref")).where("doc_id <> first").select("doc_id", "ref").distinct())
    nodes, only = _without(long_, extra, most_ids)
    # suffixes whose gram occurs again
    count, mark = _grams(length, gram), _marked(length, gram)
    repeated = stored(nodes.mapInArrow(lambda batches: count(only(batches)), "key long, times long").groupBy("key").agg(F.sum("times").alias("n")).where("n > 1"))
    grams, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if grams <= most_grams:
        place = _placed(length, gram, bloom.built(repeated.select("key"), grams))
        placed, held = lambda batches: place(only(batches)), nodes
    else:
        marked = nodes.mapInArrow(lambda batches: mark(only(batches)), "ref long, place int, key long, times int")
        again = marked.withColumn("n", F.sum("times").over(Window.partitionBy("key"))).where("n > 1 and ref is not null")
        places = stored(again.groupBy("ref").agg(F.array_sort(F.collect_set("place")).alias("places")))
        left = nodes.mapInArrow(lambda batches: only(batches), nodes.schema).select("ref", "text")
        placed, held = iter, stored(left.join(few(places.select("ref"), most_ids), "ref", "left_semi").join(places, "ref"))
    # sorted runs by key range, merged
    rate = min(1.0, sampled_heads / max(total, 1))
    some = held.where(F.pmod(F.xxhash64("ref"), F.lit(1_000_000)) < max(1, int(rate * 1_000_000)))
    head = _heads(length, gram)
    heads = sorted(r["head"] for r in some.mapInArrow(lambda batches: head(placed(batches)), "head binary").collect())  # about sampled_heads short strings
    ranges = max(1, -(-total // range_entries))
    splitters = sorted({bytes(heads[i * len(heads) // ranges]) for i in range(1, ranges)}) if heads else []
    sort = _runs(length, gram, splitters, run_entries)
    runs = held.mapInArrow(lambda batches: sort(placed(batches)), "range int, run binary")
    spans = runs.groupBy("range").applyInArrow(_merged(length, gram, most_windows=most_windows), "ref long, start int, end int")
    found = spans.groupBy("ref").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select("ref", "spans", F.lit(False).alias("whole"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    info = found.unionByName(copies.select(F.col("c_ref").alias("ref"), none.alias("spans"), F.lit(True).alias("whole")))
    info = info.groupBy("ref").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.max("whole").alias("whole"))
    info = stored(info.select("ref", _joined("spans").alias("spans"), "whole"))
    # texts that lose nothing stay where they are
    losing, cut, kind = bloom.built(info.select("ref"), info.count()), _removed(length), "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary"
    clear = bloom.rows(losing, "ref", False)
    whole = texts.select("doc_id", "ref", "text", none.alias("spans"), F.lit(False).alias("whole")).mapInArrow(lambda batches: cut(clear(batches)), kind)
    moved = texts.mapInArrow(bloom.rows(losing, "ref", True), texts.schema).join(info, "ref", "left").select("doc_id", "text", "spans", "whole")
    return whole.unionByName(moved.mapInArrow(cut, kind))
