r"""Cross-document line frequency rules (operator 1).

Lines are normalised (A-Z lower-cased, white space runs collapsed), hashed and
counted: how many distinct texts of one host hold the line.  Lines above the
limits are cut out of the text, and a document of which too little is left is
rejected.  The counting is relational; the lines' hashes, the per-document
statistics and the cut run in Arrow-batched numpy kernels, one pass over the
texts for the hashes and one for the rest.  The frequent lines go to that pass
whole while they are at most ``most_lines``; beyond, each text's own are joined
to it.

Defined cases: a null or empty text has no words, fails the base rules and is
not kept, and an empty text is left of it; a null host is a host of its own;
documents with equal text count once in a line's frequency, so exact copies do
not deplete each other; rows that repeat a doc_id are judged each by its own
text; what is left of a text are its other lines as they stand, empty ones too,
joined by one \n, for rejected documents as well; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._store import stored

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_LINES = "host string, text_hash long, lines array<long>"
_JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines_removed long, n_words_removed long, text string"


def _line_words(x: t.Texts, first: np.ndarray, last: np.ndarray, start: np.ndarray):
    """Index of each line's first word, and the hash of its normalised words."""
    h = t.span_hash(t.prefix_hash(t.LOWER[x.data]), first, last)
    bound = np.append(np.searchsorted(first, start), len(first))
    return bound, t.span_hash(t.prefix_hash(h), bound[:-1], bound[1:])


def _in_document(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal values of one document."""
    return t.mix(values ^ t.mix(doc.astype(np.uint64)))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct normalised lines with a word of each document."""
    for batch in batches:
        for a, b, x in t.slices(batch.column("text")):
            first, last = x.words()
            words_of, normal = _line_words(x, first, last, x.lines()[0])
            kept = np.flatnonzero(np.diff(words_of) > 0)
            doc = t.owner(x.line_bounds())[kept]
            _, at = np.unique(_in_document(normal[kept], doc), return_index=True)
            at.sort()
            list_at = np.append(0, np.cumsum(np.bincount(doc[at], minlength=x.n)))
            columns = [batch.column(c).slice(a, b - a) for c in ("host", "text_hash")]
            yield pa.RecordBatch.from_arrays([*columns, t.list_column(t.as_long(normal[kept][at]), list_at, pa.int64())], ["host", "text_hash", "lines"])


def _without(x: t.Texts, start: np.ndarray, end: np.ndarray, line_bound: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The texts without the lines that are gone."""
    raw, parts = x.data.tobytes(), []
    cut = t.count_in(gone, line_bound) > 0
    for doc, (a, b) in enumerate(zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True)):
        if cut[doc]:
            own = np.flatnonzero(~gone[line_bound[doc] : line_bound[doc + 1]]) + line_bound[doc]
            parts.append(b"\n".join([raw[i:j] for i, j in zip(start[own].tolist(), end[own].tolist(), strict=True)]))
        else:
            parts.append(raw[a:b])
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.StringArray.from_buffers(x.n, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts)))


def _judged(frequent: dict[str | None, np.ndarray] | None):
    """Statistics of each document and its text without its host's frequent lines; None: they are in the column `gone`."""

    def is_gone(batch: pa.RecordBatch, normal: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if frequent is None:
            gone = batch.column("gone")
            lists = [np.array(v or [], np.int64).view(np.uint64) for v in gone.to_pylist()]
            own = _in_document(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(v) for v in lists]))
            return np.isin(_in_document(normal, doc), own)
        out = np.zeros(len(normal), bool)
        hosts = batch.column("host").dictionary_encode()
        names = [*hosts.dictionary.to_pylist(), None]
        code = hosts.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)[doc]
        for i, name in enumerate(names):
            if name in frequent and len(own := np.flatnonzero(code == i)):
                out[own] = np.isin(normal[own], frequent[name])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in t.slices(batch.column("text")):
                first, last = x.words()
                bound = x.bounds(first)
                raw = t.prefix_hash(x.data)
                h = t.span_hash(raw, first, last)
                start, end = x.lines()
                line_bound = x.line_bounds()
                words_of, normal = _line_words(x, first, last, start)
                n_words_of = np.diff(words_of)
                doc_of_line = t.owner(line_bound)
                # raw lines that stand earlier in the same document
                kept = np.flatnonzero(n_words_of > 0)
                _, at = np.unique(_in_document(t.span_hash(raw, start, end)[kept], doc_of_line[kept]), return_index=True)
                again = np.ones(len(kept), bool)
                again[at] = False
                dup_lines = np.bincount(doc_of_line[kept][again], minlength=x.n)
                # words inside windows of three that occur twice
                repeat = np.zeros(len(h), bool)
                g = t.run_hash(h, 3)
                if len(g):
                    doc = t.owner(bound)
                    own = np.flatnonzero(doc[:-2] == doc[2:])
                    key = _in_document(g[own], doc[own])
                    order = np.argsort(key, kind="stable")
                    same = key[order][1:] == key[order][:-1]
                    twice = np.zeros(len(own), bool)
                    twice[order[1:][same]] = True
                    twice[order[:-1][same]] = True
                    at = own[twice]
                    for i in range(3):
                        repeat[at + i] = True
                # frequent lines, all words of theirs and how many different ones
                gone = np.zeros(len(normal), bool)
                gone[kept] = is_gone(batch.slice(a, b - a), normal[kept], doc_of_line[kept])
                at = np.flatnonzero(gone)
                _, one = np.unique(_in_document(normal[at], doc_of_line[at]), return_index=True)
                inside = t.CODE_POINT[x.data] & ~t.SPACE[x.data]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                        pa.array(np.diff(bound)),
                        pa.array(t.count_in(inside, x.offsets)),
                        pa.array(t.count_in(SYMBOLS[x.data], x.offsets)),
                        pa.array(dup_lines.astype(np.int64)),
                        pa.array(t.count_in(repeat, bound)),
                        pa.array(np.bincount(doc_of_line[at[one]], minlength=x.n).astype(np.int64)),
                        pa.array(t.sum_in(np.where(gone, n_words_of, 0), line_bound)),
                        _without(x, start, end, line_bound, gone),
                    ],
                    [c.split()[0] for c in _JUDGED.split(", ")],
                )

    return run


def line_frequency(docs: DataFrame, host: str = "source", least_documents: int = 20, most_share: float = 0.02, least_left: float = 0.3, least_words: int = 50, most_lines: int = 200_000) -> DataFrame:
    """Cut its host's frequent lines out of each document and judge it by what is left.

    A line is removed when more than `least_documents` distinct texts and more
    than the share `most_share` of the distinct texts of the host hold it;
    `text` is what is left.  A document is depleted when less than the share
    `least_left` of its words is left.  Base rules: fewer than `least_words`
    words, or over half of the words in repeated three-word windows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    lines = stored(texts.select("host", "text_hash", "text").mapInArrow(_lines, _LINES))
    line = lines.select("host", "text_hash", F.explode("lines").alias("h"))
    held = line.groupBy("host", "h", "text_hash").agg(F.lit(1).alias("x")).groupBy("host", "h").agg(F.count("*").alias("documents"))
    hosts = lines.groupBy("host", "text_hash").agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias("host_documents"))
    frequent = stored(
        held.where(F.col("documents") > least_documents)
        .join(hosts, held.host.eqNullSafe(hosts.host))
        .where(F.col("documents") > F.col("host_documents") * most_share)
        .select(held.host.alias("f_host"), F.col("h").alias("f_h"))
    )
    if frequent.count() <= most_lines:
        found: dict[str | None, list[int]] = {}
        for name, h in frequent.collect():  # at most most_lines rows
            found.setdefault(name, []).append(h)
        judged = texts.select("doc_id", "host", "text").mapInArrow(_judged({k: np.array(v, np.int64).view(np.uint64) for k, v in found.items()}), _JUDGED)
    else:
        gone = (
            line.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h")))
            .groupBy(F.col("host").alias("g_host"), F.col("text_hash").alias("g_hash"))
            .agg(F.collect_set("h").alias("gone"))
        )
        joined = texts.join(gone, F.col("host").eqNullSafe(F.col("g_host")) & (F.col("text_hash") == F.col("g_hash")), "left")
        judged = joined.select("doc_id", "text", "gone").mapInArrow(_judged(None), _JUDGED)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_words_removed")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= F.col("n_words") * least_left)).alias("kept"),
        "n_lines_removed", "n_words_removed", "text",
    )
