"""Relations inside traces, over batches of Arrow rows that hold whole traces.

A partition comes sorted by trace, so a task holds one batch and the trace that
it ends with, at some 200 bytes a span; its work grows with its rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a trace does, of rows sorted by trace_id."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = b.column("trace_id")[-1]
        start = int(np.argmax(pc.equal(b.column("trace_id"), last).to_numpy(zero_copy_only=False)))
        if start or held and held[-1].column("trace_id")[-1] != last:
            held.append(b.slice(0, start))
            yield pa.Table.from_batches([x for x in held if x.num_rows])
            held = []
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _codes(values: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each different value, -1 for null."""
    coded = values.dictionary_encode()
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for each i, count[i] of them."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Spans:
    """Nodes are the different (trace, span) of a table, in order of trace; edges lead from a node to a parent that is there."""

    def __init__(self, table: pa.Table):
        self.trace_ids, self.span_ids = _one(table.column("trace_id")), _one(table.column("span_id"))
        self.row_trace, self.traces = _codes(self.trace_ids)
        n, self.related = len(self.row_trace), "parent_span_id" in table.column_names
        both = pa.concat_arrays([self.span_ids, _one(table.column("parent_span_id"))]) if self.related else self.span_ids
        code, size = _codes(both)
        self.rows = np.flatnonzero(code[:n] >= 0)
        key = self.row_trace * size + code[:n]
        self.keys, first, self.node = np.unique(key[self.rows], return_index=True, return_inverse=True)
        self.first_row, self.trace = self.rows[first], self.keys // max(size, 1)
        if self.related:
            named = code[n:][self.rows] >= 0
            self.child = self.node[named]
            self.parent_key = (self.row_trace * size + code[n:])[self.rows][named]
            at = np.minimum(np.searchsorted(self.keys, self.parent_key), len(self.keys) - 1) if len(self.keys) else self.child
            there = self.keys[at] == self.parent_key
            edges = np.unique(self.child[there] * len(self.keys) + at[there])
            self.low, self.high = edges // max(len(self.keys), 1), edges % max(len(self.keys), 1)

    def marked(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.keys), bool)
        out[self.node[rows[self.rows]]] = True
        return out

    def holds(self, nodes: np.ndarray) -> np.ndarray:
        """Whether each trace has one of the nodes."""
        out = np.zeros(self.traces, bool)
        out[self.trace[nodes]] = True
        return out

    def levels(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Edges in steps such that all of a node's parents are done before its children, and the traces with a cycle."""
        order = np.argsort(self.high, kind="stable")
        first = np.searchsorted(self.high[order], np.arange(len(self.keys) + 1))
        waiting = np.bincount(self.low, minlength=len(self.keys))
        ready, steps, done = np.flatnonzero(waiting == 0), [], 0
        while len(ready):
            edges = order[_ranges(first[ready], first[ready + 1] - first[ready])]
            if not len(edges):
                break
            steps.append(edges)
            done += len(edges)
            below, times = np.unique(self.low[edges], return_counts=True)
            waiting[below] -= times
            ready = below[waiting[below] == 0]
        cyclic = np.zeros(self.traces, bool)
        if done < len(self.low):
            left = np.ones(len(self.low), bool)
            left[np.concatenate(steps) if steps else []] = False
            cyclic[self.trace[self.low[left]]] = True
        return steps, cyclic

    def related_to(self, op: str, left: np.ndarray) -> np.ndarray:
        """Nodes that have a parent (>), an ancestor (>>), a child (<), a descendant (<<) or a sibling (~) in left."""
        hit = np.zeros(len(self.keys), bool)
        if op == ">":
            hit[self.low[left[self.high]]] = True
        elif op == "<":
            hit[self.high[left[self.low]]] = True
        elif op == ">>":
            for edges in self.levels()[0]:
                low, high = self.low[edges], self.high[edges]
                hit[low[left[high] | hit[high]]] = True
        elif op == "<<":
            for edges in reversed(self.levels()[0]):
                low, high = self.low[edges], self.high[edges]
                hit[high[left[low] | hit[low]]] = True
        else:
            # someone else in left under the same parent, there or not: two of them or one that is not the span itself
            parents, under = np.unique(self.parent_key, return_inverse=True)
            one, two, own = np.full(len(parents), _MOST), np.full(len(parents), _LEAST), left[self.child]
            np.minimum.at(one, under[own], self.child[own])
            np.maximum.at(two, under[own], self.child[own])
            some = one[under] <= two[under]
            hit[self.child[some & ((one[under] != self.child) | (two[under] != self.child))]] = True
        return hit

    def closure(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each node with each of its ancestors once, for traces without cycles, nearest first."""
        first = np.searchsorted(self.low, np.arange(len(self.keys) + 1))  # edges are sorted by their lower end
        forest, low, high, seen = not len(self.low) or np.diff(first).max() < 2, self.low, self.high, np.empty(0, np.int64)
        while len(low):
            if not forest:  # a span id with several parents may reach an ancestor by several ways
                pairs = np.setdiff1d(low * len(self.keys) + high, seen)
                low, high, seen = pairs // len(self.keys), pairs % len(self.keys), np.union1d(seen, pairs)
            yield low, high
            count = first[high + 1] - first[high]
            low, high = np.repeat(low, count), self.high[_ranges(first[high], count)]


def ancestor_pairs(most_depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (trace_id, span_id, ancestor_id); without an ancestor for a trace that has a cycle or is too deep."""

    def run(batches):
        for table in whole(batches):
            s = Spans(table)
            steps, cyclic = s.levels()
            if len(steps) > most_depth:
                cyclic[s.trace[s.low[steps[most_depth]]]] = True
            if cyclic.any():
                at = np.flatnonzero(cyclic[s.row_trace])[:1]
                yield pa.RecordBatch.from_arrays([s.trace_ids.take(at), s.span_ids.take(at), pa.nulls(1, pa.binary())], ["trace_id", "span_id", "ancestor_id"])
                continue
            for low, high in s.closure():
                low, high = s.first_row[low], s.first_row[high]
                yield pa.RecordBatch.from_arrays([s.trace_ids.take(low), s.span_ids.take(low), s.span_ids.take(high)], ["trace_id", "span_id", "ancestor_id"])

    return run


_COUNTED = {"=": np.equal, "!=": np.not_equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}


def _evaluate(e: tuple, s: Spans, flags: list[np.ndarray], cyclic: np.ndarray) -> np.ndarray:
    """The nodes of a spanset; traces that a walk over ancestors could not finish are marked in cyclic."""
    if e[0] == "select":
        return s.marked(flags[e[1]])
    if e[0] == "count":
        inner = _evaluate(e[1], s, flags, cyclic)
        of_rows = e[1][0] == "select"  # rows with one id are counted one by one there
        n = np.bincount(s.row_trace[flags[e[1][1]]] if of_rows else s.trace[inner], minlength=s.traces)
        return inner & _COUNTED[e[2]](n, e[3])[s.trace]
    left, right = _evaluate(e[1], s, flags, cyclic), _evaluate(e[2], s, flags, cyclic)
    if e[0] == "either":
        return left | right
    if e[0] == "both":
        return (left | right) & (s.holds(left) & s.holds(right))[s.trace]
    op, negated, union = e[3:]
    if op in (">>", "<<"):
        cyclic |= s.levels()[1] & (s.holds(left) | s.holds(right) if union else s.holds(right) if negated else s.holds(left) & s.holds(right))
    hit = s.related_to(op, left)
    matched = right & (~hit if negated else hit)
    return left | matched if union else matched


def spansets(e: tuple, leaves: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (trace_id, start_time_ns, latest, span_ids) of the traces with a selected span; no span_ids where spans form a cycle."""

    def run(batches):
        for table in whole(batches):
            s = Spans(table)
            flags = [_one(table.column(f"_leaf{i}")).to_numpy(zero_copy_only=False) for i in range(leaves)]
            cyclic = np.zeros(s.traces, bool)
            found = _evaluate(e, s, flags, cyclic)
            out = np.flatnonzero(s.holds(found) | cyclic)
            if not len(out):
                continue
            time = _one(table.column("start_time_ns"))
            first = np.searchsorted(s.row_trace, out)
            start = np.minimum.reduceat(pc.fill_null(time, _MOST).to_numpy(), np.searchsorted(s.row_trace, np.arange(s.traces)))[out]
            latest = np.maximum.reduceat(pc.fill_null(time, _LEAST).to_numpy(), np.searchsorted(s.row_trace, np.arange(s.traces)))[out]
            nodes = np.flatnonzero(found & ~cyclic[s.trace])
            sizes = np.bincount(s.trace[nodes], minlength=s.traces)[out]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), s.span_ids.take(s.first_row[nodes]), mask=pa.array(cyclic[out]))
            yield pa.RecordBatch.from_arrays([s.trace_ids.take(first), pa.array(start, mask=start == _MOST), pa.array(latest, mask=latest == _LEAST), ids], ["trace_id", "start_time_ns", "latest", "span_ids"])

    return run
