"""Chat formatting by incremental black-box rendering (operator 10).

A template is any object with ``render(messages) -> str`` (messages are
(role, text) pairs), ``escape`` / ``unescape`` and ``read(chunk) -> (role,
text)``.  The formatter never looks inside it: it renders successive prefixes
of a conversation, compares consecutive outputs to find the span each turn
added, renders the last turn with two probe texts to find where its text
stands inside the span, and marks the conversation when an output does not
start with the one before (the template rewrites history).

Rows stream through sorted partitions, one turn at a time.  Prefixes are whole,
whatever their length, so a rewrite however far back is found; rendering costs
the square of a conversation's turns.  A template may declare ``memory``, a
number of turns: what it renders for a turn then depends on the first turn and
on that many before it at most, and prefixes are cut to those, for time and
memory in proportion to the turns.  Nothing else cuts a prefix.

A template that rewrites history has chunks that need not read back; the digest
then has null digests of the conversation, and ``rewrites`` set.

Defined cases: null text or role reads as empty; a null conv_id is one
conversation; turns with equal numbers are ordered by role, then text;
repeated rows are turns of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TURNS = "conv_id long, position long, role string, chunk string, span_start long, span_end long, text_start long, text_end long, loss boolean, rewrites boolean"


class InstructTemplate:
    """``<s>[INST] user [/INST] assistant </s>``; other roles are named in their mark.

    Inside texts, a backslash is doubled and ``<`` and ``[`` get one behind
    them, so no control string can stand in a text and every text can be read back.
    A turn is rendered the same whatever stands before it.
    """

    memory = 1

    def escape(self, text: str) -> str:
        return re.sub(r"[<\[]|\\", lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"([<\[])\\|\\\\", lambda m: m[1] or "\\", text)

    def render(self, messages: list[tuple[str, str]]) -> str:
        return "".join(self._turn(*m) for m in messages)

    def _turn(self, role: str, text: str) -> str:
        if role == "user":
            return f"<s>[INST] {self.escape(text)} [/INST]"
        if role == "assistant":
            return f" {self.escape(text)} </s>"
        return f"<s>[ROLE][{self.escape(role)}[/NAME] {self.escape(text)} [/ROLE]"

    def read(self, chunk: str) -> tuple[str, str]:
        """Role and text of one rendered turn."""
        if chunk.startswith("<s>[INST] ") and chunk.endswith(" [/INST]"):
            return "user", self.unescape(chunk[10:-8])
        if chunk.startswith("<s>[ROLE][") and chunk.endswith(" [/ROLE]"):
            name, _, rest = chunk[10:-8].partition("[/NAME] ")
            return self.unescape(name), self.unescape(rest)
        if chunk.startswith(" ") and chunk.endswith(" </s>"):
            return "assistant", self.unescape(chunk[1:-5])
        raise ValueError("not a rendered turn")


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


class Incremental:
    """The spans of one conversation's turns, fed turn by turn."""

    def __init__(self, template):
        self.template, self.memory = template, getattr(template, "memory", None)
        self.messages: list[tuple[str, str]] = []
        self.out, self.at, self.rewrites, self.position = template.render([]), 0, False, 0

    def feed(self, role: str, text: str) -> tuple[str, int, int, int, int]:
        """The chunk that this turn adds, its span, and the span of its text."""
        render = self.template.render
        if self.memory is not None and len(self.messages) > self.memory + 1:
            self.messages = [self.messages[0], *self.messages[len(self.messages) - self.memory :]]
            self.out = render(self.messages)
        now = render([*self.messages, (role, text)])
        shared = len(self.out)
        if not now.startswith(self.out):
            self.rewrites, shared = True, _common(self.out, now)
        chunk = now[shared:]
        one, two = render([*self.messages, (role, "0")]), render([*self.messages, (role, "1")])
        head = max(0, _common(one, two) - shared)
        tail = max(0, len(one) - shared - head - 1)
        start = self.at
        self.at += len(chunk)
        self.messages.append((role, text))
        self.out, self.position = now, self.position + 1
        return chunk, start, self.at, min(start + head, self.at), max(start + head, self.at - tail)


def _format(template, loss_roles: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now or state is None:
                    now, state = conv, Incremental(template)
                role = role or ""
                chunk, *spans = state.feed(role, text or "")
                rows.append((conv, state.position - 1, role, chunk, *spans, role in loss_roles, state.rewrites))
            names = [x.strip().split(" ")[0] for x in _TURNS.split(",")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return run


def format_turns(conversations: DataFrame, template=None, loss_roles: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """One row per turn, in order within partitions that hold whole conversations: its rendered chunk, the chunk's
    and the text's span in the formatted conversation, whether it bears loss, and whether the template has rewritten history so far."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(template or InstructTemplate(), frozenset(loss_roles)), _TURNS)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def _digest(template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, state = None, None

        def close():
            if state:
                read = not state[5]
                done.append((now, state[0], state[1].hexdigest() if read else None, state[2] if read else None, state[3].hexdigest() if read else None, state[4], state[5]))

        def out():
            columns = list(zip(*done, strict=True)) if done else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = [x.strip().split(" ")[0] for x in _DIGEST.split(",")]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

        for batch in batches:
            names = ("conv_id", "position", "chunk", "span_start", "text_start", "text_end", "loss", "rewrites")
            for conv, position, chunk, start, a, b, loss, rewrites in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if position == 0:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[0] += 1
                state[4] += len(chunk)
                state[5] |= rewrites
                if state[5]:
                    continue
                role, text = template.read(chunk)
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    under = template.unescape(chunk[a - start : b - start])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
            if len(done) >= 1000:
                yield out()
        close()
        yield out()

    return run


def digest(turns: DataFrame, template=None) -> DataFrame:
    """What reads back from the chunks of format_turns, per conversation."""
    return turns.mapInArrow(_digest(template or InstructTemplate()), _DIGEST)
