"""Log lines: partial-line reassembly, remapping to structured records, tailing and rendering."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical_json, floor_div, severity_band, severity_number

MOST_BYTES = 1 << 20


class Assembler:
    """Lines from the chunks of one id, fed in order: bytes are kept up to the cap, and a line that reaches it ends there.

    The first chunk's time and source stay.  What follows a line that was cut is a line of its own.
    """

    def __init__(self, most_bytes: int):
        self.most = most_bytes
        self.clear()

    def clear(self) -> None:
        self.head: tuple | None = None
        self.parts: list[bytes] = []
        self.size = 0

    def push(self, time_ns: int | None, source: str | None, text: str | None, last: bool) -> tuple | None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if self.head is None:
            self.head = (time_ns, source)
        self.parts.append(raw[: max(0, self.most - self.size)])
        self.size += len(self.parts[-1])
        return self.take() if last or self.size >= self.most else None

    def take(self) -> tuple | None:
        """The line so far; a character that the cap has cut in two goes."""
        if self.head is None:
            return None
        out = (*self.head, b"".join(self.parts).decode("utf-8", "ignore"))
        self.clear()
        return out


_LINE = "time_ns long, source string, line string"


def reassemble(chunks: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Whole lines from chunks (chunk_id, ordinal, time_ns, source, text, and if there is one, last): a chunk without an
    id is a line already; a line that has no last chunk ends with what there is.

    Chunks stream through sorted partitions, so a task holds one unfinished line, of most_bytes at most.
    """
    import pyarrow as pa

    def run(batches):
        now, lines, held = None, [], Assembler(most_bytes)
        for batch in batches:
            for chunk, time_ns, source, text, last in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "time_ns", "source", "text", "last")), strict=True):
                if chunk != now:
                    lines.append(held.take())
                    now = chunk
                lines.append(held.push(time_ns, source, text, last))
            found = [x for x in lines if x]
            lines.clear()
            yield pa.RecordBatch.from_pylist([dict(zip(("time_ns", "source", "line"), x, strict=True)) for x in found], schema=kind)
        if rest := held.take():
            yield pa.RecordBatch.from_pylist([dict(zip(("time_ns", "source", "line"), rest, strict=True))], schema=kind)

    kind = pa.schema([("time_ns", pa.int64()), ("source", pa.string()), ("line", pa.string())])
    whole = chunks.where("chunk_id is null").select("time_ns", "source", F.col("text").alias("line"))
    last = F.coalesce(F.col("last"), F.lit(False)) if "last" in chunks.columns else F.lit(False)
    parts = chunks.where("chunk_id is not null").select("chunk_id", "ordinal", "time_ns", "source", "text", last.alias("last"))
    dealt = parts.repartition("chunk_id").sortWithinPartitions("chunk_id", "ordinal")
    return whole.unionByName(dealt.mapInArrow(run, _LINE))


def reassemble_stream(chunks: DataFrame, most_bytes: int = MOST_BYTES, idle: str | None = None) -> DataFrame:
    """The same over a stream of chunks, whose last one is marked: the state of an id is its unfinished line.

    With idle, an id that is silent for that long gives what it has; give it to queries that run on, since a timeout
    keeps asking for batches and a query over what is available now would not end.
    """
    import pandas as pd

    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key, frames, state):
        held = Assembler(most_bytes)
        if state.exists:
            time_ns, source, raw = state.get
            held.head, held.parts, held.size = (time_ns, source), [bytes(raw)], len(raw)
        found = []
        if state.hasTimedOut:
            found.append(held.take())
        rows = [r for frame in frames for r in frame.itertuples(index=False)]
        for r in sorted(rows, key=lambda r: r.ordinal):
            found.append(held.push(int(r.time_ns), r.source, r.text, bool(r.last)))
        if held.head is None:
            state.remove()
        else:
            state.update((*held.head, b"".join(held.parts)))
            if wait:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame([x for x in found if x], columns=["time_ns", "source", "line"])

    keyed = chunks.select("chunk_id", "ordinal", "time_ns", "source", "text", "last").where("chunk_id is not null").groupBy("chunk_id")
    whole = chunks.where("chunk_id is null").select("time_ns", "source", F.col("text").alias("line"))
    return whole.unionByName(keyed.applyInPandasWithState(step, _LINE, "time_ns long, source string, raw binary", "append", "ProcessingTimeTimeout" if wait else "NoTimeout"))


def follow(spark, path: str, after_observed_ns: int | None = None, where=None) -> DataFrame:
    """The log table of a store as a stream: rows of files as they are added, by appends and not by compactions."""
    from ..sources import schema as S

    rows = spark.readStream.schema(S.schema("logs")).option("pathGlobFilter", "{part,b}-*.parquet").parquet(f"{path}/logs")
    if after_observed_ns is not None:
        rows = rows.where(F.col("observed_time_ns") > F.lit(after_observed_ns).cast("long"))
    return rows if where is None else rows.where(where)


def tail(logs: DataFrame, after_observed_ns: int | None, limit: int | None = None) -> DataFrame:
    """What arrived after a point in arrival time, in order of arrival; without one, the latest by event time."""
    if after_observed_ns is None:
        out = logs.orderBy(F.col("time_ns").desc(), "body")
        return (out if limit is None else out.limit(limit)).orderBy("time_ns", "body")
    out = logs.where(F.col("observed_time_ns") > F.lit(after_observed_ns).cast("long")).orderBy("observed_time_ns", "time_ns", "body")
    return out if limit is None else out.limit(limit)


_GLOG = re.compile(r"^([IWEF])(\d{4}|\d{8}) (\d{2}:\d{2}:\d{2})\.(\d+)\s+(\d+) ([^\s:]+):(\d+)\] (.*)$", re.S)
_PAIR = re.compile(r'([A-Za-z_][\w.\-/]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)')
_COMMA = re.compile(r"^\s*[A-Za-z_][\w.\-]*=[^,]*(?:,\s*[A-Za-z_][\w.\-]*=[^,]*)+$")
#: Keys that carry the message, the level and the time.
_MESSAGE, _LEVEL, _TIME = ("msg", "message", "event", "log"), ("level", "lvl", "severity", "loglevel"), ("ts", "time", "timestamp", "@timestamp")
_SANE_NS = 26 * 3_600_000_000_000


def _value(text: str) -> object:
    return json.loads(text) if text.startswith('"') else text


def _glog_time(day: str, clock: str, fraction: str, observed_ns: int) -> int | None:
    """Nanoseconds of a glog line; without a year, that of the observation, or the one beside it that is nearer."""
    seen = datetime.fromtimestamp(observed_ns // 10**9, UTC).year
    found = []
    for year in [int(day[:4])] if len(day) == 8 else [seen - 1, seen, seen + 1]:
        try:
            at = datetime.strptime(f"{year}{day[-4:]} {clock}", "%Y%m%d %H:%M:%S").replace(tzinfo=UTC)
        except ValueError:
            continue
        found.append(int(at.timestamp()) * 10**9 + int(fraction[:9].ljust(9, "0")))
    return min(found, key=lambda ns: abs(ns - observed_ns), default=None)


def _fields(line: str, observed_ns: int) -> dict | None:
    stripped = line.strip()
    if stripped.startswith("{"):
        try:
            out = json.loads(stripped)
            return out if isinstance(out, dict) else None
        except ValueError:
            pass
    if m := _GLOG.match(stripped):
        level = {"I": "info", "W": "warn", "E": "error", "F": "fatal"}[m[1]]
        if stamp := _glog_time(m[2], m[3], m[4], observed_ns):
            return {"level": level, "ts": stamp, "pid": int(m[5]), "file": m[6], "line": int(m[7]), "msg": m[8]}
    if _COMMA.match(stripped) and '"' not in stripped:
        return dict(p.strip().split("=", 1) for p in stripped.split(","))
    pairs = list(_PAIR.finditer(stripped))
    if pairs:
        try:
            found = {m[1]: _value(m[2]) for m in pairs}
        except ValueError:
            return None
        rest = _PAIR.sub("", stripped).strip()
        if not rest:
            return found
        if len(pairs) >= 2 and stripped[pairs[0].start() :].strip() == " ".join(m[0] for m in pairs):
            return {"msg": stripped[: pairs[0].start()].strip()} | found
    return None


def _nanoseconds(value: object) -> int | None:
    """A time by its magnitude in s, ms, us or ns, or as ISO 8601."""
    if isinstance(value, str):
        try:
            return int(datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None).replace(tzinfo=UTC).timestamp() * 1e9) if "T" in value or " " in value else _nanoseconds(float(value))
        except ValueError:
            return None
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    size = abs(value)
    for limit, unit in ((1e11, 1e9), (1e14, 1e6), (1e17, 1e3)):
        if size < limit:
            return int(value * unit)
    return int(value)


def structured(line: str, observed_ns: int) -> dict:
    """time_ns, severity_number, severity_text, body, attributes, trace_id and span_id of one line."""
    fields = _fields(line, observed_ns)
    if fields is None:
        return {"time_ns": observed_ns, "severity_number": 0, "severity_text": None, "body": line, "attributes": "{}", "trace_id": None, "span_id": None}
    fields = dict(fields)
    take = lambda names: next((fields.pop(k) for k in names if k in fields), None)
    message, level, stamp = take(_MESSAGE), take(_LEVEL), take(_TIME)
    ns = _nanoseconds(stamp)
    if ns is None or abs(ns - observed_ns) > _SANE_NS:
        ns = observed_ns
    ids = {}
    for name, keys, size in (("trace_id", ("trace_id", "traceId", "traceid"), 16), ("span_id", ("span_id", "spanId", "spanid"), 8)):
        raw = take(keys)
        ids[name] = bytes.fromhex(raw) if isinstance(raw, str) and re.fullmatch(rf"[0-9a-fA-F]{{{2 * size}}}", raw) else None
    number = severity_number(str(level)) if level is not None else None
    body = message if isinstance(message, str) else "" if message is None else canonical_json(message)
    return {"time_ns": ns, "severity_number": number or 0, "severity_text": None if level is None else str(level), "body": body, "attributes": canonical_json(fields), **ids}


def remap(lines: DataFrame) -> DataFrame:
    """Structured records from (line, observed_time_ns, service): JSON, klog, comma pairs, logfmt, or the line as it is."""
    import pyarrow as pa

    kind = pa.schema([("time_ns", pa.int64()), ("observed_time_ns", pa.int64()), ("service", pa.string()), ("severity_number", pa.int16()), ("severity_text", pa.string()), ("body", pa.string()), ("attributes", pa.string()), ("trace_id", pa.binary()), ("span_id", pa.binary())])

    def run(batches):
        for b in batches:
            columns = zip(*(b.column(c).to_pylist() for c in ("line", "observed_time_ns", "service")), strict=True)
            yield pa.RecordBatch.from_pylist([structured(line or "", ns or 0) | {"observed_time_ns": ns, "service": service} for line, ns, service in columns], schema=kind)

    ddl = "time_ns long, observed_time_ns long, service string, severity_number short, severity_text string, body string, attributes string, trace_id binary, span_id binary"
    return lines.select("line", "observed_time_ns", "service").mapInArrow(run, ddl)


def _quoted(text: Column) -> Column:
    bad = (text == "") | text.rlike(r'[\s"\\=\x00-\x1f]')
    return F.when(bad, F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))).otherwise(text)


def render_logfmt(logs: DataFrame) -> DataFrame:
    """Records as logfmt lines: ts, level, msg, then the attributes by key."""
    ns = F.col("time_ns")
    micros = F.timestamp_micros(floor_div(ns, 1000))
    stamp = F.concat(F.date_format(micros, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad(F.pmod(ns, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))
    level = F.coalesce("severity_text", severity_band(F.col("severity_number")))
    pairs = F.array_sort(F.map_entries(F.from_json("attributes", "map<string,string>")))
    rest = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), _quoted(F.coalesce(p["value"], F.lit(""))))), " ")
    line = F.concat(F.lit("ts="), stamp, F.lit(" level="), _quoted(level), F.lit(" msg="), _quoted(F.col("body")))
    return logs.select("time_ns", F.when(rest != "", F.concat_ws(" ", line, rest)).otherwise(line).alias("line"))
