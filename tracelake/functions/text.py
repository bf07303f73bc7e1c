"""Terms, identifiers, severities and durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms are lower-cased runs of Unicode letters, marks that count as alphabetic, and numbers.
_BETWEEN_TERMS = r"[^\p{IsAlphabetic}\p{N}]+"

#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}

#: The lowest severity number of each band.
BANDS = (("FATAL", 21), ("ERROR", 17), ("WARN", 13), ("INFO", 9), ("DEBUG", 5), ("TRACE", 1))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN_TERMS), lambda x: x != "")


def matches(text: Column, query: str | None) -> Column:
    """Whether text holds every term of query: null for null text, false for a null query, true for one without terms."""
    if query is None:
        return F.lit(False)
    wanted = F.array_distinct(tokens(F.lit(query)))  # folded to a constant, by the rule that cuts the text
    return F.when(text.isNotNull(), F.size(F.array_except(wanted, tokens(text))) == 0)


def floor_div(value: Column, by: int) -> Column:
    """value / by rounded down, in longs: nanoseconds do not fit doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(by).cast("long")), F.lit(by).cast("long"))


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(value))


def severity_band(number: Column) -> Column:
    out = F.lit("UNSPECIFIED")
    for name, least in reversed(BANDS):
        out = F.when(number >= least, name).otherwise(out)
    return out


def severity_name(number: int) -> str:
    return next((name for name, least in BANDS if number >= least), "UNSPECIFIED")


def severity_number(name: str) -> int | None:
    """The least number of a severity by name, in any case and with the usual long and short forms."""
    short = {"warning": "warn", "err": "error", "critical": "fatal", "crit": "fatal", "panic": "fatal", "emerg": "fatal", "alert": "fatal", "information": "info", "notice": "info", "dbg": "debug"}
    wanted = name.strip().lower()
    return dict((n.lower(), v) for n, v in BANDS).get(short.get(wanted, wanted))


#: Bytes of each unit.
SIZES = {"": 1, "b": 1, "kb": 1_000, "mb": 1_000_000, "gb": 1_000_000_000, "tb": 1_000_000_000_000, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}


def parse_bytes(text: str) -> int:
    """Bytes of a literal as 64MiB, 1.5gb or 4096."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in SIZES:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * SIZES[m[2].lower()]) if "." in m[1] else int(m[1]) * SIZES[m[2].lower()]


def parse_duration(text: str, bare: str | None = None) -> int:
    """Nanoseconds of a literal as 1h30m; bare is the unit of a number without one, if that is allowed."""
    parts = re.findall(r"(\d+)(ns|us|µs|ms|s|m|h|d)", text)
    if parts and "".join(a + b for a, b in parts) == text:
        return sum(int(n) * UNITS[u.replace("µ", "u")] for n, u in parts)
    if bare and text.isdigit():
        return int(text) * UNITS[bare]
    raise ValueError(f"not a duration: {text!r}")
