"""SQL names for the functions, as SQL functions that the optimizer sees through."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .jsonattr import NUMBER

_TOKENS = r"filter(split(lower({0}), '[^\\p{{IsAlphabetic}}\\p{{N}}]+'), x -> x <> '')"


@pandas_udf(StringType())
def _hex(value: pd.Series) -> pd.Series:
    return value.map(lambda b: b.hex(), na_action="ignore")


def register(spark: SparkSession, shadow: bool = False) -> None:
    """Define matches, json_get_str, json_get_num, hex_lower and histogram_quantile for spark.sql.

    With shadow also hex, in lower case; it hides the built-in one from the whole session, so give it one of its own.
    """
    tokens, query = _TOKENS.format("t"), _TOKENS.format("q")
    # a map is asked for the key, which may hold any character; a path would need it quoted
    v = "try_variant_get(try_parse_json(j), '$', 'map<string,variant>')[k]"
    kind = f"schema_of_variant({v})"
    text = f"try_variant_get({v}, '$', 'string')"
    define = "create or replace temporary function"
    spark.sql(f"{define} matches(t string, q string) returns boolean return case when q is null then false when t is not null then size(array_except({query}, {tokens})) = 0 end")
    spark.sql(f"{define} json_get_str(j string, k string) returns string return case when {kind} = 'STRING' then {text} end")
    number = NUMBER.replace("\\", "\\\\")
    spark.sql(
        f"{define} json_get_num(j string, k string) returns double return case when {kind} = 'STRING' then case when lower({text}) in ('inf', '+inf', 'infinity', '+infinity') then double('Infinity') "
        f"when lower({text}) in ('-inf', '-infinity') then double('-Infinity') when lower({text}) in ('nan', '+nan', '-nan') then double('NaN') when {text} rlike '{number}' then try_cast({text} as double) end "
        f"when {kind} rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$' then try_variant_get({v}, '$', 'double') end"
    )
    spark.sql(f"{define} hex_lower(b binary) returns string return lower(to_char(b, 'hex'))")
    if shadow:
        spark.udf.register("hex", _hex)  # a SQL function may not replace a built-in one
    total = "element_at(r, -1)"
    running = "transform(counts, (x, i) -> aggregate(slice(counts, 1, i + 1), cast(0 as double), (a, b) -> a + b))"
    at = f"array_position(transform(r, x -> x >= phi * {total}), true)"
    lower = f"case when {at} = 1 then least(get(bounds, 0), 0.0d) else get(bounds, cast({at} as int) - 2) end"
    upper, own = f"get(bounds, cast({at} as int) - 1)", f"get(counts, cast({at} as int) - 1)"
    inside = f"case when {own} = 0 then {upper} else {lower} + ({upper} - {lower}) * ((phi * {total} - (get(r, cast({at} as int) - 1) - {own})) / {own}) end"
    beyond = "case when size(bounds) = 0 then double('Infinity') else get(bounds, size(bounds) - 1) end"
    value = f"element_at(transform(array({running}), r -> case when {total} = 0 then double('NaN') when {at} = 0 or {at} > size(bounds) then {beyond} else {inside} end), 1)"
    spark.sql(
        f"{define} histogram_quantile(phi double, bounds array<double>, counts array<double>) returns double return case when phi is null or bounds is null or counts is null then null "
        f"when isnan(phi) then double('NaN') when phi < 0 then double('-Infinity') when phi > 1 then double('Infinity') when size(counts) = 0 then double('NaN') else {value} end"
    )
