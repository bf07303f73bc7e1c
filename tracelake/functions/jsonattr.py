"""Typed access to attribute objects kept as JSON text."""

from __future__ import annotations

import base64
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A number and nothing else: no unit letters, no white space.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def _value(json_text: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json_text), "$[" + json.dumps(key) + "]", "variant")


def json_get_str(json_text: Column, key: str | None) -> Column:
    """The value at a top-level key when it is a JSON string, else null."""
    if key is None:
        return F.lit(None).cast("string")
    v = _value(json_text, key)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(json_text), "$[" + json.dumps(key) + "]", "string"))


def json_get_num(json_text: Column, key: str | None) -> Column:
    """The value at a top-level key as a double: numbers, and strings that read as one; else null."""
    if key is None:
        return F.lit(None).cast("double")
    kind = F.schema_of_variant(_value(json_text, key))
    path = "$[" + json.dumps(key) + "]"
    text = F.try_variant_get(F.try_parse_json(json_text), path, "string")
    number = F.try_variant_get(F.try_parse_json(json_text), path, "double")
    as_text = F.when(F.lower(text).isin("inf", "+inf", "infinity", "+infinity"), F.lit(math.inf)).when(F.lower(text).isin("-inf", "-infinity"), F.lit(-math.inf)).when(F.lower(text).isin("nan", "+nan", "-nan"), F.lit(math.nan)).when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(kind == "STRING", as_text).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), number)


def json_keys(json_text: Column) -> Column:
    return F.json_object_keys(json_text)


def string_map(json_text: Column) -> Column:
    """The string-valued members as a map."""
    every = F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>")
    kept = F.map_filter(every, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(kept, lambda k, v: F.try_variant_get(v, "$", "string"))


def canonical_json(value: object) -> str:
    """Canonical text of an attribute value: sorted keys, no white space, doubles keep a decimal point,
    bytes as base64, non-finite doubles as {"$f": name}."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{canonical_json(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, bytes):
        return json.dumps(base64.b64encode(value).decode())
    if isinstance(value, float) and not math.isfinite(value):
        return '{"$f":"' + ("nan" if math.isnan(value) else "inf" if value > 0 else "-inf") + '"}'
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e16:
        return f"{value:.1f}"
    return json.dumps(value, ensure_ascii=False)
