"""Discovery of attribute names and values over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_get_str


def _all(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for df in tables.values():
        part = df.select("service", "attributes")
        out = part if out is None else out.unionByName(part)
    return out


def attribute_names(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct top-level keys of every type; service.name when any row has a service."""
    rows = _all(tables)
    keys = rows.select(F.explode(F.json_object_keys("attributes")).alias("name"))
    return keys.unionByName(rows.where("service is not null").limit(1).select(F.lit("service.name").alias("name"))).distinct()


def attribute_values(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct string values of a key."""
    column = F.col("service") if key in ("service", "service.name") else json_get_str(F.col("attributes"), key)
    return _all(tables).select(column.alias("value")).where("value is not null").distinct()
