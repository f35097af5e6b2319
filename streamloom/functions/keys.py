"""Join keys taken from a message; a key that is missing is the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_header(headers: Column, name: str) -> Column:
    """A header's value as text."""
    return F.coalesce(F.element_at(headers, F.lit(name)).cast("string"), F.lit(""))


def from_routing_key(key: Column) -> Column:
    return F.coalesce(key, F.lit(""))


def from_json(payload: Column, name: str) -> Column:
    """A top-level JSON field: strings as they are, integers and booleans in their usual form.

    Floats from 1e21 on, null and nested values have forms of their own elsewhere; here they are what
    Spark prints, and null counts as missing.
    """
    return F.coalesce(F.get_json_object(payload.cast("string"), f"$.{name}"), F.lit(""))


def label_key(labels: Column) -> Column:
    """Labels in canonical order: ``k="v"`` joined by commas; empty for no labels."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
