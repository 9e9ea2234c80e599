"""Map expressions that don't depend on session settings."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(*maps: Column) -> Column:
    """Maps merged; for keys in several, the later map wins."""

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high)

    return functools.reduce(over, maps)


def flat(m: Column) -> Column:
    """Sorted key=value text of a map."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")


def sanitized(value: Column, kind: str) -> Column:
    """Scalars and lists of them as they are, nested values as JSON text."""
    nested = kind.startswith(("struct", "map")) or "<struct" in kind or "<map" in kind
    return F.to_json(value) if nested else value
