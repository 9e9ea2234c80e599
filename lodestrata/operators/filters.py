"""Metadata filters: nested dicts compiled to one boolean column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of stored keys.
ALIASES = {"version": "game_version", "type": "item_type"}


def compile_filter(where: dict[str, Any] | None, field: Callable[[str], Column] = F.col) -> Column:
    """``{k: v}``, ``{k: {"$eq"|"$ne": v}}``, ``{"$and"|"$or": [...]}``; None and empty dicts allow all rows.

    Values are compared as strings and null matches neither ``$eq`` nor ``$ne``. An unknown operator is an error.
    """
    if not where:
        return F.lit(True)
    parts: list[Column] = []
    for key, want in where.items():
        if key in ("$and", "$or"):
            some = [compile_filter(w, field) for w in want if w]
            if some:
                parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), some))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
                if op not in ("$eq", "$ne"):
                    raise ValueError(f"unknown operator {op}")
                column = field(key).cast("string")
                parts.append(column == str(value) if op == "$eq" else column != str(value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def json_field(column: str = "metadata") -> Callable[[str], Column]:
    """Fields of a JSON column, under their stored names."""
    return lambda key: F.get_json_object(F.col(column), f"$.{ALIASES.get(key, key)}")


def version_filter(version: str | None) -> dict[str, Any] | None:
    clean = (version or "").strip().lower()
    return {"game_version": {"$eq": clean}} if clean else None


def version_and(version: str | None, *others: dict[str, Any] | None) -> dict[str, Any] | None:
    parts = [w for w in (version_filter(version), *others) if w]
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def version_not(version: str | None) -> dict[str, Any] | None:
    clean = (version or "").strip().lower()
    return {"game_version": {"$ne": clean}} if clean else None


def golden_filter(where: dict[str, str], default_version: str) -> dict[str, str]:
    """A golden question's filter under stored names: the broad type ``item`` goes, a missing version is the default."""
    out = {ALIASES.get(k, k): v for k, v in where.items()}
    if out.get("item_type") == "item":
        del out["item_type"]
    return {"game_version": default_version} | out
