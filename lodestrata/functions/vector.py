"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where sizes differ. Stored norms save the work of computing them."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when(F.size(a) == F.size(b), F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb)))


def euclid(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


#: metric -> (score expression, whether more is better)
METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False)}


def valid(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim)


def literal(v: Column) -> Column:
    """A vector's text form, eight significant digits."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.8g", x.cast("double"))), ","), F.lit("]"))
