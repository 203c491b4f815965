"""Vector expressions on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; a norm of zero counts as one, so a zero vector has distance one to everything."""
    na, nb = norm(a), norm(b)
    return 1 - dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))
