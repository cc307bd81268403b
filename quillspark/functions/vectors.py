"""Columns for embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(vector: Column) -> Column:
    """A vector of length 1 with the same direction; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda x: (x / norm).cast("float")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(lengths == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / lengths)


def vector_state(vector: Column, dimension: int) -> Column:
    """valid, missing, or wrong dimension."""
    return F.when(vector.isNull(), "missing").when(F.size(vector) != dimension, "wrong dimension").otherwise("valid")
