"""Vector expressions over array<double> columns (F1-F4, J9): all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-8


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either is null or the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """F2"""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """a zero vector has similarity 0 (the norms are held above EPS)."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def normalised(a: Column) -> Column:
    """a / |a|; null for the zero vector."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length))


def euclid(*pairs: tuple[Column, Column]) -> Column:
    """F3"""
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def edge_weight(distance: Column, similarity: Column, gamma: float = 1.0, beta: float = 1.0) -> Column:
    """distance plus gamma times what the similarity lacks to 1."""
    return beta * distance + gamma * (1.0 - F.least(similarity, F.lit(1.0)))
