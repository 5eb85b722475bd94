"""Score ladders and weighted means as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(x: Column, steps: list[tuple[float, float]], otherwise: float = 0.0, strict: bool = False) -> Column:
    """The value of the first step (bound, value) that x reaches, from the highest bound down."""
    out = None
    for bound, value in sorted(steps, reverse=True):
        hit = x > bound if strict else x >= bound
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def weighted_mean(parts: dict[str, float], value, usable) -> Column:
    """Sum of weight * value over the usable parts, divided by their weights when these sum below 1."""
    total = reduce(lambda a, b: a + b, [F.when(usable(k), F.lit(w) * value(k)).otherwise(0.0) for k, w in parts.items()])
    used = reduce(lambda a, b: a + b, [F.when(usable(k), F.lit(w)).otherwise(0.0) for k, w in parts.items()])
    return F.when((used > 0) & (used < 1), total / used).otherwise(total)


def goldfinger(n: Column, happenstance: int = 1, coincidence: int = 2, base: float = 0.50, factor: float = 0.20, most: float = 0.95) -> Column:
    """How far n indicators speak for intent: 0.1 each, then 0.2, then base + factor * ln(n - coincidence + 1), at most `most`."""
    grown = F.least(F.lit(base) + F.log(n - coincidence + 1) * factor, F.lit(most))
    return F.when(n <= 0, 0.0).when(n <= happenstance, n * 0.1).when(n <= coincidence, 0.2).otherwise(grown)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0.0D, (s, x) -> s + x)")


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors, null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
