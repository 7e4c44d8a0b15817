"""Embedding vectors held as arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingomark.functions.text import let, token_hash

# Fixed value: standard deviation of the noise that replaces all-zero vectors.
NOISE_SCALE = 0.01


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def guard(vector: Column, size: int) -> Column:
    """The vector as doubles, or zeros when it is NULL, has another size or holds NULL or NaN."""
    bad = (F.array_size(vector) != size) | F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    return F.when(F.coalesce(bad, F.lit(True)), zeros(size)).otherwise(vector.cast("array<double>"))


def is_zero(vector: Column) -> Column:
    return F.forall(vector, lambda v: v == 0)


def _uniform(key: Column) -> Column:
    """Hash of ``key`` inside the open unit interval."""
    return (token_hash(key) + 0.5) / float(2**32)


def noise(key: Column, size: int, scale: float = NOISE_SCALE) -> Column:
    """Normal noise per (key, dimension), the same whatever the partitioning."""

    def draw(i: Column) -> Column:
        name = F.concat_ws(":", key.cast("string"), i.cast("string"))
        radius = F.sqrt(-2.0 * F.log(_uniform(F.concat(name, F.lit(":r")))))
        angle = 2.0 * math.pi * _uniform(F.concat(name, F.lit(":a")))
        return radius * F.cos(angle) * scale

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), draw)


def replace_zero(vector: Column, key: Column, size: int, scale: float = NOISE_SCALE) -> Column:
    return F.when(is_zero(vector), noise(key, size, scale)).otherwise(vector)


def masked_mean(hidden: Column, mask: Column, size: int) -> Column:
    """Mean of token vectors (array of arrays) over the tokens whose mask is 1."""
    weighted = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda v: v * m))
    total = F.aggregate(
        weighted, zeros(size), lambda acc, h: F.zip_with(acc, h, lambda a, b: a + b)
    )
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m), F.lit(1e-9))
    return let(weight, lambda w: F.transform(total, lambda v: v / w))
