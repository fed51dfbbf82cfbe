"""Vector expressions and half-precision packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 where the second is shorter than the first or missing."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    value = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(b) < F.size(a), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x))


def normalised(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def pack_half(vector) -> bytes:
    return np.asarray(vector, dtype="<f2").tobytes()


def unpack_half(blob: bytes) -> list[float]:
    return np.frombuffer(blob, dtype="<f2").astype(np.float32).tolist()


def rms(samples: Column) -> Column:
    n = F.size(samples)
    total = F.aggregate(F.transform(samples, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, F.sqrt(total / n)).otherwise(F.lit(0.0))


def line_vector(dims: int, seed: int) -> list[float]:
    """A fixed unit vector from a linear congruential sequence; test queries use it."""
    out, s = [], seed
    for _ in range(dims):
        s = (s * 9301 + 49297) % 233280
        out.append(s / 233280 - 0.5)
    v = np.array(out)
    return (v / np.linalg.norm(v)).tolist()
