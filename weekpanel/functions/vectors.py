"""Expressions over embeddings held as ``array<double>`` or ``array<array<double>>``."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekpanel.fixed_values import FEATURE_SUFFIX


def double_array(values: Iterable[float]) -> Column:
    """A constant array. One parsed expression instead of one call to the JVM per element."""
    numbers = [float(v) for v in values]
    if not all(math.isfinite(v) for v in numbers):
        raise ValueError("constant arrays must hold finite numbers")
    return F.expr(f"array({','.join(f'{v!r}D' for v in numbers)})").cast("array<double>")


def int_array(values: Iterable[int]) -> Column:
    return F.expr(f"array({','.join(str(int(v)) for v in values)})").cast("array<int>")


def has_shape(layers: Column, n_layers: int, dim: int) -> Column:
    """True for ``n_layers`` layers whose first has ``dim`` components; ``get`` gives null on an empty array."""
    return (F.size(layers) == n_layers) & (F.size(F.get(layers, F.lit(0))) == dim)


def layer_from_end(layers: Column, from_end: int) -> Column:
    """The layer at that place from the end; null where there are fewer layers."""
    return F.get(layers, F.size(layers) - F.lit(from_end))


def listed_layer_from_end(layers: Column, from_end: int) -> Column:
    """The same layer in a list; an empty list where there are fewer layers."""
    return F.when(layers.isNotNull(), F.array_compact(F.array(layer_from_end(layers, from_end))))


def source_index(feature: str) -> int:
    """Component number in a feature name such as ``17me``; -1 for any other name."""
    number = feature.removesuffix(FEATURE_SUFFIX)
    named = feature.endswith(FEATURE_SUFFIX) and number.isascii() and number.isdigit() and str(int(number)) == number
    return int(number) if named else -1


def aligned(vector: Column, features: Iterable[str]) -> Column:
    """One component per feature name, in their order; 0.0 for a component the vector does not have."""
    wanted = int_array(source_index(name) for name in features)
    return F.when(
        vector.isNotNull(), F.transform(wanted, lambda i: F.coalesce(F.get(vector, i).cast("double"), F.lit(0.0)))
    )


def standardised(vector: Column, mean: Iterable[float], scale: Iterable[float]) -> Column:
    """(x - mean) / scale per component; a scale of 0 leaves the centred value as it is."""
    centred = F.zip_with(vector, double_array(mean), lambda x, m: x - m)
    return F.zip_with(centred, double_array(s if s != 0 else 1.0 for s in scale), lambda x, s: x / s)


def dot(vector: Column, weights: Iterable[float]) -> Column:
    products = F.zip_with(vector, double_array(weights), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
