"""Layered embeddings: shape checks, layer choice, group means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import LAYER_DIM, N_LAYERS, SCORED_LAYER_FROM_END
from weekpanel.functions import vectors


def valid_layers(df: DataFrame, n_layers: int = N_LAYERS, dim: int = LAYER_DIM, col: str = "embedding") -> DataFrame:
    """Keep embeddings of ``n_layers`` layers whose first layer has ``dim`` components."""
    return df.filter(vectors.has_shape(F.col(col), n_layers, dim))


def pick_layer(
    df: DataFrame, from_end: int = SCORED_LAYER_FROM_END, col: str = "embedding", out: str = "layers"
) -> DataFrame:
    """The layer at that place from the end, as a list of one layer; an empty list if there are fewer."""
    return df.withColumn(out, vectors.listed_layer_from_end(F.col(col), from_end))


def flatten_layers(df: DataFrame, col: str = "layers", out: str = "vector") -> DataFrame:
    """Concatenate the picked layers to one vector."""
    return df.withColumn(out, F.flatten(col))


def union_years(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several tables with the same columns, matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first


def mean_embedding(
    df: DataFrame, keys: Sequence[str], col: str = "embedding", out: str = "embedding", layered: bool = False
) -> DataFrame:
    """Element-wise mean of ``col`` per group, with ``message_count`` rows per group.

    The mean is a built-in vector aggregate with map-side partial sums: a group that holds a third of all rows
    sends one vector per task, and no row is exploded into its components. Vectors of a group must have one
    length; null vectors are left out. ``layered`` takes and gives lists of layers of equal width.
    """
    return _group_mean(df, keys, col, out, None, layered)


def weighted_mean_embedding(
    df: DataFrame,
    keys: Sequence[str],
    weight: str,
    col: str = "embedding",
    out: str = "weighted_embedding",
    layered: bool = False,
) -> DataFrame:
    """Like :func:`mean_embedding` with a non-negative weight per row; rows of weight 0 or null do not count."""
    return _group_mean(df, keys, col, out, weight, layered)


def _group_mean(
    df: DataFrame, keys: Sequence[str], col: str, out: str, weight: str | None, layered: bool
) -> DataFrame:
    rows = df.filter(F.col(col).isNotNull())
    if weight is not None:
        rows = rows.filter(F.col(weight) != 0)
    flat = F.flatten(col) if layered else F.col(col)
    value = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    n_layers = F.size(col) if layered else F.lit(1)
    rows = rows.select(*keys, array_to_vector(flat).alias("_vector"), value.alias("_weight"), n_layers.alias("_layers"))
    means = rows.groupBy(*keys).agg(
        Summarizer.mean(F.col("_vector"), F.col("_weight")).alias("_mean"),
        F.count("*").alias("message_count"),
        F.max("_layers").alias("_layers"),
    )
    mean = vector_to_array("_mean")
    if layered:
        width = (F.size(mean) / F.col("_layers")).cast("int")
        mean = F.transform(F.sequence(F.lit(0), F.col("_layers") - 1), lambda i: F.slice(mean, i * width + 1, width))
    return means.select(*keys, mean.alias(out), "message_count")
