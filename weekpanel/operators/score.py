"""Linear scores of embeddings: align, standardise, ridge, rescale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.fixed_values import SCORE_HIGH, SCORE_LOW
from weekpanel.functions import vectors


@dataclass(frozen=True)
class Model:
    """A fitted linear model on standardised features, in the order of its features."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float

    @property
    def width(self) -> int:
        """Length of the longest vector the model can read a component from."""
        return 1 + max((vectors.source_index(f) for f in self.features), default=-1)

    def folded(self) -> tuple[list[float], float]:
        """The whole chain as one dot product on the raw vector: align, standardise and ridge are all affine."""
        weights, constant = [0.0] * self.width, self.intercept
        for feature, mean, scale, coef in zip(self.features, self.mean, self.scale, self.coef, strict=True):
            step = coef / (scale if scale != 0 else 1.0)
            constant -= step * mean
            source = vectors.source_index(feature)
            if source >= 0:
                weights[source] += step
        return weights, constant


def collect_models(model: DataFrame) -> dict[str, Model]:
    """The model table as parameters, one model per target: Spark gathers a target's features into one row."""
    feature = F.struct("pos", "feature", "mean", "scale", "coef", "intercept")
    rows = model.groupBy("target").agg(F.sort_array(F.collect_list(feature)).alias("features")).collect()
    return {
        row["target"]: Model(
            tuple(f["feature"] for f in row["features"]),
            tuple(f["mean"] for f in row["features"]),
            tuple(f["scale"] for f in row["features"]),
            tuple(f["coef"] for f in row["features"]),
            row["features"][0]["intercept"],
        )
        for row in rows
    }


def align_features(df: DataFrame, features: Sequence[str], col: str = "vector", out: str = "aligned") -> DataFrame:
    """Put component i where the name ``{i}me`` stands; other names get 0.0."""
    return df.withColumn(out, vectors.aligned(F.col(col), features))


def standardise(
    df: DataFrame, mean: Sequence[float], scale: Sequence[float], col: str = "aligned", out: str = "standardised"
) -> DataFrame:
    return df.withColumn(out, vectors.standardised(F.col(col), mean, scale))


def ridge_score(
    df: DataFrame,
    coef: Sequence[float],
    intercept: float,
    col: str = "standardised",
    out: str = "score",
    as_float: bool = False,
) -> DataFrame:
    """Dot product plus intercept; ``as_float`` rounds it to single precision."""
    return df.withColumn(out, _precision(vectors.dot(F.col(col), coef) + F.lit(float(intercept)), as_float))


def fused_scores(
    df: DataFrame,
    models: Mapping[str, Model],
    col: str = "vector",
    as_float: bool = False,
    arrow: bool = True,
) -> DataFrame:
    """One score column per target, all in one projection: no shuffle and no join of the targets.

    One Arrow function multiplies a whole batch with all targets at once; ``arrow=False`` scores by built-in
    expressions instead. The two add in different orders, so scores may differ in their last bits: the path is the
    caller's choice and never depends on the data or the model.
    """
    folded = {target: model.folded() for target, model in models.items()}
    width = max(model.width for model in models.values())
    if arrow:
        weights = {target: w + [0.0] * (width - len(w)) for target, (w, _) in folded.items()}
        products = _batch_products(list(weights), list(weights.values()))(F.col(col))
        columns = {t: _precision(F.col("_products")[t] + F.lit(folded[t][1]), as_float) for t in models}
        scored = df.withColumn("_products", products)
        return scored.select(*df.columns, *[c.alias(t) for t, c in columns.items()])
    return df.withColumns(
        {
            target: _precision(_fitted_dot(F.col(col), weights) + F.lit(constant), as_float)
            for target, (weights, constant) in folded.items()
        }
    )


def _precision(score: Column, as_float: bool) -> Column:
    return score.cast("float") if as_float else score


def _fitted_dot(vector: Column, weights: Sequence[float]) -> Column:
    """Dot product over the common length; a missing component counts 0."""
    if not weights:
        return F.when(vector.isNotNull(), F.lit(0.0))
    fixed = vectors.double_array(weights)
    products = F.zip_with(vector, fixed, lambda x, w: F.coalesce(x * w, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def _batch_products(targets: list[str], weights: list[list[float]]):
    width = len(weights[0])
    fields = ", ".join(f"`{t}`: double" for t in targets)

    @F.arrow_udf(f"struct<{fields}>")
    def products(column):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        matrix = np.array(weights, dtype="float64").T
        valid = column.drop_null()
        flat = pc.fill_null(valid.flatten(), 0.0).to_numpy(zero_copy_only=False).astype("float64", copy=False)
        lengths = valid.value_lengths().to_numpy(zero_copy_only=False)
        if len(lengths) and (lengths == width).all():
            dense = flat.reshape(-1, width)
        else:
            dense = np.zeros((len(lengths), width))
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            known = place < width
            dense[row[known], place[known]] = flat[known]
        result = np.zeros((len(column), matrix.shape[1]))
        present = column.is_valid().to_numpy(zero_copy_only=False)
        result[present] = dense @ matrix
        arrays = [pa.array(result[:, i], mask=~present) for i in range(matrix.shape[1])]
        return pa.StructArray.from_arrays(arrays, names=targets)

    return products


def combine_targets(first: DataFrame, second: DataFrame, score: str, key: str = "user_year_week") -> DataFrame:
    """Inner join of a second score on the user-week; repeated keys multiply. :func:`fused_scores` needs no join."""
    return first.join(second.select(key, score), key, "inner")


def global_min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest and largest value of every column, in one row and one pass."""
    return df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)])


def minmax_scale(
    df: DataFrame, cols: Mapping[str, str], low: float = SCORE_LOW, high: float = SCORE_HIGH
) -> DataFrame:
    """Rescale columns to ``low..high`` by their global range; null where all values are equal.

    ``cols`` maps a column to its scaled name. All ranges come from one aggregate, read as a scalar subquery,
    so nothing is collected and nothing is joined. The input is read twice: stage it if it is expensive.
    """
    ranges = df.agg(
        F.struct(*[f(c).cast("double").alias(f"{name}_{c}") for c in cols for name, f in (("min", F.min), ("max", F.max))])
    ).scalar()

    def scaled(col: str) -> Column:
        least, most = F.col("_ranges")[f"min_{col}"], F.col("_ranges")[f"max_{col}"]
        return F.lit(low) + F.try_divide(F.lit(high - low) * (F.col(col) - least), most - least)

    ranged = df.withColumn("_ranges", ranges)
    return ranged.select(*df.columns, *[scaled(c).alias(out) for c, out in cols.items()])
