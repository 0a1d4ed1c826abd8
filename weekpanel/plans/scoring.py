"""User-week embeddings to raw and rescaled scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.fixed_values import LAYER_DIM, N_LAYERS, SCORED_LAYER_FROM_END
from weekpanel.functions import vectors
from weekpanel.operators import embed, score
from weekpanel.session import stage
from weekpanel.sources import readers, writers


def raw_scores(
    embeddings: DataFrame,
    models: Mapping[str, score.Model],
    *,
    n_layers: int = N_LAYERS,
    dim: int = LAYER_DIM,
    from_end: int = SCORED_LAYER_FROM_END,
    as_float: bool = False,
    arrow: bool = True,
) -> DataFrame:
    """Keys and one score per target: a single projection over the scan, without a shuffle.

    All layers that are looked for are there once the shape is checked, so the picked layer is taken as it is
    instead of being listed and flattened again.
    """
    if not 1 <= from_end <= n_layers:
        raise ValueError("from_end must name one of the layers")
    valid = embed.valid_layers(embeddings, n_layers, dim)
    picked = vectors.layer_from_end(F.col("embedding"), from_end).alias("vector")
    rows = valid.select("user_year_week", "user_id", "fips", picked)
    return score.fused_scores(rows, models, as_float=as_float, arrow=arrow).drop("vector")


def score_user_weeks(embeddings: DataFrame, models: Mapping[str, score.Model], **options) -> DataFrame:
    """Scores and their ``scaled_`` forms. Options are those of :func:`raw_scores`.

    The range of the scores is needed before any of them can be rescaled. The raw scores, three keys and two
    numbers per row, are staged in between, so the embeddings are read once.
    """
    scores = stage(raw_scores(embeddings, models, **options), "scores")
    return score.minmax_scale(scores, {target: f"scaled_{target}" for target in models})


def write_scores(
    spark: SparkSession,
    years: Sequence[str],
    models: Mapping[str, score.Model],
    path: str,
    files: int | None = None,
    **options,
) -> None:
    """Score the embeddings of several years, one Parquet glob each, and write all of them as CSV with a header.

    The scores of all years are rescaled by one range. Options are those of :func:`raw_scores`.
    """
    embeddings = embed.union_years(*[readers.read_embeddings(spark, year) for year in years])
    writers.write_csv(score_user_weeks(embeddings, models, **options), path, files=files)
