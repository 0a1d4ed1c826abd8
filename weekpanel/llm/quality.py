"""Operator 3: quality by co-training two classifiers, one on text content and one on page metadata.

The text view describes how a document is written (:mod:`weekpanel.llm.style`) and which words it holds (their shares, by
a hash, in ``CONTENT`` places), the metadata view its source, language and declared length. The ``PLACES`` most frequent
sources of all documents (ties: the smaller name) have a place of their own, the others share ``SOURCES`` places by a hash.
Both are logistic regressions. They begin with the labelled documents; in each round a
view takes over the unlabelled documents of which the other one, calibrated, is sure, as pseudo-labels with at most
the weight of the real ones of that class. At the end the calibrated views are combined, and all documents scored.

Documents are described once and staged without their texts. Every Newton step is one Spark job over all of them:
each task sums gradient and curvature of both views, the sums of all tasks are added by an aggregation, and the driver
gets one row per pair of features. Pseudo-labels are not stored but told from the previous round's models. One fifth
of the labelled documents (by a hash of doc_id) is kept out of the fits, for calibration and combination.

Defined results: null, empty and blank texts have zeros as their text view; null metadata is a value of its own; of
several labels of a document the lowest counts, null labels count as none; without labels of both kinds nothing can be
learnt, every score is 0.5 and every document is kept; repeated rows are scored alike; an empty table gives no rows;
further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.shared import Staging, fresh
from weekpanel.llm.style import NAMES, style
from weekpanel.llm.tokens import Words, slices

ROUNDS = 3
STEPS = 4
SURE = 0.98
THRESHOLD = 0.5
CONTENT = 64
PLACES, SOURCES, LANGS, LENGTHS = 32, 32, 8, 8
TEXT, META = "text", "meta"
NUMBERS = len(NAMES) + CONTENT
WIDTH = {TEXT: NUMBERS + 1, META: PLACES + SOURCES + LANGS + LENGTHS + 2}
BINS, SPAN = 64, 8.0


def frequent_sources(docs: DataFrame) -> list[str]:
    """The ``PLACES`` most frequent sources; null is one of its own."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source")
    counts = docs.select(source).groupBy("source").agg(F.count("*").alias("n"))
    return [r["source"] for r in counts.orderBy(F.desc("n"), "source").limit(PLACES).collect()]


def meta_columns(frequent: list[str]) -> list:
    """Metadata as three numbers: a place of the source, one of the language, and the logarithm of the length."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    own = F.array_position(F.array(*map(F.lit, frequent)).cast("array<string>"), source)
    shared = F.lit(PLACES) + F.pmod(F.xxhash64(source), F.lit(SOURCES))
    return [
        F.when(own > 0, own - 1).otherwise(shared).cast("int").alias("s"),
        F.pmod(F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("\0"))), F.lit(LANGS)).cast("int").alias("l"),
        F.coalesce(F.log1p(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("c"),
    ]


def meta_view(s: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros((len(s), WIDTH[META]))
    rows = np.arange(len(s))
    out[rows, s] = 1
    out[rows, PLACES + SOURCES + l] = 1
    out[rows, PLACES + SOURCES + LANGS + np.minimum(c.astype(np.int64) // 2, LENGTHS - 1)] = 1
    out[:, -2], out[:, -1] = c / 10, 1
    return out


def content(words: Words) -> np.ndarray:
    """The words of each text by a hash: square roots of their shares in ``CONTENT`` places; zeros without words."""
    n = np.diff(words.first)
    of = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(of * CONTENT + (words.hashes % np.uint64(CONTENT)).astype(np.int64), minlength=len(n) * CONTENT)
    return np.sqrt(counts.reshape(len(n), CONTENT) / np.maximum(n, 1)[:, None])


def text_numbers(texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros((0, NUMBERS), np.float32)
    words = Words(texts)
    return np.concatenate([style(texts, words), content(words)], axis=1).astype(np.float32)


def text_view(described: np.ndarray) -> np.ndarray:
    return np.concatenate([described, np.ones((len(described), 1))], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class View:
    """A logistic regression and its calibration: probability = sigmoid(slope * (x @ weights) + shift)."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (x @ self.weights) + self.shift, -SPAN, SPAN)


@dataclass
class Model:
    views: dict[str, View] = field(default_factory=dict)
    #: shift, and the weights of the calibrated text and metadata views
    mix: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if not self.views:
            return np.full(len(x[TEXT]), 0.5)
        logits = [self.views[v].logit(x[v]) for v in (TEXT, META)]
        return sigmoid(self.mix[0] + self.mix[1] * logits[0] + self.mix[2] * logits[1])


# -- describing documents ---------------------------------------------------------------------------------------------

DESCRIBED = "doc_id long, s int, l int, c double, x binary"


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        x = text_numbers(texts)
        columns = [batch.column(c) for c in ("doc_id", "s", "l", "c")]
        columns.append(pa.array([row.tobytes() for row in x], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s", "l", "c", "x"])


def described(docs: DataFrame, frequent: list[str]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *meta_columns(frequent), "text").mapInArrow(
        _describe, DESCRIBED
    )


def _views(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, NUMBERS)
    s, l, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in "slc")
    return {TEXT: text_view(x.astype(np.float64)), META: meta_view(s, l, c)}


def with_labels(rows: DataFrame, labels: DataFrame, staging: Staging) -> DataFrame:
    """Staged: described documents, their label (null: none) and whether they are held out of the fits."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    known = staging.write(known, "labels")
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held")
    joined = rows.join(known, "doc_id", "left").select("s", "l", "c", "x", "y", F.coalesce(held, F.lit(False)).alias("held"))
    return staging.write(joined, "fit")


# -- sums over all documents ------------------------------------------------------------------------------------------


def _targets(batch: pa.RecordBatch, x: dict[str, np.ndarray], before: Model | None, weight: dict) -> dict:
    """For each view: labels and weights of the rows it learns from, pseudo-labels of the other view included."""
    y = pc.fill_null(batch.column("y"), -1).to_numpy(zero_copy_only=False)
    held = batch.column("held").to_numpy(zero_copy_only=False)
    out = {}
    for view, other in ((TEXT, META), (META, TEXT)):
        label = y.astype(np.float64)
        w = ((y >= 0) & ~held).astype(np.float64)
        if before is not None:
            p = sigmoid(before.views[other].logit(x[other]))
            for one, sure in ((1, p >= SURE), (0, p <= 1 - SURE)):
                taken = sure & (y < 0)
                label[taken] = one
                w[taken] = weight[other][one]
        out[view] = (label, w)
    return out


def _newton_sums(batches, weights: dict, before: Model | None, pseudo: dict) -> Iterator[pa.RecordBatch]:
    total = {v: np.zeros((WIDTH[v], WIDTH[v] + 1)) for v in WIDTH}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _views(batch)
        for view, (label, w) in _targets(batch, x, before, pseudo).items():
            rows = w > 0
            a, y, w = x[view][rows], label[rows], w[rows]
            p = sigmoid(a @ weights[view])
            total[view][:, -1] += a.T @ (w * (y - p))
            total[view][:, :-1] += (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a
    for view, sums in total.items():
        i, j = np.divmod(np.arange(sums.size), sums.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([view] * sums.size), pa.array(i), pa.array(j), pa.array(sums.ravel())], ["view", "i", "j", "v"]
        )


def _newton(rows: DataFrame, weights: dict, before: Model | None, pseudo: dict) -> dict[str, np.ndarray]:
    """One Newton step of both views over all documents."""
    sums = rows.mapInArrow(
        lambda it: _newton_sums(it, weights, before, pseudo), "view string, i long, j long, v double"
    )
    added = sums.groupBy("view", "i", "j").agg(F.sum("v").alias("v")).collect()  # a row per pair of features
    out = {}
    for view, width in WIDTH.items():
        total = np.zeros((width, width + 1))
        for row in added:
            if row["view"] == view:
                total[row["i"], row["j"]] = row["v"]
        ridge = np.full(width, 1.0)
        ridge[-1] = 1e-6
        slope = total[:, -1] - ridge * weights[view]
        out[view] = weights[view] + np.linalg.solve(total[:, :-1] + np.diag(ridge), slope)
    return out


COUNTS = "what string, a long, b long, y long, n long"


def _logit_counts(batches, model: Model) -> Iterator[pa.RecordBatch]:
    """Counts of held-out labelled rows by both raw logits, and of unlabelled rows each view is sure of."""
    counted: dict[tuple, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _views(batch)
        y = pc.fill_null(batch.column("y"), -1).to_numpy(zero_copy_only=False)
        held = batch.column("held").to_numpy(zero_copy_only=False)
        raw = [np.clip(x[v] @ model.views[v].weights, -SPAN, SPAN) for v in (TEXT, META)]
        a, b = (np.round((r + SPAN) / (2 * SPAN) * BINS).astype(np.int64) for r in raw)
        use = held & (y >= 0)
        keys, n = np.unique(np.stack([a, b, y], axis=1)[use], axis=0, return_counts=True)
        for (i, j, k), m in zip(keys.tolist(), n.tolist(), strict=True):
            counted["held", i, j, k] = counted.get(("held", i, j, k), 0) + m
        for k in (0, 1):
            key = ("labelled", 0, 0, k)
            counted[key] = counted.get(key, 0) + int(((y == k) & ~held).sum())
    rows = [(*k, n) for k, n in counted.items()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.string(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["what", "a", "b", "y", "n"]
    )


def _sure_counts(batches, model: Model) -> Iterator[pa.RecordBatch]:
    found = np.zeros((2, 2), dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _views(batch)
        free = pc.is_null(batch.column("y")).to_numpy(zero_copy_only=False)
        for k, view in enumerate((TEXT, META)):
            p = sigmoid(model.views[view].logit(x[view]))
            found[k] += [int((free & (p <= 1 - SURE)).sum()), int((free & (p >= SURE)).sum())]
    i, j = np.divmod(np.arange(4), 2)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(found.ravel())], ["view", "y", "n"])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """A small weighted logistic regression; the first column is the constant."""
    out = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = sigmoid(np.clip(x @ out, -30, 30))
        slope = x.T @ (w * (y - p)) - penalty * out
        curve = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        out = out + step / max(1.0, np.abs(step).max() / 4)
    return out


def _calibrated(rows: DataFrame, weights: dict) -> tuple[Model, dict[int, int]]:
    """Both views calibrated, and combined, on the held-out rows; and the number of labelled rows of each kind."""
    model = Model({v: View(w) for v, w in weights.items()})
    counts = rows.mapInArrow(lambda it: _logit_counts(it, model), COUNTS)
    counts = counts.groupBy("what", "a", "b", "y").agg(F.sum("n").alias("n")).collect()  # at most 2 BINS^2 rows and 2
    labelled = {r["y"]: r["n"] for r in counts if r["what"] == "labelled"}
    held = [r for r in counts if r["what"] == "held"]
    if {r["y"] for r in held} >= {0, 1}:
        y, n = (np.array([r[k] for r in held], dtype=np.float64) for k in ("y", "n"))
        logits = []
        for view, key in ((TEXT, "a"), (META, "b")):
            raw = np.array([r[key] for r in held]) / BINS * 2 * SPAN - SPAN
            shift, slope = logistic(np.stack([np.ones_like(raw), raw], axis=1), y, n)
            model.views[view].slope, model.views[view].shift = max(slope, 0.0), shift
            logits.append(np.clip(model.views[view].slope * raw + shift, -SPAN, SPAN))
        model.mix = logistic(np.stack([np.ones_like(y), *logits], axis=1), y, n)
    else:
        model.mix = np.array([0.0, 1.0, 1.0])
    return model, labelled


def fit(docs: DataFrame, labels: DataFrame, frequent: list[str], rounds: int = ROUNDS) -> Model:
    staging = Staging(docs.sparkSession, "quality")
    model = fit_described(staging.write(described(docs, frequent), "described"), labels, staging, rounds)
    staging.close()
    return model


def fit_described(rows: DataFrame, labels: DataFrame, staging: Staging, rounds: int = ROUNDS) -> Model:
    """The model, from documents that are described and staged."""
    rows = with_labels(rows, labels, staging)
    kinds = {r["y"] for r in rows.filter("y IS NOT NULL AND NOT held").select("y").distinct().collect()}
    if not kinds >= {0, 1}:
        return Model()
    weights = {v: np.zeros(n) for v, n in WIDTH.items()}
    model, pseudo = None, {}
    for turn in range(rounds + 1):  # the first with labels alone
        for _ in range(STEPS if turn else STEPS + 2):
            weights = _newton(rows, weights, model, pseudo)
        model, labelled = _calibrated(rows, weights)
        if turn < rounds:
            frozen = model
            sure = rows.mapInArrow(lambda it, m=frozen: _sure_counts(it, m), "view long, y long, n long")
            sure = {(r["view"], r["y"]): r["n"] for r in sure.groupBy("view", "y").agg(F.sum("n").alias("n")).collect()}
            pseudo = {
                view: [min(1.0, labelled.get(y, 0) / max(sure.get((k, y), 0), 1)) for y in (0, 1)]
                for k, view in enumerate((TEXT, META))
            }
    return model


# -- scoring ----------------------------------------------------------------------------------------------------------


def _scores(batches: Iterable[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _views(batch) if batch.num_rows else {TEXT: np.zeros((0, WIDTH[TEXT])), META: np.zeros((0, WIDTH[META]))}
        score = model.score(x)
        parts = [sigmoid(model.views[v].logit(x[v])) if model.views else score for v in (TEXT, META)]
        columns = [batch.column("doc_id"), *(pa.array(p) for p in parts), pa.array(score), pa.array(score >= threshold)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_score", "meta_score", "quality_score", "kept"])


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score (the calibrated views), quality_score and kept of every document."""
    staging = Staging(docs.sparkSession, "quality")
    rows = staging.write(described(docs, frequent_sources(docs)), "described")
    model = fit_described(rows, labels, staging, rounds)
    staging.drop("labels", "fit")
    kinds = "doc_id long, text_score double, meta_score double, quality_score double, kept boolean"
    return rows.mapInArrow(lambda it: _scores(it, model, threshold), kinds)


def _good(batches: Iterable[pa.RecordBatch], model: Model, threshold: float, meta: list[str]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        s, l, c = (batch.column(name).to_numpy(zero_copy_only=False) for name in meta)
        score = model.score({TEXT: text_view(text_numbers(texts).astype(np.float64)), META: meta_view(s, l, c)})
        yield batch.filter(pa.array(score >= threshold)).drop_columns(meta)


def good_documents(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns: scored where they are read, not shuffled."""
    frequent = frequent_sources(docs)
    model = fit(docs, labels, frequent, rounds)
    names = fresh(docs.columns, "_source", "_lang", "_length")
    meta = [c.alias(name) for c, name in zip(meta_columns(frequent), names, strict=True)]
    return docs.select("*", *meta).mapInArrow(lambda it: _good(it, model, threshold, names), docs.schema)
