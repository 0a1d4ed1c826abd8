"""Operator 2: soft-membership mixing. A classifier trained on the labelled table gives every document a posterior over
domains (clean, low quality, toxic); document rates are fitted so that expected domain totals of tokens match targets.

The classifier is a softmax over how a text is written (:mod:`weekpanel.llm.style`) and how many of its words, or the
beginnings of its words, are known from one domain. Which words those are is counted over a sample of at most
``SAMPLE`` labelled documents (the first by a hash of doc_id, a parameter), of which at most ``WORDS`` per domain are
kept; on the same sample the softmax is fitted.

The rates minimise over r >= 0 the squared misses of the domains (sum of rate * tokens * posterior - target), relative to
the targets, from r = 1, by projected gradient. Rates are measured by tokens, so that a document's change depends on its
posterior and not on its length. A step is searched for over some thirty candidates: the gradient in three metrics, two
of which close a domain's miss at once however rare it is, at several lengths; the one that leaves the least misses is
taken. Each step is one Spark job: tasks replay the steps so far for their documents (a document's rate is a function of
its posterior and of the steps), try all candidates, and sum expected tokens per domain; the driver gets some hundred
sums. Posteriors are staged once, without texts; nothing is shuffled but sums.

Steps are taken until each domain is within ``CLOSE`` of its own target (of its own tokens where the target is zero), or
the squared misses fall no more. Targets that cannot be met are reported by a :class:`TargetsMissed` warning that names
the domains and their misses.

Where documents may not be repeated, rates are at most one as well. With shares to keep in place of targets (all clean
tokens and none of the others, say) misses are measured in tokens; such targets cannot be met exactly, and the best rates
within 0 and 1 are 0 or 1 but for documents at the boundary.

Targets are shares; the total is such that the ``anchor`` domain keeps its expected tokens (rate 1) when the others
are given their shares.

Defined results: null, empty and blank texts have no tokens and the posterior of an empty text; of several labels of a
document toxic wins over low quality over clean; null labels count as none; without any labelled document every
document is of the anchor domain; a domain without documents gets no tokens whatever its target; repeated rows are
treated alike; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.decontaminate import plain_words
from weekpanel.llm.shared import Staging, fresh
from weekpanel.llm.style import NAMES, style
from weekpanel.llm.tokens import Words, mixed, slices

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
ANCHOR = "clean"
SAMPLE = 20_000
WORDS = 4096
BEGINNING = 5  # bytes
SIGNIFICANT = 4.0
STEPS = 100
CLOSE = 1e-3
DAMPING = 0.05
#: The least squares count as solved when they fall by less than a thousandth over so many steps.
SETTLED = 5


class TargetsMissed(UserWarning):
    """Rates leave domains further from their targets than ``CLOSE``."""


@dataclass
class Classifier:
    #: For each domain but the first: hashes that tell it, ascending, and the weight of each
    words: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1) x domains

    def posteriors(self, texts: list[bytes], words: Words | None = None) -> np.ndarray:
        x = (features(texts, self.words, words) - self.mean) / self.scale
        return softmax(np.concatenate([x, np.ones((len(x), 1))], axis=1) @ self.weights)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of every word two keys, one for the word and one for its beginning."""
    return words.hashes, mixed(words.beginnings(BEGINNING) + np.uint64(1))


def features(
    texts: list[bytes], known: list[tuple[np.ndarray, np.ndarray]], unplain: Words | None = None
) -> np.ndarray:
    """Style (of the words as they stand, if these are known already), and for each domain with known words: how many there are, how telling the best is, and their share."""
    words = plain_words(texts)
    n = np.maximum(np.diff(words.first), 1)
    of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    out = [style(texts, unplain)]
    both = keys(words)
    for hashes, weight in known:
        value = np.zeros(len(of))
        if len(hashes):
            for key in both:
                at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
                value = np.maximum(value, np.where(hashes[at] == key, weight[at], 0))
        hits = np.flatnonzero(value > 0)
        met = np.bincount(of[hits], minlength=len(texts))
        best = np.zeros(len(texts))
        np.maximum.at(best, of[hits], value[hits])
        out.append(np.stack([np.log1p(met), (met > 0).astype(float), best, np.sqrt(met / n)], axis=1))
    return np.concatenate(out, axis=1)


# -- fitting the classifier -------------------------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame, staging: Staging, size: int) -> DataFrame:
    """Staged: text and domain of at most ``size`` labelled documents."""
    domain = F.when(F.max(F.coalesce("toxic", F.lit(0))) > 0, 2).when(F.min(F.coalesce("quality", F.lit(1))) < 1, 1)
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(domain.otherwise(0).alias("domain"))
    first = staging.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size), "labelled")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return staging.write(texts.join(F.broadcast(first), "doc_id").select("text", "domain"), "sample")  # <= size rows


def _count_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        words = plain_words(texts)
        domain = np.asarray(batch.column("domain").to_pylist(), dtype=np.int64)
        of = np.repeat(np.arange(len(texts)), np.diff(words.first))
        pairs = np.concatenate([np.stack([k, of.astype(np.uint64)], axis=1) for k in keys(words)])
        pairs = np.unique(pairs, axis=0)  # a document counts once for a key
        key = np.stack([pairs[:, 0].view(np.int64), domain[pairs[:, 1].astype(np.int64)]], axis=1)
        found, n = np.unique(key, axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1])), pa.array(n)],
            ["key", "domain", "n"],
        )


def _known_words(sample: DataFrame, sizes: dict[int, int], staging: Staging) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each domain but the first: the keys that are met there significantly more often than elsewhere."""
    counts = sample.mapInArrow(_count_keys, "key long, domain long, n long").groupBy("key", "domain")
    counts = staging.write(counts.agg(F.sum("n").alias("n")), "keys")
    everything = sum(sizes.values())
    out = []
    for domain in range(1, len(DOMAINS)):
        inside, outside = sizes.get(domain, 0), everything - sizes.get(domain, 0)
        per_key = counts.groupBy("key").agg(
            F.sum(F.when(F.col("domain") == domain, F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("domain") != domain, F.col("n")).otherwise(0)).alias("b"),
        )
        odds = F.log((F.col("a") + 0.5) / (inside - F.col("a") + 0.5)) - F.log(
            (F.col("b") + 0.5) / (outside - F.col("b") + 0.5)
        )
        z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
        told = per_key.filter("a >= 3").select("key", odds.alias("odds"), z.alias("z")).filter(F.col("z") >= SIGNIFICANT)
        best = told.orderBy(F.desc("z"), "key").limit(WORDS).toPandas()  # the size of the model, a parameter
        key = best["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        out.append((key[order], best["odds"].to_numpy(np.float64)[order]))
    return out


def _sample_features(batches: Iterable[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        x = features(texts, known)
        yield pa.RecordBatch.from_arrays(
            [batch.column("domain"), pa.array([r.tobytes() for r in x], pa.binary())], ["domain", "x"]
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    staging = Staging(docs.sparkSession, "mixing-fit")
    rows = _sample(docs, labels, staging, sample)
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    if not sizes:
        staging.close()
        return None
    known = _known_words(rows, sizes, staging)
    described = rows.mapInArrow(lambda it: _sample_features(it, known), "domain int, x binary").collect()  # <= sample
    staging.close()
    x = np.stack([np.frombuffer(r["x"]) for r in described])
    y = np.array([r["domain"] for r in described])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weights = _softmax_regression((x - mean) / scale, y)
    return Classifier(known, mean, scale, weights)


def _softmax_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Accelerated gradient steps of a step size that the curvature bounds."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    wanted = np.eye(len(DOMAINS))[y]
    step = 1 / (0.5 * np.linalg.eigvalsh(x.T @ x / len(x))[-1] + ridge)
    weights = ahead = np.zeros((x.shape[1], len(DOMAINS)))
    for k in range(steps):
        slope = x.T @ (softmax(x @ ahead) - wanted) / len(x) + ridge * ahead
        before, weights = weights, ahead - step * slope
        ahead = weights + k / (k + 3) * (weights - before)
    return weights


# -- posteriors and rates ---------------------------------------------------------------------------------------------

POSTERIORS = "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)


def _posterior(texts: list[bytes], model: Classifier | None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and numbers of tokens."""
    words = Words(texts)
    n = np.diff(words.first)
    if model is not None:
        return model.posteriors(texts, words), n
    return np.tile(np.array([float(d == ANCHOR) for d in DOMAINS]), (len(texts), 1)), n


def _posteriors(batches: Iterable[pa.RecordBatch], model: Classifier | None) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        p, n = _posterior(texts, model)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in p.T)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)])


def replay(p: np.ndarray, steps: list[np.ndarray], most: float = np.inf) -> np.ndarray:
    """Rates after the steps so far: each moves a rate by the posterior's product with the step, within 0 and ``most``."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.clip(rate + p @ step, 0, most)
    return rate


def _batch_posteriors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    p = np.stack([batch.column(f"p_{d}").to_numpy(zero_copy_only=False) for d in DOMAINS], axis=1)
    return p, batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)


def totals(p: np.ndarray, n: np.ndarray, steps: list[np.ndarray], tried: np.ndarray, most: float) -> np.ndarray:
    """For each step that is tried after those so far: expected tokens per domain, the products of posteriors, and the
    products over the documents whose rates are not at a bound."""
    d = len(DOMAINS)
    rate = replay(p, steps, most)
    pairs = (p[:, :, None] * p[:, None, :]).reshape(len(p), d * d) * n[:, None]
    out = np.zeros((len(tried), d, 2 * d + 1))
    for k, step in enumerate(tried):
        after = np.clip(rate + p @ step, 0, most)
        out[k, :, 0] = p.T @ (n * after)
        out[k, :, 1 : d + 1] = pairs.sum(axis=0).reshape(d, d)
        out[k, :, d + 1 :] = pairs[(after > 0) & (after < most)].sum(axis=0).reshape(d, d)
    return out


def _totals(batches: Iterable[pa.RecordBatch], steps, tried: np.ndarray, most: float) -> Iterator[pa.RecordBatch]:
    """A task's sums, each with its place."""
    total = np.zeros((len(tried), len(DOMAINS), 2 * len(DOMAINS) + 1))
    for batch in batches:
        if batch.num_rows:
            total += totals(*_batch_posteriors(batch), steps, tried, most)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])


def _summed(rows: DataFrame, steps: list[np.ndarray], tried: np.ndarray, most: float) -> np.ndarray:
    sums = rows.mapInArrow(lambda it: _totals(it, steps, tried, most), "i long, v double")
    out = np.zeros((len(tried), len(DOMAINS), 2 * len(DOMAINS) + 1))
    for row in sums.groupBy("i").agg(F.sum("v").alias("v")).collect():  # tried steps x domains x (2 domains + 1) rows
        out.flat[row["i"]] = row["v"]
    return out


def _tried(miss: np.ndarray, weight: np.ndarray, products: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Gradient steps in three metrics and of several lengths: by the products of all documents and by those of the
    documents that can still move, either of which closes the miss of such documents at once, and as it is."""
    root = np.sqrt(weight)
    plain = weight / max(np.linalg.eigvalsh(root @ products @ root)[-1], np.finfo(float).tiny)
    metrics = [(plain, 2.0 ** np.arange(0, 20, 2))]
    for products_ in (products, free):
        for damping in (1e-6, 1e-3, DAMPING):
            damped = products_ + damping * np.diag(np.diag(products_))
            metrics.append((np.linalg.pinv(damped, rcond=1e-13, hermitian=True), 2.0 ** np.arange(-6, 3, 2)))
    return np.stack([length * (metric @ miss) for metric, lengths in metrics for length in lengths])


def descend(
    summed: Callable[[list[np.ndarray], np.ndarray], np.ndarray],
    targets: dict[str, float] | None = None,
    keep: dict[str, float] | None = None,
    most: float = np.inf,
    steps: int = STEPS,
) -> list[np.ndarray]:
    """The steps of the projected gradient, for a function that gives :func:`totals` over all documents."""
    tokens, products, free = _parts(summed([], np.zeros((1, len(DOMAINS))))[0])
    anchor = DOMAINS.index(ANCHOR)
    if not tokens.sum() or not tokens[anchor]:
        return []
    if keep is None:
        targets = TARGETS if targets is None else targets
        share = np.array([targets.get(d, 0.0) for d in DOMAINS])
        if share.min() < 0 or share[anchor] <= 0:
            raise ValueError(f"targets must not be negative, and {ANCHOR} needs one")
        wanted = np.where(tokens > 0, share / share[anchor] * tokens[anchor], 0)
        if most < np.inf:
            wanted = np.minimum(wanted, most * tokens)
        scale = np.maximum(np.where(wanted > 0, wanted, tokens), 1)
        weight = np.diag(1 / np.maximum(scale, tokens) ** 2)
    else:
        wanted = np.array([keep.get(d, 0.0) for d in DOMAINS]) * tokens
        if wanted.min() < 0:
            raise ValueError("shares to keep must not be negative")
        scale = np.full(len(DOMAINS), tokens.sum())
        weight = np.diag(1 / scale**2)
    taken: list[np.ndarray] = []
    merits: list[float] = []
    while True:
        miss = wanted - tokens
        merits.append(float(miss @ weight @ miss))
        settled = len(merits) > SETTLED and merits[-1] > (1 - 1e-3) * merits[-1 - SETTLED]
        if np.abs(miss / scale).max() <= CLOSE or len(taken) == steps or settled:
            break
        tried = _tried(miss, weight, products, free)
        after = summed(taken, tried)
        left = wanted - after[:, :, 0]
        best = int(np.argmin(((left @ weight) * left).sum(axis=1)))
        if left[best] @ weight @ left[best] >= merits[-1]:
            break
        taken.append(tried[best])
        tokens, _, free = _parts(after[best])
    open_ = {d: float(m) for d, m in zip(DOMAINS, miss / scale, strict=True) if abs(m) > CLOSE}
    if keep is None and open_:
        told = ", ".join(f"{d} by {-m:+.2%}" for d, m in open_.items())
        warnings.warn(f"after {len(taken)} steps expected tokens miss their targets: {told}", TargetsMissed, stacklevel=3)
    return taken


def _parts(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = len(DOMAINS)
    return sums[:, 0], sums[:, 1 : d + 1], sums[:, d + 1 :]


def fit_rates(
    rows: DataFrame,
    targets: dict[str, float] | None = None,
    steps: int = STEPS,
    repeat: bool = True,
    keep: dict[str, float] | None = None,
) -> list[np.ndarray]:
    """The steps of the projected gradient over staged posteriors.

    Without ``repeat`` rates are at most one, and no domain is asked for more tokens than it has. ``keep`` names shares of
    the domains' own tokens in place of ``targets``; the misses are then measured in tokens, alike for all domains.
    """
    most = np.inf if repeat else 1.0
    return descend(lambda taken, tried: _summed(rows, taken, tried, most), targets, keep, most, steps)


def _rated(batches: Iterable[pa.RecordBatch], steps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, _ = _batch_posteriors(batch)
        yield batch.append_column("rate", pa.array(replay(p, steps)))


def document_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE
) -> DataFrame:
    """doc_id, n_tokens, p_clean, p_low, p_toxic and rate of every document."""
    model = fit(docs, labels, sample)
    staging = Staging(docs.sparkSession, "mixing")
    rows = staging.write(_with_posteriors(docs, model), "posteriors")
    steps = fit_rates(rows, targets)
    return rows.mapInArrow(lambda it: _rated(it, steps), POSTERIORS + ", rate double")


def _with_posteriors(docs: DataFrame, model: Classifier | None) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(lambda it: _posteriors(it, model), POSTERIORS)


def realised(rate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Whole copies at the rates, the fraction by a draw from [0, 1)."""
    whole = np.floor(rate)
    return (whole + (draw < rate - whole)).astype(np.int64)


def _repeated(batches: Iterable[pa.RecordBatch], model, steps: list, most: float) -> Iterator[pa.RecordBatch]:
    """The last column is the hash that the draw is taken from."""
    for batch, texts in slices(batches):
        last = batch.num_columns - 1
        draw = (batch.column(last).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)) / 2.0**53
        copies = realised(replay(_posterior(texts, model)[0], steps, most), draw)
        yield batch.select(list(range(last))).take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))


def mixed_documents(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    sample: int = SAMPLE,
    repeat: bool = True,
    keep: dict[str, float] | None = None,
) -> DataFrame:
    """The documents with all their columns, each as often as its fitted rate says; fractions are realised by a hash of
    doc_id and text, the same for repeated rows.

    ``repeat`` and ``keep`` as in :func:`fit_rates`. Posteriors and rates are told again where the documents are read, so
    that no text is shuffled.
    """
    if keep is not None and targets is not None:
        raise ValueError("either targets or shares to keep")
    model = fit(docs, labels, sample)
    staging = Staging(docs.sparkSession, "mixing")
    steps = fit_rates(staging.write(_with_posteriors(docs, model), "posteriors"), targets, repeat=repeat, keep=keep)
    staging.close()
    (draw,) = fresh(docs.columns, "draw")
    drawn = docs.withColumn(draw, F.xxhash64(F.lit("mixing"), "doc_id", "text"))
    most = np.inf if repeat else 1.0
    return drawn.mapInArrow(lambda it: _repeated(it, model, steps, most), docs.schema)
