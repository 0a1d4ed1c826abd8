"""The pipeline's stages one by one, and as a whole, on the smallest tables."""

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_join import groups

from weekpanel.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def test_mixing_keeps_clean_documents_and_drops_toxic_ones(spark):
    folder = "/root/testdata/sf0.01"  # with some hundred labels
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = spark.read.parquet(f"{folder}/documents.parquet").join(labels.filter("quality = 0"), "doc_id", "left_anti")
    left = {r["doc_id"] for r in corpus_pipeline.mixed(spark, good, folder).select("doc_id").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.filter("quality = 1").collect()}
    lost = [d not in left for d, t in toxic.items() if not t]
    assert sum(lost) <= 0.02 * len(lost)
    caught = [d not in left for d, t in toxic.items() if t]
    assert sum(caught) >= 0.9 * len(caught)


@pytest.mark.parametrize("share", [0.005, 0.02, 0.12])
def test_mixing_drops_toxic_documents_whatever_their_share(spark, tmp_path, share):
    rnd = np.random.default_rng(1)
    texts = [[f"w{w}" for w in rnd.integers(0, 500, rnd.integers(20, 60))] for _ in range(2000)]
    toxic = {k for k in range(2000) if k < 2000 * share}
    texts = [" ".join(t if k not in toxic else [*t[:9], "nasty", *t[9:], "nasty"]) for k, t in enumerate(texts)]
    labels = [(k, 1, int(k in toxic)) for k in range(2000) if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    left = {r["doc_id"] for r in corpus_pipeline.mixed(spark, frame, str(tmp_path)).collect()}
    assert len(left & toxic) <= 0.1 * len(toxic)
    assert len(left - toxic) >= 0.99 * (2000 - len(toxic))

    rows = mixing.document_rates(frame, spark.read.parquet(str(tmp_path / "labels.parquet")))
    rows = rows.select("doc_id", "n_tokens", *(f"p_{d}" for d in mixing.DOMAINS)).collect()
    p, n = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    kept = np.array([r["doc_id"] in left for r in rows])
    own = p.T @ n
    total = p.T @ (n * kept)
    assert total[0] == pytest.approx(own[0], rel=0.01)
    assert total[1:] == pytest.approx([0, 0], abs=0.005 * n.sum())


def test_fractional_rates_are_realised():
    draw = np.random.default_rng(2).random(100_000)
    for rate in (0.02, 0.14, 0.6, 0.9, 1.1, 7.3):
        assert mixing.realised(np.full(len(draw), rate), draw).mean() == pytest.approx(rate, abs=0.01)


def test_stages_take_nulls_repeats_and_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (10**6, "", None, "x", 0), (10**6, "", None, "x", 0)],
        "doc_id long, text string, lang string, source string, n_chars int",
    ).select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))
    for rows in (docs.limit(30).unionByName(odd), docs.filter("false")):
        rows = rows.withColumn("rate", F.lit("mine"))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, rows, FOLDER)
            assert got.columns[: len(rows.columns)] == rows.columns, name
            n = got.count()
            assert n <= rows.count() and (k < 4 or n == rows.count())


def test_stages_keep_the_columns_and_do_what_they_are_for(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.columns == (columns if k < 4 else [*columns, "shard"])
        kept[name] = before.collect(), docs.collect()

    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept["quality"][1]}
    told = [(quality[r["doc_id"]] == 1) == (r["doc_id"] in left) for r in kept["quality"][0] if r["doc_id"] in quality]
    assert sum(told) >= 0.97 * len(told)

    rows = [(r["doc_id"], r["text"]) for r in kept["near_duplicates"][0]]
    members = defaultdict(list)
    for (d, _), (n, root) in zip(rows, groups(rows), strict=True):
        members[root if n else ("alone", d)].append(d)
    assert {r["doc_id"] for r in kept["near_duplicates"][1]} == {min(m) for m in members.values()}

    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    runs = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]

    def contaminated(text):
        w = re.findall(r"\w+", text.lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return any(len(own & run) >= 0.6 * len(run) for run in runs if run)

    before, after = kept["decontamination"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not contaminated(r["text"])}

    before, after = kept["mixing"]
    left = [r["doc_id"] for r in after]
    assert len(left) == len(set(left)) and set(left) <= {r["doc_id"] for r in before}

    last = sorted(kept["sharding"][1], key=lambda r: r["doc_id"])
    assert [r["shard"] for r in last] == sorted(r["shard"] for r in last)
    sizes = defaultdict(int)
    for r in last:
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    largest = max(len(r["text"].encode()) for r in last)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest

    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in whole) == sorted((r["doc_id"], r["shard"]) for r in last)
