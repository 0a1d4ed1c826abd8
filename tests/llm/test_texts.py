"""Decontamination, licences, quality, mixing, main text and the token file."""

import html
import random
import re
import time
import warnings
import zlib

import numpy as np
import pytest

from weekpanel.llm import decontaminate, licences, main_text, mixing, quality, token_file
from weekpanel.llm.queries import QUERIES
from weekpanel.llm.shared import Staging

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _source string, item_id string, rate int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "y", 3) for d, t in rows], SCHEMA)


# -- decontamination --------------------------------------------------------------------------------------------------


def covered(item, text, least):
    """Greedy string tiling by looking for the longest match again and again."""
    in_item, in_text, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while (
                    p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n]
                    and not in_item[p + n] and not in_text[t + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return total
        in_item[p : p + n], in_text[t : t + n] = [True] * n, [True] * n
        total += n


@pytest.mark.parametrize("seed", range(30))
def test_tiles_cover_what_plain_tiling_covers(seed):
    rnd = random.Random(seed)
    item = [rnd.randint(1, 12) for _ in range(rnd.randint(5, 60))]
    text = []
    while len(text) < 80:
        a = rnd.randrange(len(item))
        text += item[a : a + rnd.randint(1, 25)] + [rnd.randint(1, 14) for _ in range(rnd.randint(0, 4))]
    found = decontaminate.tiles(item, text, 3)
    for p, t, n in found:
        assert item[p : p + n] == text[t : t + n] and n >= 3
    assert len({p + k for p, _, n in found for k in range(n)}) == sum(n for _, _, n in found)
    assert len({t + k for _, t, n in found for k in range(n)}) == sum(n for _, _, n in found)
    want = covered(item, text, 3)
    # Ties may be broken in another order, which can move a few words; never most of them.
    assert abs(sum(n for _, _, n in found) - want) <= max(4, 0.15 * want)


def words(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)]


def test_verbatim_and_reordered_passages_are_found_and_others_left(spark):
    item = words(1, 40)
    reordered = item[20:] + words(2, 3) + item[:20]
    rows = [
        (1, " ".join(words(3, 200) + item + words(4, 50))),
        (2, " ".join(words(5, 30) + reordered)),
        (3, " ".join(words(6, 30) + item[:12])),
        (4, " ".join(item).upper().replace(" ", ", ")),
        (5, " ".join(random.Random(0).sample(item, 40))),
        (6, None), (7, ""), (None, " ".join(item)), (1, " ".join(words(3, 200) + item + words(4, 50))),
    ]
    benchmark = spark.createDataFrame(
        [(10, " ".join(item)), (10, " ".join(item)), (11, "too short"), (12, None), (13, "")], "item_id long, text string"
    )
    frame = docs(spark, rows).repartition(3)
    got = decontaminate.contaminations(frame, benchmark).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["n_tiles"]) for r in got) == [
        ("1", 10, 1), ("2", 10, 2), ("4", 10, 1), ("None", 10, 1),
    ]
    assert all(r["coverage"] == 1 and r["covered"] == r["item_words"] == 40 for r in got)
    kept = decontaminate.without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7]
    assert decontaminate.without_contaminated(frame, benchmark.filter("false")).count() == len(rows)
    assert decontaminate.contaminations(frame.filter("false"), benchmark).count() == 0


def test_blocks_of_the_benchmark_find_what_one_block_finds(spark, monkeypatch):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole = sorted(decontaminate.contaminations(frame, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert sorted(decontaminate.contaminations(frame, benchmark).collect()) == whole


# -- licences ---------------------------------------------------------------------------------------------------------


def test_notices_are_the_best_passages(spark):
    apache = licences.TEMPLATES["Apache-2.0"]
    header = licences.TEMPLATES["Apache-2.0-header"]
    rows = [
        (1, " ".join(words(1, 50)) + "\n" + apache + "\n" + " ".join(words(2, 50))),
        (2, header.replace(" ", "\n")),
        (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "ALL RIGHTS RESERVED. " + licences.TEMPLATES["MIT-text"].replace("software", "program", 1)),
        (5, "all rights are reserved by the licensed and the under of"), (6, None), (7, ""), (8, "license"),
    ]
    got = licences.licence_notices(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["licence"]) for r in got) == [
        (1, "Apache-2.0"), (2, "Apache-2.0-header"), (3, "GPL-2.0"), (4, "MIT-text"), (4, "all-rights-reserved"),
    ]
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["first_word"], first["end_word"], first["dice"]) == (50, 58, 1.0)
    assert licences.licence_notices(docs(spark, rows).filter("false")).count() == 0


def scan(text):
    found = licences.plain_words([text.encode()])
    bigrams, _ = found.shingles(2, short=False)
    return [n[0] for n in licences.notices(bigrams, licences.templates_of(licences.TEMPLATES))]


@pytest.mark.parametrize("name", sorted(licences.TEMPLATES))
def test_each_notice_wins_over_its_neighbours(name):
    text = licences.TEMPLATES[name]
    assert scan(f"some words before {text} and after it") == [name]
    for old, new in (("https", "http"), ("copyright holder nor", "Acme nor"), ("THE AUTHOR BE", "ACME BE"), ("License along", "License, together")):
        assert scan(text.replace(old, new)) == [name]


def test_notices_as_they_are_written_elsewhere():
    """Neighbouring licences that one template stood for, with other words around the version."""
    old = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for licence, version, name in (
        ("General Public License", "2", "GPL-2.0-header"), ("General Public License", "3", "GPL-3.0-header"),
        ("Affero General Public License", "3", "AGPL-3.0-header"), ("Lesser General Public License", "2.1", "LGPL-2.1-header-program"),
    ):
        assert scan(old.format(licence, version)) == [name]
    assert scan("licensed under the GNU Affero General Public License, version 3") == ["AGPL-3.0"]


@pytest.mark.parametrize("seed", range(20))
def test_no_passage_within_the_bounds_scores_better(seed):
    rnd = random.Random(seed)
    template = [rnd.randint(1, 9) for _ in range(rnd.randint(4, 14))]
    text = [rnd.randint(1, 11) for _ in range(30)] + template[: rnd.randint(2, 14)] + [rnd.randint(1, 11) for _ in range(9)]
    bigrams = np.array([a * 100 + b for a, b in zip(text[:-1], text[1:], strict=True)], dtype=np.uint64)
    one = licences.Template("t", np.unique([a * 100 + b for a, b in zip(template[:-1], template[1:], strict=True)]).astype(np.uint64), 0.6)
    best = 0.0
    for a in range(len(bigrams)):
        for b in range(a + 1, len(bigrams) + 1):
            own = set(bigrams[a:b].tolist())
            best = max(best, 2 * len(own & set(one.bigrams.tolist())) / (len(own) + one.size))
    found = max((s for s, _, _ in licences.passages(bigrams, one)), default=0.0)
    assert found == pytest.approx(best) if best >= 0.6 else found == 0


# -- quality and mixing -----------------------------------------------------------------------------------------------


def labelled_corpus(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        text = ". ".join(" ".join(words(1000 * k + j, rnd.randint(5, 12))).capitalize() for j in range(rnd.randint(3, 9)))
        kind = k % 10
        if kind in (0, 1):
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind in (2, 3):
            text = text.replace(" ", " nasty ", 2)
        rows.append((k, text))
        if k % 3:
            labels.append((k, int(kind > 1), int(kind in (2, 3))))
    schema = "doc_id long, quality int, toxic int"
    more = [(None, 0, 1), (399, None, None), (5, 1, 0)]
    return docs(spark, [*rows, (1000, None), (1001, ""), (None, rows[5][1])]), spark.createDataFrame(labels + more, schema)


def test_quality_is_learnt_and_decides(spark):
    frame, labels = labelled_corpus(spark)
    got = quality.quality_scores(frame, labels).collect()
    assert len(got) == 403
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 3 == 0]
    right = [r["kept"] == (r["doc_id"] % 10 > 1) for r in held]
    assert sum(right) >= 0.98 * len(right)
    kept = quality.good_documents(frame, labels)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_words_tell_documents_that_are_written_alike(spark):
    rnd = random.Random(7)
    ours = ["".join(rnd.choices("bcdfgaeiou", k=6)) for _ in range(30)]
    rows, labels = [], []
    for k in range(400):
        text = " ".join(w if k % 2 else w[::-1] for w in rnd.choices(ours, k=40))
        rows.append((k, text))
        if k % 4 < 2:
            labels.append((k, k % 2, 0))
    frame = docs(spark, rows)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [r for r in quality.quality_scores(frame, marked).collect() if r["doc_id"] % 4 > 1]
    assert sum((r["text_score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got) >= 0.95 * len(got)
    assert sum(r["kept"] == (r["doc_id"] % 2 == 1) for r in got) >= 0.95 * len(got)


def test_frequent_sources_have_a_place_of_their_own(spark):
    many = [(f"s{k:02d}",) for k in range(quality.PLACES + 4)] + [("s35",), (None,), (None,)]
    frame = spark.createDataFrame(many, "source string").selectExpr("source", "'en' AS lang", "1L AS n_chars")
    frequent = quality.frequent_sources(frame)
    assert frequent[:3] == ["\0", "s35", "s00"] and len(frequent) == quality.PLACES
    places = {r["source"]: r["s"] for r in frame.select("source", *quality.meta_columns(frequent)).collect()}
    assert [places[None], places["s35"], places["s00"]] == [0, 1, 2]
    assert all(p >= quality.PLACES for source, p in places.items() if (source or "\0") not in frequent)


def test_without_labels_of_both_kinds_every_document_is_kept(spark):
    frame, labels = labelled_corpus(spark)
    got = quality.quality_scores(frame, labels.filter("quality = 1")).collect()
    assert {(r["quality_score"], r["kept"]) for r in got} == {(0.5, True)}
    assert quality.quality_scores(frame.filter("false"), labels).count() == 0


def test_rates_meet_their_targets(spark):
    frame, labels = labelled_corpus(spark)
    got = mixing.document_rates(frame, labels, {"clean": 0.8, "low": 0.1, "toxic": 0.1}).collect()
    assert len(got) == 403 and min(r["rate"] for r in got) >= 0
    total = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS}
    everything = sum(total.values())
    for domain, share in (("clean", 0.8), ("low", 0.1), ("toxic", 0.1)):
        assert total[domain] / everything == pytest.approx(share, abs=1e-3)
    told = [(max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"]), r["doc_id"] % 10) for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    wanted = {0: "low", 1: "low", 2: "toxic", 3: "toxic"}
    assert sum(domain == wanted.get(kind, "clean") for domain, kind in told) >= 0.97 * len(told)
    repeated = mixing.mixed_documents(frame, labels, {"clean": 1.0}).select("doc_id").collect()  # at rates around one
    assert sum(r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 10 > 3 for r in repeated) == pytest.approx(240, rel=0.1)
    clean = mixing.mixed_documents(frame, labels, repeat=False, keep={"clean": 1.0})
    assert clean.columns == frame.columns
    ids = [r["doc_id"] for r in clean.collect() if r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(ids) == len(set(ids)) and sum(d % 10 > 3 for d in ids) >= 0.97 * len(ids) and len(ids) >= 0.97 * 240


def test_rates_without_labels_or_documents(spark):
    frame, labels = labelled_corpus(spark)
    got = mixing.document_rates(frame, labels.filter("false")).collect()
    assert {r["rate"] for r in got} == {1.0}
    assert mixing.document_rates(frame.filter("false"), labels).count() == 0


def test_replayed_steps_are_the_projected_gradient():
    rnd = np.random.default_rng(0)
    p, n = rnd.dirichlet([1, 1, 1], 50), rnd.integers(1, 100, 50).astype(float)
    steps = [rnd.normal(0, 0.5, 3) for _ in range(6)]
    rate = np.ones(50)
    for s in steps:
        rate = np.maximum(0, rate + p @ s)
    assert np.allclose(mixing.replay(p, steps), rate) and (n > 0).all()


def staged_posteriors(spark, name, posteriors, repeat):
    """Posteriors of documents of 100 tokens, each as often as ``repeat`` says."""
    rows = [(k, 100, *map(float, p)) for k, p in enumerate(p for p, n in zip(posteriors, repeat, strict=True) for _ in range(n))]
    return Staging(spark, name).write(spark.createDataFrame(rows, mixing.POSTERIORS), "posteriors")


def expected(rows, steps):
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows.collect()])
    return p.T @ (100 * mixing.replay(p, steps))


@pytest.mark.parametrize("rare", [1, 5])
def test_rates_of_a_rare_domain_meet_their_target(spark, rare):
    """0.02% and 0.1% of the tokens, for a target of 1%."""
    rows = staged_posteriors(spark, f"rare-{rare}", [(0.998, 0.001, 0.001), (0.01, 0.98, 0.01), (0.02, 0.01, 0.97)], [4900, 100 - rare, rare])
    targets = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
    total = expected(rows, mixing.fit_rates(rows, targets))
    for t, domain in zip(total, mixing.DOMAINS, strict=True):
        assert t / total.sum() == pytest.approx(targets[domain], rel=3e-3)


@pytest.mark.parametrize("targets, keep, most", [
    ({"clean": 0.97, "low": 0.02, "toxic": 0.01}, None, np.inf),
    ({"clean": 0.3, "low": 0.3, "toxic": 0.4}, None, np.inf),
    (None, {"clean": 1.0}, 1.0),
    (None, {"clean": 0.5, "low": 0.9, "toxic": 0.1}, 1.0),
])
def test_rates_are_as_good_as_those_of_a_plain_solver(targets, keep, most):
    """Single rates by many short steps of the projected gradient, against few searched ones."""
    rnd = np.random.default_rng(3)
    p = np.concatenate([rnd.dirichlet(a, k) for a, k in (((20, 1, 1), 200), ((1, 9, 1), 40), ((1, 1, 9), 20))])
    n = rnd.integers(1, 100, len(p)).astype(float)
    jobs = []

    def summed(taken, tried):
        jobs.append(len(tried))
        return mixing.totals(p, n, taken, tried, most)

    rate = mixing.replay(p, mixing.descend(summed, targets, keep, most), most)
    own = p.T @ n
    if keep is None:
        share = np.array([targets[d] for d in mixing.DOMAINS])
        wanted = share / share[0] * own[0]
        weight = 1 / np.maximum(np.maximum(wanted, own), 1) ** 2
    else:
        wanted = np.array([keep.get(d, 0.0) for d in mixing.DOMAINS]) * own
        weight = np.full(3, 1 / own.sum() ** 2)
    plain, step = np.ones(len(p)), 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p * np.sqrt(np.outer(weight, weight)))[-1]
    for _ in range(30_000):
        plain = np.clip(plain + step * p @ (weight * (wanted - p.T @ (n * plain))), 0, most)

    def misses(r):
        return float(weight @ (wanted - p.T @ (n * r)) ** 2)

    assert len(jobs) <= 50 and rate.min() >= 0 and rate.max() <= most
    assert misses(rate) <= 1.02 * misses(plain) + 1e-6


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_targets_are_met_on_the_given_tables(spark, size):
    with warnings.catch_warnings():
        warnings.simplefilter("error", mixing.TargetsMissed)
        got = QUERIES["op2_mixing"](spark, f"/root/testdata/{size}").collect()
    total = np.array([sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS])
    assert total / total.sum() == pytest.approx([mixing.TARGETS[d] for d in mixing.DOMAINS], rel=3e-3)


def test_targets_out_of_reach_are_reported(spark):
    rows = staged_posteriors(spark, "far", [(0.9, 0.05, 0.05), (0.8, 0.1, 0.1)], [50, 50])
    with pytest.warns(mixing.TargetsMissed, match="toxic"):
        mixing.fit_rates(rows, {"clean": 0.98, "low": 0.01, "toxic": 0.01})


def test_a_domain_that_cannot_be_told_leaves_the_others_near_their_targets(spark):
    rows = staged_posteriors(spark, "blind", [(0.9998, 0.0001, 0.0001), (0.01, 0.0001, 0.9899)], [1900, 100])
    with pytest.warns(mixing.TargetsMissed, match="low"):
        steps = mixing.fit_rates(rows, {"clean": 0.97, "low": 0.02, "toxic": 0.01})
    before, after = expected(rows, []), expected(rows, steps)
    assert after[0] == pytest.approx(before[0], rel=0.1) and after[2] < 0.5 * before[2]


# -- main text --------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>x</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href='/a>b'>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more.</div><!-- <p>not here</p> -->
<article><h1>The  title</h1><p>First &lt;b&gt; paragraph,<br>with <b>bo</b>ld&nbsp;text and some more words in it.
<p>Second paragraph, long enough to be taken for one, with a <a href=x>link</a>.</p>
<div class="ad">Buy now, it is cheap.</div><p>Third one.</p></article>
<section id="comments"><p>I liked this article very much, thanks for it.</p></section>
<aside>Related</aside><form><p>Subscribe</p></form><footer>&copy; someone</footer></body>"""
TEXT = (
    "The title First <b> paragraph, with bold text and some more words in it. Second paragraph, long enough to be"
    " taken for one, with a link. Third one."
)


def pages(spark, rows):
    return spark.createDataFrame([(k, f"http://x/{k}", page, "t") for k, page in rows], "page_id long, url string, html string, text string")


def test_the_article_is_left(spark):
    rows = [(k, PAGE) for k in range(5)] + [(7, None), (8, ""), (9, "<<<>"), (None, PAGE), (10, "<p>" * 3000 + "x")]
    got = {r["page_id"]: r for r in main_text.main_texts(pages(spark, rows)).collect()}
    assert {got[k]["text"] for k in (0, 4, None)} == {TEXT} and got[0]["n_chars"] == len(TEXT)
    assert got[7]["text"] == got[8]["text"] == "" and got[7]["n_chars"] == 0
    assert main_text.main_texts(pages(spark, rows).filter("false")).count() == 0


def test_every_page_of_the_given_table(spark):
    got = {r["page_id"]: r for r in QUERIES["op7_main_text"](spark, FOLDER).collect()}
    for row in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        plain = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article))
        assert got[row["page_id"]]["text"] == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize("seed", range(20))
def test_the_cut_is_the_least_of_all(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 9)
    gain = [rnd.uniform(-3, 3) for _ in range(n)]
    edges = [(a, b, rnd.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]

    def cost(labels):
        own = sum(g if g > 0 and not x else -g if g < 0 and x else 0 for g, x in zip(gain, labels, strict=True))
        return own + sum(c for a, b, c in edges if labels[a] != labels[b])

    least = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
    assert cost(main_text.minimum_cut(gain, edges)) == pytest.approx(least, abs=1e-6)


def test_the_cut_of_a_page_of_50000_blocks():
    """Halves that are content and boilerplate by turns, with doubtful blocks within either."""
    rnd = random.Random(5)
    n = 50_000
    gain = [(1 if k // 500 % 2 else -1) * rnd.choice([3.0, 2.0, 0.5, -0.4]) for k in range(n)]
    edges = [(k - 1, k, 0.5 ** rnd.randint(0, 4)) for k in range(1, n)] + [(k - 3, k, 0.5) for k in range(3, n)]
    begun = time.monotonic()
    side = main_text.minimum_cut(gain, edges)
    assert time.monotonic() - begun < 60
    # The least cost of such a band of edges, by the sides of the last three blocks.
    near, far = {b: c for a, b, c in edges if b - a == 1}, {b: c for a, b, c in edges if b - a == 3}
    least = {(): 0.0}
    for k in range(n):
        after: dict[tuple, float] = {}
        for last, cost in least.items():
            for own in (False, True):
                c = cost + (max(-gain[k], 0) if own else max(gain[k], 0))
                c += near[k] if k and last[-1] != own else 0
                c += far[k] if k >= 3 and last[-3] != own else 0
                key = (*last, own)[-3:]
                after[key] = min(after.get(key, np.inf), c)
        least = after
    cost = sum(max(-g, 0) if s else max(g, 0) for g, s in zip(gain, side, strict=True))
    cost += sum(c for a, b, c in edges if side[a] != side[b])
    assert cost == pytest.approx(min(least.values()), rel=1e-6)


def test_many_notices_do_not_overlap():
    """Ten thousand notices of one text, as the plain rule (best first, nothing that overlaps) gives them."""
    templates = licences.templates_of({"a": "released under the same terms", "b": "under the same terms as before"}, 0.6)
    text = " ".join(["released under the same terms as before", "filler words here"] * 10_000).encode()
    bigrams, first = licences.plain_words([text]).shingles(2, short=False)
    begun = time.monotonic()
    got = licences.notices(bigrams[first[0] : first[1]], templates)
    assert time.monotonic() - begun < 30
    assert len(got) >= 10_000
    assert all(a[3] <= b[2] for a, b in zip(got, got[1:]))


# -- the token file ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lanes", [1, 2, 9])
def test_blocks_come_back(lanes):
    rnd = np.random.default_rng(lanes)
    kinds = [
        lambda n: rnd.integers(0, 1 << 16, n),
        lambda n: np.minimum(rnd.zipf(1.3, n), 50_256),
        lambda n: np.tile(rnd.integers(0, 50_000, 7), n)[:n],
        lambda n: np.zeros(n, dtype=np.int64),
    ]
    blocks = [kinds[k % 4](int(rnd.integers(1, 700))).astype(np.int64) for k in range(lanes)]
    coded = token_file.encode_blocks(blocks)
    sizes = [len(b) for b in blocks]
    for a, b in zip(blocks, token_file.decode_blocks(coded, sizes), strict=True):
        assert a.tolist() == b.tolist()
    alone = token_file.decode_blocks([coded[-1]], [sizes[-1]])  # any block can be decoded by itself
    assert alone[0].tolist() == blocks[-1].tolist()
    assert token_file.encode_blocks([]) == [] == token_file.decode_blocks([], [])


def test_repeated_ids_take_few_bytes():
    block = np.tile(np.arange(100, 120), 200)
    assert len(token_file.encode_blocks([block])[0]) < 0.1 * 2 * len(block)


def test_the_file_holds_the_ids_of_all_documents(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_file, "BLOCK", 64)
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(3, "Hello, world! " * 40), (1, None), (2, ""), (9, "!"), (9, "!"), (None, "é<|endoftext|>"), (4, "a " * 500)]
    target = Staging(spark, "test-token-file").path("ids")
    token_file.write_token_file(docs(spark, rows).repartition(3), target, path)
    got = token_file.read_token_file(spark, target).collect()
    tokenizer = Tokenizer.from_file(path)
    start, want = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((str(d), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_a_damaged_block_is_noticed(spark):
    import public_tokenizers

    staging = Staging(spark, "test-token-file")
    token_file.write_token_file(docs(spark, [(1, "some words")]), staging.path("ids"), str(public_tokenizers.path("byte_bpe_50k.json")))
    damaged = spark.read.parquet(staging.path("ids")).selectExpr("* EXCEPT (ids_crc32)", "ids_crc32 + 1 AS ids_crc32")
    staging.write(damaged, "damaged")
    with pytest.raises(Exception, match="damaged"):
        token_file.read_token_file(spark, staging.path("damaged")).collect()


def test_pieces_have_the_ids_of_whole_texts():
    import public_tokenizers

    encoder = token_file.TextEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    rnd = random.Random(5)
    odd = [*"abZ  \n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u3000éßà×÷中٣1.,'s-<|>\x00\x7f\u0301😀", "'re", " the", "\r\n", "<|endoftext|>"]
    texts = ["".join(rnd.choices(odd, k=rnd.randint(0, 14))) for _ in range(20_000)]
    got = encoder.encode([t.encode() for t in texts])
    for text, ids, want in zip(texts, got, encoder.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text


def test_blocks_are_decoded_once(spark):
    import public_tokenizers

    path = Staging(spark, "test-token-file").path("ids")
    token_file.write_token_file(docs(spark, [(1, "some words")]), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    plan = token_file.read_token_file(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_word_is_given_to_the_tokenizer_once():
    import public_tokenizers

    encoder = token_file.TextEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    given, whole = [], encoder.whole
    encoder.whole = lambda texts: given.extend(texts) or whole(texts)
    want = encoder.tokenizer.encode("many words, many words. " * 50, add_special_tokens=False).ids
    for _ in range(3):
        assert [x.tolist() for x in encoder.encode([b"many words, many words. " * 50] * 20)] == [want] * 20
    assert sum(map(len, given)) < 100


def test_a_tokenizer_of_another_kind_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 1, "c": 2, "?": 3}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    other.save(str(tmp_path / "other.json"))
    encoder = token_file.TextEncoder(str(tmp_path / "other.json"))
    assert [x.tolist() for x in encoder.encode([b"a b,c", b"", b"a,b"])] == [[1, 2], [], [3, 3]]


def test_kept_pieces_are_forgotten_without_loss(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_file, "PIECES", 40)
    encoder = token_file.TextEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    for k in range(30):
        texts = [f"word{k} and {k * 7} others {'x' * k}", "the same words", ""]
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want


def test_streams_of_many_blocks_come_back_in_seconds():
    """Blocks of one and of many streams, of one id, of all ids; a coding step per id of a few hundred nanoseconds."""
    rnd = np.random.default_rng(8)
    blocks = [np.minimum(rnd.zipf(1.3, 65_536 - 997 * k), 50_256) for k in range(40)]
    blocks += [rnd.permutation(1 << 16), np.zeros(65_536, dtype=np.int64), np.tile(rnd.integers(0, 1 << 16, 300), 100), np.array([65_535])]
    begun = time.process_time()
    coded = token_file.encode_blocks(blocks)
    back = token_file.decode_blocks(coded, [len(b) for b in blocks])
    assert time.process_time() - begun < 12
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    assert len(coded[41]) < 1_000 and len(coded[40]) < 2.6 * 65_536


def test_an_empty_table_gives_an_empty_file(spark):
    import public_tokenizers

    path = Staging(spark, "test-token-file").path("ids")
    token_file.write_token_file(docs(spark, []).filter("false"), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    assert token_file.read_token_file(spark, path).count() == 0
