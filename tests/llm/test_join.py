"""The n-gram Jaccard join and its signature trees, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weekpanel.llm import near_join
from weekpanel.llm import signature_tree as trees
from weekpanel.llm.components import components
from weekpanel.llm.shared import Staging
from weekpanel.llm.tokens import Words

A_TO_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, hash string, class int, _none string, bits int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "h", 7, "n", 0) for d, t in rows], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def groups(rows):
    """For each row its set's size and its component, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, one in enumerate(sets):
        shared = Counter(j for s in one for j in holders[s])
        for s in one:
            holders[s].append(k)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(one) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def corpus():
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rnd.choices(words, k=25))
    rows = [(None, line), (0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE Two"), (5, "One two three")]
    number = 10
    for _ in range(25):  # families of near copies, some beyond the limit, behind a line that all share
        text = rnd.choices(words, k=rnd.randint(8, 160))
        for _ in range(rnd.randint(1, 7)):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(copy) // 20))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((number, (line + "\n" if rnd.random() < 0.4 else "") + " ".join(copy)))
            number += 1
    base = rnd.choices(words, k=60)
    for _ in range(60):  # a large group of near copies
        copy = list(base)
        copy[rnd.randrange(60)] = rnd.choice(words)
        rows.append((number, " ".join(copy)))
        number += 1
    return rows + [(number + k, "copy " * 20) for k in range(30)] + [(20, rows[17][1])]


def test_groups_and_the_one_that_stays(spark, monkeypatch):
    for name, value in (("MEMBERS", 8), ("CHECKS", 4), ("OFTEN", 3)):
        monkeypatch.setattr(near_join, name, value)
    rows = corpus()
    frame = docs(spark, rows).repartition(5)
    want = groups(rows)
    least = defaultdict(list)
    for (d, t), (n, root) in zip(rows, want, strict=True):
        least[root].append(d)
    expected = sorted(
        (str(d), n, min((x for x in least[root] if x is not None), default=None) if n else d)
        for (d, _), (n, root) in zip(rows, want, strict=True)
    )
    got = near_join.near_groups(frame).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == expected

    kept = near_join.one_per_group(frame)
    assert kept.columns == frame.columns
    stay = sorted(str(r["doc_id"]) for r in kept.collect())
    alone = [str(d) for (d, _), (n, _) in zip(rows, want, strict=True) if not n]
    roots = {root for n, root in want if n}
    assert stay == sorted(alone + [str(min((x for x in least[r] if x is not None), default=None)) for r in roots])


def test_an_empty_table(spark):
    empty = docs(spark, [(1, "a b c")]).filter("false")
    assert near_join.near_groups(empty).count() == 0


def test_words_are_told_by_their_letters_and_places():
    texts = [b"ab ba aab", b"", b"A B\tc d e F", b"x\x0by", ("é" * 70).encode()]
    words = Words(texts)
    assert np.diff(words.first).tolist() == [3, 0, 6, 2, 1]
    assert len(set(words.hashes.tolist())) == 12
    assert Words([b"AB ba"]).hashes.tolist() == words.hashes[:2].tolist()


@pytest.mark.parametrize("count", [1, 31, 33, 200])
def test_dual_traversal_loses_no_link(count):
    rnd = np.random.default_rng(count)
    base = [rnd.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(max(1, count // 6))]
    sets = []
    for _ in range(count):
        one = base[rnd.integers(len(base))].copy()
        changed = rnd.integers(0, 12)
        one[:changed] = rnd.integers(0, 2**63, changed, dtype=np.uint64)
        sets.append(np.unique(one))
    sizes = np.array([len(s) for s in sets])
    nodes = trees.members(trees.bitmaps(sets), sizes, np.arange(count))
    links = {
        (i, j)
        for i in range(count)
        for j in range(i + 1, count)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    }
    found = set(map(tuple, trees.dual_traversal(nodes).tolist()))
    assert links <= found and all(i < j for i, j in found)
    half = count // 2
    across = trees.dual_traversal(nodes.take(np.arange(half)), nodes.take(np.arange(half, count)))
    assert {(i, j) for i, j in links if i < half <= j} <= {(i, j + half) for i, j in across.tolist()}
    grouped = trees.members(trees.bitmaps(sets), sizes, np.zeros(count, dtype=np.int64))
    assert not len(trees.dual_traversal(grouped))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 199)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), Staging(spark, "t"), "c").collect())
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 130)}, 199: 199, 200: 199}


def test_a_pair_that_shares_many_blocks_is_given_few_times(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    base = rnd.choices(words, k=400)
    rows = []
    for k in range(24):  # pairs share some two thirds of their shingles: many blocks, and mostly no link
        copy = list(base)
        for place in rnd.sample(range(400), 8):
            copy[place] = rnd.choice(words)
        rows.append((k, " ".join(copy)))
    given, run = [], near_join._in_sorted_blocks

    def spread(members, keys, pairs):
        if pairs is near_join._cross_pairs:
            given.append(members.repartition(64, *keys).sortWithinPartitions(*keys, "class").mapInArrow(pairs, "a long, b long"))
            given.append(given[0].distinct().count())
            given[0] = given[0].count()
        return run(members, keys, pairs)

    monkeypatch.setattr(near_join, "_in_sorted_blocks", spread)
    got = near_join.near_groups(docs(spark, rows)).select("n_shingles", "component_id").collect()
    want = groups(rows)
    assert Counter(Counter(r[1] for r in got).values()) == Counter(Counter(c for _, c in want).values())
    assert given[1] > 100 and given[0] <= 3 * given[1], given
