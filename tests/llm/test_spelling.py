"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekpanel.llm import spelling
from weekpanel.llm.queries import QUERIES
from weekpanel.llm.shared import Staging

SCHEMA = "doc_id long, text string, lang string, word string, n int, id int, front string, _part int"
A_TO_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "w", 1, 2, "f", 3) for d, t in rows], SCHEMA)


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def holes(word):
    """What is left of the word with one position blanked or deleted."""
    return {(word[:k], word[k + 1 :]) for k in range(len(word))}, {word[:k] + word[k + 1 :] for k in range(len(word))}


def plain(counts):
    """As :func:`near` says; candidates are looked up by what is left of a word, so that whole tables can be checked."""
    blanked, shorter = {}, {}
    for word in counts:
        blanks, less = holes(word)
        for b in blanks:
            blanked.setdefault(b, []).append(word)
        for s in less:
            shorter.setdefault(s, []).append(word)
    form, rows = {}, {}
    for word, n in counts.items():
        blanks, less = holes(word)
        others = {o for b in blanks for o in blanked[b]} | (less & counts.keys()) | set(shorter.get(word, ()))
        others.discard(word)
        assert all(near(word, o) for o in others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best is not None and counts[best] >= 10 * n else None
        rows[word] = (word, form[word], n, len(others), counts[best] if form[word] else None)
    out = []
    for word, row in rows.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((*row[:2], root, *row[2:]))
    return sorted(out, key=str)


def rows_of(frame):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


TEXTS = [
    "Aardvark aardvark AARDVARK aardvrak, aardvaark aardvaark aardvarkk aardvarkk; ardvark ardvark bardvark bardvark",
    "élégance élégance ÉLÉGANCE ÉLÉGANCE elégance elégance éélégance éélégance " + "mississippi " * 30,
    "misissippi misissippi missisippi missisippi mississipi mississipi mississippii " * 2,
    "letters " * 1200 + "lettters " * 100 + "letterss " * 9 + "leters leters " + "lettterss " * 2,
    "cut-off: short run7of12digits sevenxx sevenxx sevenx sevenx sevenxxx sevenxxx",
    "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999,
    None,
    "",
]
ROWS = [(k * 3, t) for k, t in enumerate(TEXTS)] + [(4, TEXTS[0]), (4, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[4])]
ROWS += [(100 + k, f"variant variant varia{chr(97 + k % 26)}t vari{chr(97 + k % 7)}nt{chr(97 + k % 5)}") for k in range(90)]


def test_words_and_variants_as_by_brute_force(spark):
    got = rows_of(spelling.variants(docs(spark, ROWS).repartition(5)))
    expected = plain(counted(ROWS))
    assert got == expected
    assert any(r[2] not in (r[0], r[1]) for r in expected)  # a chain of two forms


def test_brute_force_finds_what_near_says():
    counts = counted(ROWS)
    short = {w: n for w, n in counts.items() if len(w) < 50}
    told = {r[0]: r[4] for r in plain(short)}
    assert told == {w: sum(near(w, o) for o in short) for w in short}


def test_the_query_over_its_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op13_spelling_variants"](spark, folder))
    assert got == plain(counted(rows))
    assert sum(r[1] is not None for r in got) > 10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(2, "lonely word lonelyone lonelyone")]])
def test_few_words(spark, rows):
    assert rows_of(spelling.variants(docs(spark, rows))) == plain(counted(rows))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=0, max_size=7), min_size=1, max_size=40), st.integers(1, 6))
def test_tries_are_numbered_across_partitions(words, parts):
    """Two words have the same node exactly where they have the same prefix, and all shared prefixes have one."""
    ordered = sorted(words)
    width = -(-len(ordered) // parts)
    cut = [(k, ordered[k : k + width]) for k in range(0, len(ordered), width)]
    known = spelling.borders([(k, run[0], run[-1]) for k, run in cut])
    nodes = {}
    for k, run in cut:
        nodes.update(zip(run, spelling.numbered(iter(run), k, known[k]), strict=True))
    by_node = {}
    for word, own in nodes.items():
        shared = max((spelling.common(word, o) for o in words if o != word), default=-1)
        assert len(own) == shared + 1
        for depth, node in enumerate(own):
            assert by_node.setdefault(node, word[:depth]) == word[:depth]
    assert len(set(by_node.values())) == len(by_node)


def test_pieces_cut_no_run():
    text = ("abc " * 10 + "longerrun" * 5 + "\n") * 20
    cut = list(spelling.pieces(text, 30))
    assert "".join(cut) == text and len(cut) > 10
    assert sum((re.findall("[a-z]+", p) for p in cut), []) == re.findall("[a-z]+", text)
    assert list(spelling.pieces("x" * 100, 10)) == ["x" * 100]


def test_a_scan_does_not_depend_on_the_partitions(spark):
    """Many small partitions, several of them in a task."""
    words = spark.createDataFrame([(f"w{k % 40:05b}{k}", k) for k in range(400)], "word string, n bigint")
    spread = spelling.with_nodes(words.repartition(9), "word", "front", Staging(spark, "test"), number="id").collect()
    ordered = sorted(spread, key=lambda r: r["word"])
    assert [r["id"] for r in ordered] == sorted(r["id"] for r in spread)
    by_node = {}
    for r in spread:
        for depth, node in enumerate(r["front"]):
            assert by_node.setdefault(node, r["word"][:depth]) == r["word"][:depth]
    assert len(set(by_node.values())) == len(by_node)
