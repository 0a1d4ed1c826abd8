"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest

from weekpanel.llm import boas_layout as layout
from weekpanel.llm import manifest
from weekpanel.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos string, grp int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc, text):
    return h(*[encoded(v) for v in (doc[0], doc[3], doc[2], doc[4], text)])


def plain(docs):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every document."""

    def tree(nodes):
        """The root, and per node its steps (place, siblings)."""
        steps = [[] for _ in nodes]
        under = [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            up, held = [], []
            for k in range(0, len(nodes), 3):
                run = nodes[k : k + 3]
                for place in range(len(run)):
                    for leaf in under[k + place]:
                        steps[leaf].append((place, run[:place] + run[place + 1 :]))
                up.append(h(*run))
                held.append([leaf for u in under[k : k + 3] for leaf in u])
            nodes, under = up, held
        return nodes[0], steps

    by_source = {}
    for doc in docs:
        by_source.setdefault(doc[3], []).append(doc)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        rows = sorted(by_source[name], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d, d[1])))
        trees.append((rows, *tree([leaf_of(d, d[1]) for d in rows])))
    root, above = tree([t[1] for t in trees])
    out = []
    for (rows, subroot, steps), upper in zip(trees, above):
        for doc, own in zip(rows, steps):
            tampered = doc[1]
            if tampered is not None and doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 2 == 0:
                tampered = tampered.replace("\n", "")
            node = leaf_of(doc, tampered)
            for place, others in own + upper:
                node = h(*others[:place], node, *others[place:])
            proof = h(*[o for _, others in own + upper for o in others])
            out.append((doc[0], leaf_of(doc, doc[1]), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


DOCS = [
    (k, f"line {k}\nand é more\n" * (k % 5), "en", ["a", "é", "b", "", None][k % 7 % 5] if k % 3 else "hot", k % 11)
    for k in range(1, 260)
]
DOCS += [(None, "no\nid", None, None, None), (7, None, None, "z", None), (7, "", "en", "z", 0), (8, "\n", "x", "one", 1)]
DOCS += [(9, "twice\n", "en", "twice", 6)] * 3 + [(10, "x\n" * 40_000, "en", "long", None)]


def frame_of(spark, docs):
    return spark.createDataFrame([(*d, "x", "y", 3) for d in docs], SCHEMA)


@pytest.mark.parametrize("height", [2, 7])
def test_every_document_as_in_a_plain_tree(spark, height):
    """With small blocks sources take several levels of blocks, with large ones a single one."""
    got = manifest.verified_documents(frame_of(spark, DOCS).repartition(5), height)
    assert rows_of(got) == plain(DOCS)


@pytest.mark.parametrize("docs", [DOCS[:4], [DOCS[4]] * 28, [(None,) * 5]])
def test_few_documents(spark, docs):
    assert rows_of(manifest.verified_documents(frame_of(spark, docs), 2)) == plain(docs)


def test_an_empty_table_gives_no_rows(spark):
    empty = manifest.verified_documents(frame_of(spark, []))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"


def test_the_query_over_its_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    assert rows_of(QUERIES["op11_merkle_manifest"](spark, folder)) == plain([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses_are_a_permutation(levels):
    places = [layout.address(levels, d, k) for d in range(levels) for k in range(3**d)]
    assert sorted(places) == list(range(layout.size(levels)))
    assert layout.address(levels, 0, 0) == 0


def test_subtrees_below_the_half_lie_together():
    """Four levels: the upper two take the first places, each of the nine lower trees the next four."""
    assert sorted(layout.address(4, d, k) for d in (0, 1) for k in range(3**d)) == [0, 1, 2, 3]
    for k in range(9):
        own = [layout.address(4, 2, k), *(layout.address(4, 3, 3 * k + j) for j in range(3))]
        assert own == list(range(4 + 4 * k, 8 + 4 * k))


def test_written_manifests_tell_where_they_differ(spark, tmp_path):
    changed = [(d[0], "changed", *d[2:]) if d[0] == 101 else d for d in DOCS]
    root = manifest.write_manifest(frame_of(spark, DOCS), f"{tmp_path}/a", 2)
    assert root == plain(DOCS)[0][3]
    assert manifest.write_manifest(frame_of(spark, DOCS[::-1]), f"{tmp_path}/b", 2) == root
    assert manifest.write_manifest(frame_of(spark, changed), f"{tmp_path}/c", 2) == plain(changed)[0][3]
    assert manifest.differing_blocks(spark, f"{tmp_path}/a", f"{tmp_path}/b").isEmpty()
    found = manifest.differing_blocks(spark, f"{tmp_path}/a", f"{tmp_path}/c").collect()
    source = next(d[3] for d in DOCS if d[0] == 101)
    assert {r["grp"] for r in found if r["tree"] == "documents"} == {f"s{source}"}
    lowest = [r for r in found if r["tree"] == "documents" and r["level"] == 0]
    assert len(lowest) == 1
