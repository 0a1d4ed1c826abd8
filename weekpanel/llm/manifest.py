"""Operator 11: a Merkle manifest of a data set, stored as aligned subtrees in van Emde Boas order.

Every document becomes a leaf, a digest over its columns. Leaves are ordered by (source, doc_id) with one range
partitioning and numbered from per-partition totals. 3 ** ``HEIGHT`` consecutive leaves of a source are one block: a task
builds the subtree over them and stores it in van Emde Boas order (:mod:`boas_layout`). The roots of a source's blocks
are the leaves of its next level of blocks, until one root is left; the sources' roots are built into one tree the same
way. A source of any size is so many blocks of bounded size, spread over all tasks.

Proofs go the other way: a block joined with the steps above its own root gives its leaves all of theirs, read from the
stored subtree by address. Documents are then held against the root, as they are or with line breaks deleted.

Defined results: a null value is ``-`` in the digest, an empty text ``0:``; null sources come first, null doc_ids come
first in their source, equal doc_ids by their digest; repeated rows are leaves of their own (which of two equal rows
comes first makes no difference); a document alone has an empty list of siblings; a null doc_id is never tampered with;
an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.llm import boas_layout as layout
from weekpanel.llm.shared import Staging

#: Height of a full block: 2,187 leaves, some 105 KB of digests.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCKS = "grp string, block bigint, total bigint, nodes binary"
STEPS = "grp string, pos bigint, siblings binary, shape binary"
ROWS = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def digest_of(values: list[Column]) -> Column:
    """SHA-256 over the values, each ``-`` or its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """One slim row per document: its group (the source, so that null comes first), doc_id, and the leaf.

    ``tampered`` is the leaf after line breaks are deleted, where that is done and changes the text.
    """
    values = {name: F.col(name) for name in FIELDS}
    deleted = values | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    picked = (F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest_of(list(values.values())).alias("digest"),
        F.when(picked, digest_of(list(deleted.values()))).alias("tampered"),
    )


def _numbered(rows: DataFrame, order: list[str], staging: Staging, label: str) -> DataFrame:
    """Add ``pos``, the place of the row in its group (from 0), and ``total``, the rows of the group.

    One shuffle by range. Equal rows are told apart by a number of their own, so that they cannot fill one task.
    """
    own = staging.write(rows.withColumn("_own", F.monotonically_increasing_id()), f"{label}-rows")
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, "_own")]
    ranged = own.repartitionByRange(*by).sortWithinPartitions(*by).drop("_own")
    placed = staging.write(ranged.withColumn("_at", F.monotonically_increasing_id()), f"{label}-placed")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # One row per partition and group; a group has at most as many as there are partitions.
    parts = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    offsets = staging.write(
        parts.selectExpr(
            "grp", "_part", "_first",
            "coalesce(sum(_n) OVER (PARTITION BY grp ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
            " AS _before",
            "sum(_n) OVER (PARTITION BY grp) AS total",
        ),
        f"{label}-offsets",
    )
    joined = placed.join(offsets, ["grp", "_part"])
    return joined.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).select(*rows.columns, "pos", "total")


def _height(total: int, most: int) -> int:
    """A group of one block is as high as it must be; in a larger one all blocks are of full height."""
    return min(layout.height_for(total), most)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _subtree(most: int) -> Callable[[pa.Table], pa.Table]:
    def build(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        nodes = layout.build(table["digest"].to_pylist(), _height(table["total"][0].as_py(), most))
        first = table.slice(0, 1).select(["grp", "block", "total"])
        return first.append_column("nodes", pa.array([nodes], pa.binary()))

    return build


def _blocked(rows: DataFrame, most: int) -> DataFrame:
    return rows.withColumn("block", F.expr(f"pos div {layout.ARITY**most}"))


def _root(block: str = "nodes") -> Column:
    """The root of a stored subtree: its address is 0 at every height."""
    return F.substring(block, 1, layout.DIGEST)


@dataclass
class Level:
    """Nodes (grp, pos, total, digest, ...) and the blocks over them (grp, block, total, nodes)."""

    rows: DataFrame
    blocks: DataFrame


def _levels(rows: DataFrame, staging: Staging, label: str, most: int) -> list[Level]:
    """From the leaves up: every level's nodes are the roots of the blocks below. As many levels as the largest group needs."""
    out, full = [], layout.ARITY**most
    while True:
        shaped = _blocked(rows, most).select("grp", "block", "pos", "total", "digest").groupBy("grp", "block")
        blocks = staging.write(shaped.applyInArrow(_subtree(most), BLOCKS), f"{label}-blocks-{len(out)}")
        out.append(Level(rows, blocks))
        above = blocks.filter(F.col("total") > full)
        if above.isEmpty():
            return out
        rows = above.select(
            "grp",
            F.col("block").alias("pos"),
            F.expr(f"(total + {full - 1}) div {full}").alias("total"),
            _root().alias("digest"),
        )


def _roots(levels: list[Level], most: int) -> DataFrame:
    """(grp, digest): the root of each group, wherever its tree ends."""
    single = F.col("total") <= layout.ARITY**most
    return reduce(
        DataFrame.unionByName, [lv.blocks.filter(single).select("grp", _root().alias("digest")) for lv in levels]
    )


def _paths_of(rows: pa.Table, blocks: pa.Table, most: int) -> list[tuple[bytes, bytes]]:
    nodes, siblings, shape = (blocks[c][0].as_py() for c in ("nodes", "siblings", "shape"))
    return layout.paths(nodes, rows.num_rows, _height(blocks["total"][0].as_py(), most), siblings, shape)


def _steps(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def steps_of(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        found = _paths_of(rows, blocks, most)
        siblings, shapes = (pa.array([path[k] for path in found], pa.binary()) for k in (0, 1))
        return rows.select(["grp", "pos"]).append_column("siblings", siblings).append_column("shape", shapes)

    return steps_of


def _with_steps(
    levels: list[Level], tops: DataFrame | None, staging: Staging, label: str, most: int
) -> DataFrame:
    """The lowest level's blocks, each with the steps above its root, and what ``tops`` has for its group besides.

    ``tops`` has a row per group, the steps above the group's own root; without it there are none. Levels are gone through from above: a block's
    steps are read from the block that holds its root.
    """
    extra = [] if tops is None else [c for c in tops.columns if c not in ("grp", "siblings", "shape")]
    single = F.col("total") <= layout.ARITY**most
    above = None
    for number in range(len(levels) - 1, -1, -1):
        level = levels[number]
        own = level.blocks.filter(single)
        if tops is None:
            blocks = own.withColumns({"siblings": F.lit(b""), "shape": F.lit(b"")})
        else:
            blocks = own.join(tops.select("grp", "siblings", "shape"), "grp")
        if above is not None:
            inner = level.blocks.filter(~single)
            blocks = blocks.unionByName(inner.join(above.withColumnRenamed("pos", "block"), ["grp", "block"]))
        if number == 0:
            return blocks.join(tops.select("grp", *extra), "grp") if extra else blocks
        rows = _blocked(level.rows, most).select("grp", "block", "pos")
        pairs = rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block"))
        above = staging.write(pairs.applyInArrow(_steps(most), STEPS), f"{label}-steps-{number}")
    raise AssertionError("a tree has a level at least")


@dataclass
class Manifest:
    """The levels of the documents' trees and of the tree over the sources' roots, and its root."""

    documents: list[Level]
    sources: list[Level]
    root: bytes
    height: int
    staging: Staging

    def blocks(self) -> DataFrame:
        """All stored subtrees: tree, level, group, block, leaves of the group there, nodes in van Emde Boas order."""
        out = None
        for tree, levels in (("documents", self.documents), ("sources", self.sources)):
            for number, level in enumerate(levels):
                one = level.blocks.select(F.lit(tree).alias("tree"), F.lit(number).alias("level"), "*")
                out = one if out is None else out.unionByName(one)
        return out


def build_manifest(docs: DataFrame, height: int = HEIGHT) -> Manifest | None:
    """The trees of the documents; None where there are none. ``height`` is that of a full block."""
    if height < 1:
        raise ValueError("height must be at least 1")
    staging = Staging(docs.sparkSession, "manifest")
    numbered = _numbered(leaves(docs), ["doc_id", "digest"], staging, "leaves")
    documents = _levels(numbered, staging, "documents", height)
    roots = _roots(documents, height).select(F.lit("").alias("grp"), F.col("grp").alias("source_key"), "digest")
    sources = _levels(_numbered(roots, ["source_key"], staging, "sources"), staging, "sources", height)
    top = _roots(sources, height).first()
    return None if top is None else Manifest(documents, sources, bytes(top["digest"]), height, staging)


def write_manifest(docs: DataFrame, path: str, height: int = HEIGHT) -> str | None:
    """Write all subtrees to ``path`` as Parquet and return the root as hex text."""
    built = build_manifest(docs, height)
    if built is None:
        return None
    built.blocks().write.parquet(path)
    built.staging.close()
    return built.root.hex()


def differing_blocks(spark: SparkSession, one: str, other: str) -> DataFrame:
    """Where two written manifests differ: (tree, level, grp, block) of the subtrees whose roots are not the same.

    Equal subtrees are told by their roots alone, so what is compared grows with the blocks, not with the documents.
    """
    key = ["tree", "level", "grp", "block"]
    mine, theirs = (spark.read.parquet(p).select(*key, _root().alias(name)) for p, name in ((one, "a"), (other, "b")))
    return mine.join(theirs, key, "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def _judge(root: bytes, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def rows_of(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        subroot = blocks["digest"][0].as_py().hex()
        proofs, ends = [], []
        found = zip(rows["digest"].to_pylist(), rows["tampered"].to_pylist(), _paths_of(rows, blocks, most))
        for digest, tampered, (siblings, shape) in found:
            proofs.append(sha256(siblings.hex().encode()).hexdigest())
            ends.append(layout.folded(tampered or digest, siblings, shape))
        n = rows.num_rows
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "leaf": pa.array([d.hex() for d in rows["digest"].to_pylist()], pa.string()),
                "subroot": pa.array([subroot] * n, pa.string()),
                "root": pa.array([root.hex()] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array([e.hex() for e in ends], pa.string()),
                "verified": pa.array([e == root for e in ends], pa.bool_()),
            }
        )

    return rows_of


def verified_documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every document with its leaf, its source's root, the root, a digest of its proof, and whether it still verifies."""
    spark = docs.sparkSession
    built = build_manifest(docs, height)
    if built is None:
        return spark.createDataFrame([], ROWS)
    staging = built.staging
    blocks = _with_steps(built.sources, None, staging, "sources", height)
    rows = _blocked(built.sources[0].rows, height).select("grp", "block", "pos")
    pairs = rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block"))
    steps = staging.write(pairs.applyInArrow(_steps(height), STEPS), "source-steps")
    tops = staging.write(
        built.sources[0].rows.join(steps, ["grp", "pos"])
        .select(F.col("source_key").alias("grp"), "siblings", "shape", "digest"),
        "tops",
    )
    blocks = _with_steps(built.documents, tops, staging, "documents", height)
    rows = _blocked(built.documents[0].rows, height).select("grp", "block", "pos", "doc_id", "digest", "tampered")
    pairs = rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block"))
    return pairs.applyInArrow(_judge(built.root, height), ROWS)
