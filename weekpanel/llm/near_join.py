"""Operator 10: n-gram Jaccard self-join with signature trees, and the groups that its links form.

A document's set holds its distinct shingles of five words; two link when 100 * shared >= 75 * union. Documents with
equal sets are one class, told by a hash of the set, and classes are what is joined.

1. One pass finds shingles that are frequent in some stretch of the input, a second one the shingles a class may be
   found by: two sets that link share one of the first ``size - ceil(3/4 size) + 1`` in any order common to all, here
   the frequent ones last. These are the roots of the trees: a block holds all classes with a shingle among those.
   Blocks of the same members are one, with a weight.
2. In a few of its blocks, leaves of signature trees (:mod:`weekpanel.llm.signature_tree`) give every class the one
   whose bitmap is most like its own. These links are checked on whole sets, and their components found.
3. Blocks that still hold several components are cut into chunks of bounded size, nodes with a range of sizes and
   components; pairs of chunks that may hold a link between components are walked by dual traversal. A pair is given at
   the first block in which it meets, its blocks are counted, and what survives is checked on whole sets. So no link between different components is lost, and copies are never paired off.

The order of shingles and the links tried first only steer the work; the result does not depend on them. No bucket, partner or
candidate is capped.

Defined results: a text with fewer than five words has one shingle of all of them; a null, empty or blank text has an
empty set, links with nothing and is its own component; a component is named by its smallest doc_id that is not null;
repeated rows are all returned; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm import signature_tree as trees
from weekpanel.llm.components import components
from weekpanel.llm.shared import Staging, fresh
from weekpanel.llm.tokens import Words, distinct, slices

#: A chunk of the first pass has some four million shingles; those met so often in one count as frequent.
CHUNK = 4_000_000
OFTEN = 4
#: At most so many frequent shingles are kept (the most frequent ones): they only set the order.
FREQUENT = 2**18
#: Members of a chunk of a block, checks for one copy of a hub's set, and rows up to which ids are broadcast.
MEMBERS = 512
CHECKS = 128
BROADCAST_ROWS = 1_000_000
SEEDS = 3
TURNS = 1
#: Of the mixed blocks of a class, in the order of their shingles, a member of one knows so many that come before it.
BEHIND = 32
#: What a member of a block carries besides its bitmap.
MEMBER = ("class", "n", "component", "ahead", "before")


# -- sets and the shingles by which they are found --------------------------------------------------------------------


def _often(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        shingles, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts >= OFTEN
        arrays = [pa.array(shingles[often].view(np.int64)), pa.array(counts[often])]
        return pa.RecordBatch.from_arrays(arrays, ["shingle", "n"])

    parts, size = [], 0
    for _, texts in slices(batches):
        parts += distinct(*Words(texts).shingles())
        size += sum(map(len, parts[-len(texts) :]))
        if size >= CHUNK:
            yield counted(parts)
            parts, size = [], 0
    if size:
        yield counted(parts)


def frequent_shingles(docs: DataFrame, staging: Staging) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` shingles in ascending order, and how often each was met where it was frequent."""
    met = docs.select("text").mapInArrow(_often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    met = staging.write(met, "frequent")
    classes = met.groupBy(F.floor(F.log2("n")).alias("k")).count().orderBy(F.desc("k")).collect()  # some dozens of rows
    least, total = 62, 0
    for row in classes:
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["k"]
    kept = met.filter(F.col("n") >= 2**least).toPandas()  # at most FREQUENT rows
    staging.drop("frequent")
    shingles, counts = kept["shingle"].to_numpy(np.int64).view(np.uint64), kept["n"].to_numpy(np.int64)
    order = np.argsort(shingles)
    return shingles[order], counts[order]


SETS = "doc_id long, hash long, n long, class long, print binary, bits binary, rare array<long>, often array<long>"


def _sets(batches: Iterable[pa.RecordBatch], frequent, salt: int) -> Iterator[pa.RecordBatch]:
    often, times = frequent.value
    met: set[bytes] = set()
    for batch, texts in slices(batches):
        sets = distinct(*Words(texts).shingles())
        bits = trees.bitmaps(sets)
        classes, prints, maps, found_by = [], [], [], ([], [])
        for k, one in enumerate(sets):
            if not len(one):
                classes.append(None), prints.append(None), maps.append(None)
                found_by[0].append(None), found_by[1].append(None)
                continue
            digest = blake2b(one.tobytes(), digest_size=16, salt=salt.to_bytes(16)).digest()
            prints.append(digest)
            classes.append(int.from_bytes(digest[:8], "little", signed=True))
            if digest in met:  # a copy of one that this task has described already
                maps.append(None), found_by[0].append(None), found_by[1].append(None)
                continue
            met.add(digest)
            maps.append(bits[k].tobytes())
            for column, finders in zip(found_by, _first(one, often, times), strict=True):
                column.append(finders.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("hash"),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array(classes, pa.int64()),
                pa.array(prints, pa.binary()),
                pa.array(maps, pa.binary()),
                *(pa.array(column, pa.list_(pa.int64())) for column in found_by),
            ],
            ["doc_id", "hash", "n", "class", "print", "bits", "rare", "often"],
        )


def finders(size: int) -> int:
    """A set that links with another shares one of its first so many elements: ``size - ceil(3/4 size) + 1``."""
    return size // 4 + 1


def _first(one: np.ndarray, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements by which a set is found, those that are not frequent first; the frequent ones apart."""
    count = finders(len(one))
    if not len(often):
        return one[:count], one[:0]
    at = np.minimum(np.searchsorted(often, one), len(often) - 1)
    rank = np.where(often[at] == one, times[at], 0)
    order = np.lexsort((one, rank))[:count] if rank.any() else np.arange(count)
    met = rank[order] > 0
    return one[order[~met]], one[order[met]]


def described(docs: DataFrame, staging: Staging) -> tuple[DataFrame, int]:
    """Staged: one row per document, with its class; the first of a class in each task also has what finds it.

    Also the salt of the class hashes."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, staging))  # at most FREQUENT pairs of numbers
    for salt in range(64):
        slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
        name = f"sets-{salt}"
        sets = staging.write(slim.mapInArrow(lambda it, s=salt: _sets(it, frequent, s), SETS), name)
        prints = sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("print").alias("x"), F.max("print").alias("y"))
        if prints.filter("x <> y").isEmpty():
            return sets, salt
        staging.drop(name)  # two prints of 128 bits begin with the same 64: hash again with another salt
    raise RuntimeError("class hashes collide with every salt")


# -- candidates -------------------------------------------------------------------------------------------------------


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {}
    for name in batch.schema.names:
        column = batch.column(name)
        if name == "bits":  # all of one length
            width = trees.BITS // 8
            data = np.frombuffer(column.buffers()[2], np.uint8, count=width * batch.num_rows, offset=column.offset * width)
            out[name] = data.reshape(batch.num_rows, width)
        elif name == "before":  # at most BEHIND in a row; the others are filled with the block itself
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            shingles = batch.column("shingle").to_numpy(zero_copy_only=False)
            out[name] = np.repeat(shingles[:, None], BEHIND, axis=1)
            out[name][np.arange(BEHIND) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key, one block after the other, from batches sorted by the keys."""
    held: list[dict[str, np.ndarray]] = []

    def block() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch)
        changes = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            changes[1:] |= columns[k][1:] != columns[k][:-1]
        if held and any(held[-1][k][-1] != columns[k][0] for k in keys):
            yield block()
            held = []
        cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin:
                yield block()
                held = []
            held.append({c: x[begin:end] for c, x in columns.items()})
    if held:
        yield block()


def _unique(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else [()] * 2))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["a", "b"])


def _gathered(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(a, b): the pairs, once for some 100,000 of them."""
    held, rows = [], 0
    for a, b in found:
        held.append((a, b))
        rows += len(a)
        if rows > 100_000:
            yield _unique(held)
            held, rows = [], 0
    yield _unique(held)


def _nearest_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in _blocks(batches, ["shingle", "chunk"]):
            if len(block["class"]) == 1:
                continue
            classes, once = np.unique(block["class"], return_index=True)
            nodes = trees.members(block["bits"][once], block["n"][once], block["component"][once])
            pairs = trees.nearest(nodes)
            yield classes[pairs[:, 0]], classes[pairs[:, 1]]

    return _gathered(found())


def _enough(n_a: np.ndarray, n_b: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Can sets of these sizes be a link if they meet in so many blocks?

    The common elements of a pair's sets that are among the finders of the one whose finders end first are among
    those of the other, too. So they share no more than the number of their blocks and what is left of that set.
    """
    rest = np.maximum(n_a - (n_a // 4 + 1), n_b - (n_b // 4 + 1))
    return trees.OF * (blocks + rest) >= trees.PART * (n_a + n_b)


def _met(before: np.ndarray, shingle: int, i: np.ndarray, j: np.ndarray, at_once: int = 2**25) -> np.ndarray:
    """For pairs of members of a block: do both know one and the same block that comes before it?"""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    known, which = np.unique(before[used], return_inverse=True)
    table = np.zeros((len(used), len(known)), dtype=bool)
    table[np.arange(len(used))[:, None], which.reshape(len(used), -1)] = True
    table = np.packbits(table[:, (known != shingle) & (table.sum(axis=0) > 1)], axis=1)
    out, step = np.zeros(len(i), dtype=bool), max(1, at_once // max(1, table.shape[1]))
    for k in range(0, len(i), step):
        pairs = slice(k, k + step)
        out[pairs] = (table[at[: len(i)][pairs]] & table[at[len(i) :][pairs]]).any(axis=1)
    return out


def _cross_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block that may be links, unless they are known to meet in an earlier one.

    The first block in which a pair meets gives it. There, all the blocks that they share lie ahead.
    """

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in _blocks(batches, ["shingle", "one", "two"]):
            sides = []
            for chunk in dict.fromkeys((block["one"][0], block["two"][0])):
                here = np.flatnonzero(block["chunk"] == chunk)
                here = here[np.lexsort((block["n"][here], block["component"][here]))]
                sides.append((here, trees.members(block["bits"][here], block["n"][here], block["component"][here])))
            pairs = trees.dual_traversal(sides[0][1], sides[1][1] if len(sides) > 1 else None)
            i, j = sides[0][0][pairs[:, 0]], sides[-1][0][pairs[:, 1]]
            n, ahead = block["n"], block["ahead"]
            may = _enough(n[i], n[j], np.minimum(ahead[i], ahead[j]))
            i, j = i[may], j[may]
            if len(i):
                new = ~_met(block["before"], block["shingle"][0], i, j)
                yield block["class"][i[new]], block["class"][j[new]]

    return _gathered(found())


def _meet_enough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their classes' sizes and lists of blocks: those that meet in enough blocks to be a link."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        names = ("shingles_a", "shingles_b", "weights_a")
        lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in names]
        blocks = np.zeros(batch.num_rows, np.int64)
        for k in range(batch.num_rows):
            x, y, weights = (values[offsets[k] : offsets[k + 1]] for offsets, values in lists)
            _, common, _ = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            blocks[k] = weights[common].sum()
        yield batch.select(["a", "b"]).filter(pa.array(_enough(n_a, n_b, blocks)))


def _in_sorted_blocks(rows: DataFrame, keys: list[str], run) -> DataFrame:
    """(a, b): the pairs that a function over blocks gives."""
    pairs = rows.repartition(*keys).sortWithinPartitions(*keys, "class").mapInArrow(run, "a long, b long")
    return pairs.distinct()


def _small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of a few numbers a row: broadcast up to so many rows, else left to a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _shared_shingles(sets: DataFrame, staging: Staging) -> DataFrame:
    """Staged (shingle, class, n, weight): the blocks of finding shingles that hold more than one class.

    Shingles of one passage find the same classes. Of blocks with the same members, told by their number, the least and two
    sums of hashes of the classes (some 150 bits), one is kept, with the number of such blocks as its weight. The block of a shingle that
    is not frequent is read through a window, which is one shuffle; frequent ones are summed up on the map side.
    """
    rows = sets.filter("rare IS NOT NULL")
    rare = rows.select(F.explode("rare").alias("shingle"), "class", "n")
    block = Window.partitionBy("shingle")
    least = F.min("class")
    rare = rare.withColumn("_several", least.over(block) != F.max("class").over(block)).filter("_several")
    rare = rare.drop("_several").distinct()
    print_ = {
        "_k": F.count("*"),
        "_sum": F.sum(F.xxhash64("class").bitwiseAND(F.lit(2**31 - 1))),
        "_xor": F.bit_xor(F.xxhash64("class", F.lit(1))),
        "_least": least,
    }
    rare = rare.withColumns({name: value.over(block) for name, value in print_.items()})
    often = staging.write(rows.select(F.explode("often").alias("shingle"), "class", "n").distinct(), "often")
    blocks = often.groupBy("shingle").agg(*(value.alias(name) for name, value in print_.items())).filter("_k > 1")
    often = often.join(_small(staging.write(blocks, "often-blocks")), "shingle")  # at most FREQUENT blocks
    every = staging.write(rare.unionByName(often), "every")
    alike = every.filter("class = _least").groupBy("_k", "_sum", "_xor", "_least")
    kept = staging.write(alike.agg(F.min("shingle").alias("shingle"), F.count("*").alias("weight")), "kept-blocks")
    kept = _small(kept.select("shingle", "weight"))
    shared = staging.write(every.join(kept, "shingle").select("shingle", "class", "n", "weight"), "shared")
    staging.drop("often", "often-blocks", "every", "kept-blocks")
    return shared


def _mixed(rows: DataFrame, roots: DataFrame, staging: Staging, name: str) -> DataFrame:
    """Staged (shingle, class, n, weight, component, k): the blocks that hold several components, with their sizes."""
    roots = _small(roots.withColumnRenamed("node", "class"))
    component = F.coalesce("root", "class").alias("component")
    known = rows.join(roots, "class", "left").select("shingle", "class", "n", "weight", component)
    low, high, k = F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k")
    blocks = known.groupBy("shingle").agg(low, high, k).filter("low <> high").select("shingle", "k")
    blocks = staging.write(blocks, f"{name}-blocks")
    mixed = staging.write(known.join(_small(blocks), "shingle"), name)
    staging.drop(f"{name}-blocks")
    return mixed


def _first_candidates(rows: DataFrame, maps: DataFrame, staging: Staging, turn: int) -> DataFrame:
    """Staged (a, b): every class and its nearest one of another component, in a few of its blocks (its least ones by
    several hashes).

    These are only tried first, so a large block may be looked at in chunks; its smallest class is in all of them.
    """
    least = [F.min_by("shingle", F.xxhash64("shingle", F.lit(SEEDS * turn + k))) for k in range(SEEDS)]
    seeds = rows.groupBy("class", "component").agg(F.array_distinct(F.array(*least)).alias("shingles"))
    seeds = staging.write(seeds.select(F.explode("shingles").alias("shingle"), "class", "component"), f"seeds-{turn}")
    first = F.min(F.struct("class", "component"))
    blocks = seeds.groupBy("shingle").agg(first.alias("first"), F.count("*").alias("k")).filter("k > 1")
    blocks = staging.write(blocks.withColumn("chunks", F.ceil(F.col("k") / MEMBERS)), f"seed-blocks-{turn}")
    chunk = F.pmod(F.xxhash64("shingle", "class"), F.col("chunks")).alias("chunk")
    members = seeds.join(blocks, "shingle").select("shingle", chunk, "class", "component")
    every = F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk")
    members = members.unionByName(blocks.select("shingle", every, "first.*"))
    members = members.join(maps, "class").select("shingle", "chunk", "class", "n", "component", "bits")
    pairs = staging.write(_in_sorted_blocks(members, ["shingle", "chunk"], _nearest_pairs), f"nearest-{turn}")
    staging.drop(f"seeds-{turn}", f"seed-blocks-{turn}")
    return pairs


def _cross_candidates(mixed: DataFrame, maps: DataFrame, staging: Staging) -> DataFrame:
    """Staged (a, b): pairs of classes in different components that may be links, from all blocks that have any.

    A pair that meets in too few blocks is no link. Where it is first met, its blocks are bounded by what lies ahead of
    both members (``ahead``, weights of blocks from this one on); then they are counted, once for each pair. Blocks are
    in the order of their shingles. A member knows the ``BEHIND`` blocks of its class before this one, so a pair that
    shares many blocks is not found in all of them.
    """
    # The largest shingle first, so that what lies ahead is a running sum.
    blocks = Window.partitionBy("class").orderBy(F.desc("shingle"))
    ahead = F.sum("weight").over(blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.collect_list("shingle").over(blocks.rowsBetween(1, BEHIND))
    mixed = staging.write(mixed.withColumns({"ahead": ahead, "before": before}), "placed")
    small = mixed.filter(F.col("k") <= MEMBERS)  # one chunk, which meets itself
    small = small.select("shingle", *(F.lit(0).cast("long").alias(c) for c in ("one", "two", "chunk")), *MEMBER)
    members = small.unionByName(_meetings(mixed.filter(F.col("k") > MEMBERS), staging))
    members = members.join(maps.select("class", "bits"), "class")
    pairs = staging.write(_in_sorted_blocks(members, ["shingle", "one", "two"], _cross_pairs), "cross-pairs")
    staging.drop("large-shares", "pools", "chunked", "chunks", "meetings")
    asked = staging.write(pairs.selectExpr("explode(array(a, b)) AS class").distinct(), "asked")
    met = F.sort_array(F.collect_list(F.struct("shingle", "weight"))).alias("met")
    lists = mixed.join(_small(asked), "class", "left_semi").groupBy("class", "n").agg(met)
    lists = staging.write(lists.select("class", "n", "met.shingle", "met.weight"), "block-lists")
    of_a = lists.toDF("a", "n_a", "shingles_a", "weights_a")
    of_b = lists.drop("weight").toDF("b", "n_b", "shingles_b")
    pairs = staging.write(pairs.join(of_a, "a").join(of_b, "b").mapInArrow(_meet_enough, "a long, b long"), "cross")
    staging.drop("cross-pairs", "placed", "asked", "block-lists")
    return pairs


def _meetings(large: DataFrame, staging: Staging) -> DataFrame:
    """(shingle, one, two, chunk and members): pairs of chunks of large blocks that may hold a link between components."""
    low, high = F.min("component").alias("low"), F.max("component").alias("high")
    # Chunks of bounded size. A component with many members in a block has chunks of its own, small ones share.
    # Sizes that differ by more than a third are in different chunks.
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).alias("band")
    large = large.select("shingle", *MEMBER, band)
    own = large.groupBy("shingle", "band", "component").agg(F.count("*").alias("k"))
    own = own.filter(F.col("k") > MEMBERS / 4).withColumn("parts", F.ceil(F.col("k") / MEMBERS)).drop("k")
    own = staging.write(own, "large-shares")
    pooled = large.groupBy("shingle", "band").agg(F.count("*").alias("k"))
    pooled = staging.write(pooled.select("shingle", "band", F.ceil(F.col("k") / MEMBERS).alias("pools")), "pools")
    rows = large.join(own, ["shingle", "band", "component"], "left").join(pooled, ["shingle", "band"])
    chunk = F.when(
        F.col("parts").isNotNull(),
        F.xxhash64("band", F.lit("own"), "component", F.pmod(F.xxhash64("class"), F.col("parts"))),
    ).otherwise(F.xxhash64("band", F.lit("pool"), F.pmod(F.xxhash64("component"), F.col("pools"))))
    rows = staging.write(rows.select("shingle", chunk.alias("chunk"), *MEMBER), "chunked")

    # The upper nodes of the trees: one row per chunk, joined with those of the same shingle that may hold a link.
    nodes = rows.groupBy("shingle", "chunk").agg(F.min("n").alias("small"), F.max("n").alias("large"), low, high)
    nodes = staging.write(nodes, "chunks")
    one, two = nodes.alias("one"), nodes.alias("two")
    meet = one.join(two, F.col("one.shingle") == F.col("two.shingle")).filter(
        "one.chunk <= two.chunk AND 4 * one.large >= 3 * two.small AND 4 * two.large >= 3 * one.small"
        " AND (one.low <> one.high OR two.low <> two.high OR one.low <> two.low)"
    )
    meet = meet.selectExpr("one.shingle AS shingle", "one.chunk AS one", "two.chunk AS two")
    dealt = meet.withColumn("chunk", F.explode(F.array_distinct(F.array("one", "two"))))
    members = rows.join(staging.write(dealt, "meetings"), ["shingle", "chunk"])
    return members.select("shingle", "one", "two", "chunk", *MEMBER)


# -- checks on whole sets ---------------------------------------------------------------------------------------------


def _wanted(batches: Iterable[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        sets = [x.tobytes() for x in distinct(*Words(texts).shingles())]
        digests = [blake2b(x, digest_size=16, salt=salt.to_bytes(16)).digest() for x in sets]
        same = [d == p for d, p in zip(digests, batch.column("print").to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.binary())], ["class", "set"])
        yield out.filter(pa.array(same))


def _whole_sets(
    docs: DataFrame, sets: DataFrame, pairs: DataFrame, salt: int, staging: Staging, name: str
) -> DataFrame:
    """Staged (class, set) of the classes in ``pairs``, from one text of each."""
    wanted = staging.write(pairs.selectExpr("explode(array(a, b)) AS class").distinct(), f"{name}-wanted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash"))
    of_class = sets.join(wanted, "class", "left_semi").groupBy("class").agg(first.alias("at"), F.min("print").alias("print"))
    of_class = staging.write(of_class.select("class", "print", "at.*"), f"{name}-at")
    of_class = _small(of_class)
    slim = docs.select(
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
        F.xxhash64("text").alias("hash"),
        "text",
    )
    texts = slim.join(of_class, ["none", "id", "hash"]).select("class", "print", "text")
    return staging.write(texts.mapInArrow(lambda it: _wanted(it, salt), "class long, set binary"), name)


def _check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, hub = None, np.empty(0, np.uint64)
    for batch in batches:
        a, b = [], []
        columns = [batch.column(c).to_pylist() for c in ("hub", "part", "class")]
        sets = batch.column("set")
        for k, (h, part, c) in enumerate(zip(*columns, strict=True)):
            one = np.frombuffer(sets[k].as_buffer(), np.uint64)
            if h == c:
                key, hub = (h, part), one.copy()
                continue
            assert key == (h, part)
            shared = len(np.intersect1d(hub, one, assume_unique=True))
            if 100 * shared >= 75 * (len(hub) + len(one) - shared):
                a.append(h), b.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, whole: DataFrame, staging: Staging, name: str) -> DataFrame:
    """Staged (a, b): the pairs that are links. A set travels to each of its hubs once; a hub's set once per
    ``CHECKS`` checks, so that a hub with many partners is spread over many tasks."""
    parts = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHECKS))
    counts = staging.write(pairs.groupBy("a").agg(F.count("*").alias("n")), f"{name}-counts")
    dealt = pairs.join(counts, "a").select(F.col("a").alias("hub"), parts.alias("part"), F.col("b").alias("class"))
    dealt = staging.write(dealt, f"{name}-dealt")
    hubs = dealt.select("hub", "part", F.col("hub").alias("class")).distinct()
    # Numbers go to the sets where they are few enough, so that a set travels only once, to its hubs.
    asked = whole.join(_small(staging.write(dealt.unionByName(hubs), f"{name}-asked")), "class")
    own = (F.col("hub") == F.col("class")).desc()
    sorted_ = asked.repartition("hub", "part").sortWithinPartitions("hub", "part", own)
    links = staging.write(sorted_.select("hub", "part", "class", "set").mapInArrow(_check, "a long, b long"), name)
    staging.drop(f"{name}-counts", f"{name}-dealt", f"{name}-asked")
    return links


# -- the operator -----------------------------------------------------------------------------------------------------


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class, hash (of the text) and kept of every document.

    Kept is one document of each group: the one with the smallest doc_id, and of several texts under that the one with
    the smallest hash. Rows repeated with doc_id and text are all marked.
    """
    staging = Staging(docs.sparkSession, "near-join")
    sets, salt = described(docs, staging)
    maps = sets.filter("bits IS NOT NULL").select("class", "n", "bits").dropDuplicates(["class"])
    maps = staging.write(maps, "maps")
    shared = _shared_shingles(sets, staging)

    blocks = shared.withColumn("component", F.col("class"))
    links = tried = None
    for turn in range(TURNS):
        first = _first_candidates(blocks, maps, staging, turn)
        if tried is not None:
            first = staging.write(first.join(tried.select("a", "b"), ["a", "b"], "left_anti"), f"untried-{turn}")
        whole = _whole_sets(docs, sets, first, salt, staging, f"whole-{turn}")
        found = _links(first, whole, staging, f"links-{turn}")
        staging.drop(f"whole-{turn}")
        links, tried = (found, first) if tried is None else (links.unionByName(found), tried.unionByName(first))
        roots = components(links, staging, f"components-{turn}")
        blocks = _mixed(blocks.select("shingle", "class", "n", "weight"), roots, staging, f"mixed-{turn}")

    crossing = _cross_candidates(blocks, maps, staging).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    crossing = staging.write(crossing, "untried")
    staging.drop("shared", "cross", "maps", *(f"mixed-{turn}" for turn in range(TURNS)))
    more = _links(crossing, _whole_sets(docs, sets, crossing, salt, staging, "whole"), staging, "links")
    staging.drop("whole")
    roots = staging.write(components(links.unionByName(more), staging, "components"), "roots")

    # From here on a row is a class, not a document.
    first = F.min(F.struct(*_key()))
    classes = sets.filter("class IS NOT NULL").groupBy("class").agg(first.alias("first"))
    classes = staging.write(classes, "classes").join(roots.withColumnRenamed("node", "class"), "class", "left")
    classes = staging.write(classes.withColumn("root", F.coalesce("root", "class")), "rooted")
    named = staging.write(classes.groupBy("root").agg(F.min("first").alias("first")), "named")
    names = staging.write(classes.drop("first").join(named, "root").select("class", "first"), "names")
    staging.drop("classes", "rooted", "named")
    joined = sets.select("doc_id", F.col("n").alias("n_shingles"), "class", "hash").join(names, "class", "left")
    alone = F.col("class").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.when(~F.col("first.none"), F.col("first.id")))
    kept = alone | (F.struct(*_key()) == F.col("first"))
    return joined.withColumns({"component_id": component, "kept": kept}).drop("first")


def _key(text_hash: Column | None = None) -> list[Column]:
    """A document's doc_id and text hash as columns without nulls, null doc_ids last."""
    number = F.col("doc_id").cast("bigint")
    text_hash = F.coalesce(F.col("hash") if text_hash is None else text_hash, F.lit(0))
    return [number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), text_hash.alias("hash")]


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each group: the one with the smallest doc_id, null last.

    What is dropped is told by doc_id and text hash: a broadcast up to ``BROADCAST_ROWS`` of them, else a shuffle.
    """
    staging = Staging(docs.sparkSession, "one-per-group")
    groups = near_groups(docs)
    place, *names = fresh(docs.columns, "_place", "_none", "_id", "_hash")
    keys = [c.alias(n) for c, n in zip(_key(), names, strict=True)]
    keyed = groups.select("n_shingles", "kept", *keys)
    dropped = staging.write(keyed.filter(~F.col("kept")).select(*names).distinct(), "dropped")
    again = keyed.filter("kept AND n_shingles > 0").groupBy(*names).agg(F.count("*").alias("k")).filter("k > 1")
    again = staging.write(again.select(*names), "again")

    here = [c.alias(n) for c, n in zip(_key(F.xxhash64("text")), names, strict=True)]
    rows = docs.select("*", *here).join(_small(dropped), names, "left_anti")
    if not again.isEmpty():  # rows repeated with doc_id and text: one of them stays
        order = Window.partitionBy(*names).orderBy(F.xxhash64(*docs.columns))
        repeated = rows.join(_small(again), names, "left_semi").withColumn(place, F.row_number().over(order))
        rows = rows.join(_small(again), names, "left_anti").unionByName(repeated.filter(F.col(place) == 1).drop(place))
    return rows.select(*docs.columns)
