"""Operator 13: words and their commoner spelling variants, by a dictionary of pairs of trie nodes.

Words are counted with Spark and sorted twice, forward and reversed. A scan over the sorted words numbers the nodes of the
two tries: a prefix that a word shares with its neighbour in the order is the neighbour's node, the others are new. Only
nodes that two words or more pass matter, so only those get numbers. A word is then a row per skipped position (the node
of what is before it, the node of what is behind it) and per position where one could be inserted. Words that meet in a
pair of nodes are neighbours: two that skip a position differ by one replaced code point, one that skips and one that
does not by one inserted one. Integers are all that is shuffled.

The rows that meet in a pair have one word on the inserting side (both nodes spell it) and at most one per letter of the
alphabet on the skipping side, so no group grows with the data. Pairs within a group are not written out either: a word's
best neighbour is the first or second of its group, and the number of neighbours is the size of the group. Skipping any
letter of a run of equal ones gives the same word; only the last of the run counts for insertions.

Defined results: null and empty texts have no words; in documents without an id no code point is deleted; repeated rows
count each; runs of any length are taken whole; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.shared import UPPER, Staging

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form must be so many times as frequent as its variant.
TIMES = 10
#: Where this divides the hash of a document's run, one code point of the run is deleted.
DELETE_EVERY = 31
#: Texts are searched in pieces of about so many characters, cut between runs.
PIECE = 1 << 20

LETTER = "A-Za-zÀ-ÿ"
_LOWER = str.maketrans(UPPER, UPPER.lower())


def pieces(text: str, length: int = PIECE) -> Iterator[str]:
    """The text in pieces of ``length`` or longer, cut before a character that belongs to no run."""
    outside, start = re.compile(f"[^{LETTER}]"), 0
    while len(text) - start > length:
        cut = outside.search(text, start + length)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def words_of(doc_id: int | None, text: str, least: int = LEAST_LENGTH) -> Counter[str]:
    """The words of one document, with A-Z lower-cased and the deletions that its id asks for.

    Whether a code point is deleted depends on the document and the run alone, so it is settled once per different run.
    A greedy search for ``least`` letters or more finds the maximal runs that are long enough, and no shorter ones matter.
    """
    runs: Counter[str] = Counter()
    pattern = re.compile(f"[{LETTER}]{{{least},}}")
    for piece in pieces(text):
        runs.update(pattern.findall(piece))
    lowered: Counter[str] = Counter()
    for run, n in runs.items():
        lowered[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    if doc_id is None:
        return lowered
    start, out = crc32(f"{doc_id}:".encode()), Counter()
    for run, n in lowered.items():
        hashed = crc32(run.encode(), start)
        if hashed % DELETE_EVERY == 0:
            at = hashed % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update(words_of(doc_id, text))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())}
        )


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words on ``least_count`` occurrences or more."""
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").filter(F.col("text").isNotNull())
    partial = texts.mapInArrow(_counted, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def common(one: str, other: str) -> int:
    """Length of the longest common prefix."""
    most = min(len(one), len(other))
    if one[:most] == other[:most]:
        return most
    low = 0
    while one[low] == other[low]:
        low += 1
    return low


@dataclass(frozen=True)
class Border:
    """What the words at a partition's ends share with the next partitions: the nodes of the prefixes of the first and
    the last word, from the empty one on, as far as they are shared."""

    last: str
    left: tuple[int, ...]
    right: tuple[int, ...]


def borders(ends: list[tuple[int, str, str]]) -> dict[int, Border]:
    """Number the nodes that partitions share. ``ends`` has each partition's number, first and last word, in order.

    A node in several partitions is a prefix of the words on both sides of every border between them, so it is told by
    walking along the borders: it is the node of the border before where the partition between lies below it as a whole.
    Numbers are negative; those of nodes inside a partition are not.
    """
    fresh, shared = -1, []
    for k in range(len(ends) - 1):
        width = common(ends[k][2], ends[k + 1][1]) + 1
        whole = common(ends[k][1], ends[k][2]) + 1
        kept = shared[k - 1][: min(width, whole)] if k else ()
        shared.append((*kept, *range(fresh, fresh - (width - len(kept)), -1)))
        fresh -= width - len(kept)
    none: tuple[int, ...] = ()
    return {
        part: Border(last, shared[k - 1] if k else none, shared[k] if k < len(shared) else none)
        for k, (part, _, last) in enumerate(ends)
    }


def numbered(words: Iterable[str], part: int, border: Border) -> Iterator[list[int]]:
    """For each word of a sorted partition, the nodes of its prefixes, from the empty one to the longest shared one."""
    held: list[int] = []
    fresh, previous, shared = part << 40, None, len(border.left) - 1

    def nodes(word: str, from_previous: int) -> list[int]:
        nonlocal fresh
        out = held[: from_previous + 1]
        along = min(common(word, border.last), len(border.right) - 1)
        for depth in range(len(out), len(word) + 1):
            if previous is None and depth < len(border.left):
                out.append(border.left[depth])
            elif depth <= along:
                out.append(border.right[depth])
            else:
                out.append(fresh)
                fresh += 1
        return out

    pending: tuple[list[int], int] | None = None
    for word in words:
        with_previous = -1 if previous is None else common(previous, word)
        if pending is not None:
            yield pending[0][: max(pending[1], with_previous) + 1]
        held = nodes(word, with_previous)
        pending = held, max(with_previous, shared if previous is None else -1)
        previous = word
    if pending is not None:
        yield pending[0][: max(pending[1], len(border.right) - 1) + 1]


def with_nodes(words: DataFrame, spelled: str, column: str, staging: Staging, number: str | None = None) -> DataFrame:
    """Add to unique words the array ``column``: the trie nodes of the prefixes of ``spelled`` that are shared.

    ``number`` names a further column for a number that ascends with ``spelled``. One range partitioning; the driver sees
    two words per partition. Scans keep the partitions they were planned for, since these are written down as a column.
    """
    fields = [f.name for f in words.schema.fields]
    ranged = words.repartitionByRange(spelled).withColumn("_part", F.spark_partition_id())
    placed = staging.write(ranged, f"{column}-placed")
    ends = placed.groupBy("_part").agg(F.min(spelled).alias("first"), F.max(spelled).alias("last")).orderBy("_part")
    known = borders([(r["_part"], r["first"], r["last"]) for r in ends.collect()])

    def found(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], int]]:
        """Nodes and number of each word. Several partitions may come one after the other; each is scanned anew."""
        for part, run in groupby(rows, key=itemgetter(0)):
            for k, nodes in enumerate(numbered(map(itemgetter(1), run), part, known[part])):
                yield nodes, (part << 40) + k

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def feed() -> Iterator[tuple[int, str]]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                yield from zip(batch.column("_part").to_pylist(), batch.column(spelled).to_pylist())

        ready = found(feed())
        for first in ready:
            batch = waiting.popleft()
            mine = [first, *islice(ready, batch.num_rows - 1)]
            more = {column: pa.array([nodes for nodes, _ in mine], pa.list_(pa.int64()))}
            if number is not None:
                more[number] = pa.array([k for _, k in mine], pa.int64())
            yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in fields} | more)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields)
    schema += f", {column} array<bigint>" + (f", {number} bigint" if number else "")
    ordered = placed.repartition("_part").sortWithinPartitions("_part", spelled)
    return staging.write(ordered.mapInArrow(scan, schema), column)


SKIP, SKIP_LAST, INSERT = 0, 1, 2


def pair_rows(words: DataFrame) -> DataFrame:
    """(id, n, kind, front, back): the pairs of shared nodes of each word, with one position skipped or one inserted.

    ``front`` has the nodes of the shared prefixes by length, ``back`` those of the shared suffixes; other pairs are the
    word's own and meet nobody.
    """
    skips = F.expr(
        """transform(sequence(greatest(0, length - size(back)), least(size(front) - 1, length - 1)), at -> struct(
            CASE WHEN substring(word, at + 1, 1) = substring(word, at + 2, 1) THEN 0 ELSE 1 END AS kind,
            get(front, at) AS front, get(back, length - at - 1) AS back))"""
    )
    inserts = F.expr(
        f"""transform(sequence(greatest(0, length - size(back) + 1), least(size(front) - 1, length)), at -> struct(
            {INSERT} AS kind, get(front, at) AS front, get(back, length - at) AS back))"""
    )
    some = words.withColumn("length", F.char_length("word"))
    first, last = F.expr("greatest(0, length - size(back))"), F.expr("least(size(front) - 1, length - 1)")
    first_in, last_in = F.expr("greatest(0, length - size(back) + 1)"), F.expr("least(size(front) - 1, length)")
    none = F.expr("CAST(array() AS array<struct<kind:int,front:bigint,back:bigint>>)")
    rows = F.concat(
        F.when(first <= last, skips).otherwise(none), F.when(first_in <= last_in, inserts).otherwise(none)
    )
    return some.select("id", "n", F.inline(rows))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): number of neighbours of each word that has one, and the most frequent (ties: smallest id).

    In a pair at most one word inserts, and the skipping words are one per letter. Of two skipping ones each is the
    other's neighbour; the inserting one is a neighbour of those that skip the last of their equal letters.
    """
    group = Window.partitionBy("front", "back")
    order = group.orderBy(F.col("kind") == INSERT, F.col("n").desc(), "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct(F.col("n"), (-F.col("id")).alias("minus"))
    skipping, last = F.col("kind") != INSERT, F.col("kind") == SKIP_LAST
    seen = pairs.select(
        "id",
        "kind",
        one.alias("self"),
        F.count_if(skipping).over(group).alias("skipping"),
        F.count_if(last).over(group).alias("last"),
        F.max(F.when(~skipping, one)).over(group).alias("inserting"),
        F.max(F.when(last, one)).over(group).alias("best_last"),
        F.nth_value(F.when(skipping, one), 1).over(whole).alias("first"),
        F.nth_value(F.when(skipping, one), 2).over(whole).alias("second"),
    )
    inserted = F.when(last, F.col("inserting"))
    other = F.when(F.col("first") == F.col("self"), F.col("second")).otherwise(F.col("first"))
    told = seen.select(
        "id",
        F.when(skipping, F.col("skipping") - 1 + inserted.isNotNull().cast("int")).otherwise(F.col("last")).alias("near"),
        F.when(skipping, F.greatest(other, inserted)).otherwise(F.col("best_last")).alias("best"),
    )
    return told.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def followed(forms: DataFrame, staging: Staging) -> DataFrame:
    """(id, root) of (id, form): forms followed to the last, every round twice as far.

    A form is several times as frequent as its variant, so chains are short and end.
    """
    ends = staging.write(forms.select("id", F.col("form").alias("root")), "root-0")
    turn = 0
    while True:
        further = ends.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = ends.join(further, "root", "left")
        turn += 1
        longer = staging.write(
            joined.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_moved")),
            f"root-{turn}",
        )
        if longer.filter("_moved").isEmpty():
            return longer.drop("_moved")
        ends = longer.drop("_moved")


def variants(docs: DataFrame, times: int = TIMES, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    staging = Staging(docs.sparkSession, "spelling")
    counted = staging.write(word_counts(docs, least_count), "counts")
    # Ids ascend with the words, so that of two ids the smaller one is the smaller word.
    forward = with_nodes(counted, "word", "front", staging, number="id")
    both = with_nodes(forward.withColumn("reversed", F.reverse("word")), "reversed", "back", staging)
    best = neighbours(staging.write(pair_rows(both), "pairs"))
    found = staging.write(
        best.select("id", "n_near", (-F.col("best.minus")).alias("near_id"), F.col("best.n").alias("near_n")), "neighbours"
    )
    words = forward.select("id", "word", "n")
    told = words.join(found, "id", "left").withColumn(
        "form", F.when(F.col("near_n") >= times * F.col("n"), F.col("near_id"))
    )
    told = staging.write(told, "told")
    roots = followed(told.filter("form IS NOT NULL"), staging)
    names = words.select("id", "word")
    forms = told.filter("form IS NOT NULL").select("id", "form").join(roots, "id")
    named = staging.write(
        forms.join(names.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
        .join(names.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
        .select("id", "form_word", "root_word"),
        "named",
    )
    return told.join(named, "id", "left").select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n"),
    )
