"""Operator 1: benchmark decontamination by greedy string tiling.

Texts are compared as words, in lower case and with ASCII punctuation as spaces. Documents meet benchmark items where
they share a run of ``MIN_MATCH`` words (a seed); only around its seeds is a document compared with an item. There,
greedy string tiling marks the longest matches first: windows of a search length are hashed by Karp and Rabin's
rolling hash, matches are extended word by word, marked from the longest to the shortest where nothing of them is
marked yet, and the search length is halved down to ``MIN_MATCH``. The share of an item's words under tiles is its
coverage; tiles may lie in any order, so that a reordered passage counts as much as a verbatim one.

A document is contaminated by an item when coverage is at least ``COVERAGE``. Words that no seed covers cannot be
under a tile, so an item whose seeds cover less is left out before tiling.

The benchmark goes to the tasks in blocks of bounded size, each held against all documents; no document is shuffled.

Defined results: null and empty texts are never contaminated; an item of fewer than ``MIN_MATCH`` words has no seed
and contaminates nothing; equal items and repeated rows give equal rows once per (doc_id, item_id) pair; an empty
benchmark or an empty table gives no rows (and drops no documents); further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.tokens import Words, slices

MIN_MATCH = 5
COVERAGE = 0.5
#: Bytes of benchmark text that go to the tasks at once (about; items are dealt by a hash).
BLOCK_BYTES = 8_000_000

#: ASCII punctuation and controls become spaces; letters, digits and all bytes beyond ASCII are kept.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MODULUS = (1 << 61) - 1
_BASE = 1_000_003


def plain_words(texts: list[bytes]) -> Words:
    return Words([t.decode("utf-8", "replace").lower().encode() for t in texts], PLAIN)


@dataclass
class Items:
    """Some benchmark items: their ids and words, and their seeds in ascending order with where they occur."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray


def items_of(rows: Iterable[tuple]) -> Items:
    ids, texts = [], []
    for number, text in rows:
        ids.append(number), texts.append((text or "").encode())
    found = plain_words(texts) if texts else None
    words = [found.hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)] if texts else []
    if texts:
        shingles, first = found.shingles(MIN_MATCH, short=False)
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        place = np.arange(len(shingles)) - first[item] if len(item) else np.empty(0, np.int64)
    else:
        shingles, item, place = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(shingles, kind="stable")
    seeds, at = np.unique(shingles[order], return_index=True)
    return Items(ids, words, seeds, np.append(at, len(order)), item[order], place[order])


# -- greedy string tiling ---------------------------------------------------------------------------------------------


def _windows(words: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of every run of ``length`` unmarked words, by a rolling hash."""
    top = pow(_BASE, length - 1, _MODULUS)
    value, run = 0, 0
    for k, word in enumerate(words):
        if marked[k]:
            value, run = 0, 0
            continue
        if run == length:
            value = (value - words[k - length] * top) % _MODULUS
            run -= 1
        value = (value * _BASE + word) % _MODULUS
        run += 1
        if run == length:
            yield value, k - length + 1


def tiles(item: list[int], text: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (place in item, place in text, length), the longest first."""
    in_item, in_text = [False] * len(item), [False] * len(text)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(20, len(item)))
    while True:
        matches, longest = [], 0
        table: dict[int, list[int]] = {}
        for value, start in _windows(item, in_item, length):
            table.setdefault(value, []).append(start)
        for value, t in _windows(text, in_text, length):
            for p in table.get(value, ()):
                n = 0
                while (
                    p + n < len(item)
                    and t + n < len(text)
                    and item[p + n] == text[t + n]
                    and not in_item[p + n]
                    and not in_text[t + n]
                ):
                    n += 1
                if n >= length:
                    matches.append((n, p, t))
                    longest = max(longest, n)
            if longest > 2 * length:
                break
        if longest > 2 * length:  # a much longer match: look for such first
            length = longest
            continue
        for n, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(in_item[p : p + n]) and not any(in_text[t : t + n]):
                in_item[p : p + n] = [True] * n
                in_text[t : t + n] = [True] * n
                found.append((p, t, n))
        # What a marked match took away from another is found again at this length, until nothing is marked.
        if any(not any(in_item[p : p + length]) and not any(in_text[t : t + length]) for _, p, t in matches):
            continue
        if length <= least:
            return found
        length = max(least, length // 2)


# -- documents against a block of items -------------------------------------------------------------------------------


def _around(places: np.ndarray, words: np.ndarray) -> list[int]:
    """The words under the seeds at ``places``, a word that is no other's between stretches that do not touch."""
    covered = np.unique((places[:, None] + np.arange(MIN_MATCH)).ravel())
    out, previous, gaps = [], None, 0
    for k in covered.tolist():
        if previous is not None and k != previous + 1:
            gaps += 1
            out.append(-gaps)
        out.append(int(words[k]))
        previous = k
    return out


def _contaminations(texts: list[bytes], items: Items, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, words of the item under tiles, number of tiles) where coverage is reached."""
    words = plain_words(texts)
    shingles, first = words.shingles(MIN_MATCH, short=False)
    if not len(items.seeds) or not len(shingles):
        return
    at = np.minimum(np.searchsorted(items.seeds, shingles), len(items.seeds) - 1)
    hits = np.flatnonzero(items.seeds[at] == shingles)
    of_text = np.searchsorted(first, hits, side="right") - 1
    for text in np.unique(of_text):
        mine = hits[of_text == text]
        seed = at[mine]
        counts = items.first[seed + 1] - items.first[seed]
        entry = np.repeat(items.first[seed] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        item, place = items.item[entry], items.place[entry]
        in_text = np.repeat(mine - first[text], counts)
        own = words.hashes[words.first[text] : words.first[text + 1]]
        for one in np.unique(item):
            here = item == one
            size = len(items.words[one])
            if len(np.unique((place[here][:, None] + np.arange(MIN_MATCH)).ravel())) < coverage * size:
                continue
            found = tiles(items.words[one].tolist(), _around(np.unique(in_text[here]), own))
            covered = sum(n for _, _, n in found)
            if covered and covered >= coverage * size:
                yield int(text), int(one), covered, len(found)


FOUND = "doc_id long, item_id long, covered long, item_words long, n_tiles long"


def _found(batches: Iterable[pa.RecordBatch], items, coverage: float) -> Iterator[pa.RecordBatch]:
    block = items.value
    for batch, texts in slices(batches):
        rows = list(_contaminations(texts, block, coverage))
        docs = batch.column("doc_id").to_pylist()
        columns = [
            pa.array([docs[r[0]] for r in rows], pa.int64()),
            pa.array([block.ids[r[1]] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([len(block.words[r[1]]) for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "covered", "item_words", "n_tiles"])


def _free(batches: Iterable[pa.RecordBatch], items, coverage: float) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[[row[0] for row in _contaminations(texts, items.value, coverage)]] = False
        yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame) -> Iterator:
    """The benchmark as broadcast blocks of about ``BLOCK_BYTES`` each."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    slim = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = slim.agg(F.sum(size)).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for k in range(count):
        rows = slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(items_of(rows))


def contaminations(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, covered, item_words, n_tiles and coverage."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], FOUND)
    for items in _blocks(benchmark):
        out = out.unionByName(slim.mapInArrow(lambda it, i=items: _found(it, i, coverage), FOUND))
    return out.distinct().withColumn("coverage", F.col("covered") / F.col("item_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    for items in _blocks(benchmark):
        docs = docs.mapInArrow(lambda it, i=items: _free(it, i, coverage), docs.schema)
    return docs
