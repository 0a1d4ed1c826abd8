"""Word and shingle hashes of whole texts, computed with numpy over some megabytes of text at a time.

Words are runs of characters other than space and the controls 9 to 13, after lower-casing A-Z. A word's hash is a
polynomial over its bytes, finished by a mixer; a shingle's hash joins the hashes of its words. All are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
WIDTH = 5

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift), so that every bit of the result depends on all of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))
_VALUE[_SPACE] = 0
_POWERS = np.ones(0, dtype=_U)
_PLACES = mixed(np.arange(7, 64, dtype=_U) * _U(_BASE)) | _U(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(max(n, 64, 2 * len(_POWERS)), _U(_BASE | 1), dtype=_U)
        factors[0] = 1
        _POWERS = np.cumprod(factors, dtype=_U)
    return _POWERS


class Words:
    """The words of some texts: ``hashes``, and ``first[i]:first[i + 1]`` for those of text ``i``."""

    def __init__(self, texts: Sequence[bytes], plain: bytes | None = None):
        """``plain``: a table for ``bytes.translate`` that is applied first, such as punctuation to spaces."""
        joined = b"\n".join(texts).lower()
        if plain is not None:
            joined = joined.translate(plain)
        buffer = np.frombuffer(joined, dtype=np.uint8)
        inside = np.zeros(len(buffer) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[buffer]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.text_starts)
        if len(self.starts):
            upto = np.append(self.starts[1:], len(buffer))
            place = np.arange(len(buffer), dtype=np.int64)[self.starts[0] :]
            place -= np.repeat(self.starts, upto - self.starts)
            longest = int((self.ends - self.starts).max())
            powers = _powers(longest + 1)
            weighted = _VALUE[buffer[self.starts[0] :]] * powers[np.minimum(place, longest)]
            self._weighted, self._place = weighted, place
            self.hashes = mixed(np.add.reduceat(weighted, self.starts - self.starts[0]))
        else:
            self._weighted = None
            self.hashes = np.empty(0, dtype=_U)

    def beginnings(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of every word."""
        if self._weighted is None:
            return np.empty(0, dtype=_U)
        first = np.where(self._place < size, self._weighted, _U(0))
        return mixed(np.add.reduceat(first, self.starts - self.starts[0]))

    def shingles(self, width: int = WIDTH, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words of a text, and where each text's begin.

        With ``short``, a text of fewer words has one shingle of all its words; without words it has none.
        """
        counts = np.diff(self.first)
        n = len(self.hashes) - width + 1
        if n > 0:
            rolled = self.hashes[:n] * _PLACES[0]
            for k in range(1, width):
                rolled = rolled + self.hashes[k : n + k] * _PLACES[k]
            rolled = mixed(rolled + _U(width))
        else:
            rolled = np.empty(0, dtype=_U)
        full = np.maximum(counts - width + 1, 0)
        few = (counts > 0) & (counts < width) if short else np.zeros(len(counts), dtype=bool)
        first = np.concatenate(([0], np.cumsum(full + few)))
        out = np.empty(first[-1], dtype=_U)
        # Every word but the last width - 1 of its text begins a shingle.
        text = np.repeat(np.arange(len(counts)), counts)
        begins = np.arange(len(self.hashes)) - self.first[text] < full[text] if len(text) else np.empty(0, dtype=bool)
        slots = np.ones(len(out), dtype=bool)
        slots[first[:-1][few]] = False
        out[slots] = rolled[begins[: len(rolled)]]
        for i in np.flatnonzero(few):
            words = self.hashes[self.first[i] : self.first[i + 1]]
            out[first[i]] = mixed((words * _PLACES[: len(words)]).sum(dtype=_U, keepdims=True) + _U(len(words)))[0]
        return out, first


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with some megabytes of text each (one text at least), and their texts as bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = _sizes(texts)
        begin = 0
        while begin < batch.num_rows:
            total = np.cumsum(sizes[begin:])
            end = begin + max(1, int(np.searchsorted(total, size, side="right")))
            yield batch.slice(begin, end - begin), [x or b"" for x in texts.slice(begin, end - begin).to_pylist()]
            begin = end


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def distinct(shingles: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    return [np.unique(shingles[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
