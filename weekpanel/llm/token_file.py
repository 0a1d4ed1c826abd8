"""Operator 5: token ids in a file of independently coded blocks.

Texts are encoded with a public tokenizer, the end id is appended to each, and the ids are written in ascending order
of doc_id as a Parquet table of blocks. A block holds at most ``BLOCK`` ids of whole documents (a longer document has
blocks of its own) and any block can be decoded alone; it carries the crc32 of its ids, which decoding checks.

A block begins with the frequencies of its ids (order 0) and is coded as streams of ``STREAM`` ids. The order-2 and the
order-1 context of an id in its stream each expect one id, with votes. Whether the former comes, and if not, whether the
latter does, are two events whose probabilities mix the records of the order-2 context, the order-1 context and of all
contexts in the logistic domain; records and weights begin anew in each stream and learn from a stretch of its ids at
once. Other ids have their order-0 share of what the events leave. A range coder takes the share of an id in one step.
All arithmetic is in integers, so that a file decodes on any machine. The streams of many blocks are coded in step, one
numpy operation for all of them.

Texts are encoded by pieces: a byte-level tokenizer parts them at places that their characters alone tell, and each
distinct piece is given to it once. Other tokenizers get whole texts.

Documents are range-partitioned once by doc_id; when read, one row per document and block is moved.

Defined results: null counts as the empty text and gives the end id alone; null doc_ids come first; rows that share
a doc_id are in the order of their texts' crc32; special tokens' strings in a text become what the tokenizer makes of
them; an empty table gives an empty file; further columns are left alone.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekpanel.llm.tokens import slices

BLOCK = 1 << 16
STREAM = 4096
TOGETHER = 128  # blocks that are coded in step
END_ID = 0

# -- the model --------------------------------------------------------------------------------------------------------

_I = np.int64
ONE = 4096  # a probability of 1
SLOT_BITS = 10
SLOTS = 1 << SLOT_BITS  # a context's place is a hash of its ids
SPREAD = 2047
SURE = 4  # degrees of how sure a context is of its id, 0: it has none
STATES = SURE * SURE * 2  # of the order-2 and the order-1 context, and whether they expect the same id


def _squash_table() -> np.ndarray:
    """ONE / (1 + exp(-x / 256)) for x from -SPREAD to SPREAD, rounded from exact decimals."""
    values = [Decimal(ONE) / (1 + (-Decimal(x) / 256).exp()) for x in range(-SPREAD, SPREAD + 1)]
    return np.array([min(max(int(v), 1), ONE - 1) for v in values], dtype=_I)


SQUASH = _squash_table()
#: The least x whose squashed value reaches a probability.
STRETCH = np.minimum(np.searchsorted(SQUASH, np.arange(ONE)), 2 * SPREAD).astype(_I) - SPREAD

_SURE_TWO, _SURE_ONE, _SAME = np.unravel_index(np.arange(STATES), (SURE, SURE, 2))
#: The records that are mixed in each state for the events "the id of order 2 comes" and, if not, "that of order 1 comes".
_PLACES = np.stack(
    [
        np.stack([own, SURE + other * 2 + _SAME, np.full(STATES, 3 * SURE)], axis=1)
        for own, other in ((_SURE_TWO, _SURE_ONE), (_SURE_ONE, _SURE_TWO))
    ]
)
_MAY = np.stack([_SURE_TWO > 0, (_SURE_ONE > 0) & ~((_SAME > 0) & (_SURE_TWO > 0))]).astype(_I)


_VOTE, _TWO_VOTES = np.int32(1 << 16), np.int32(2 << 16)


class Contexts:
    """The ids that the order-1 (row 0) and order-2 (row 1) contexts of each lane expect.

    An entry is the id and, above its 16 bits, its votes: one more where it came, one less where another did, which
    takes the place of an id of one vote.
    """

    def __init__(self, lanes: int):
        self.entries = np.zeros(2 * lanes * SLOTS, dtype=np.int32)
        self.base = np.arange(2 * lanes, dtype=_I).reshape(2, lanes) * SLOTS
        self.place, self.one = self.base.copy(), np.zeros(lanes, dtype=np.uint32)

    def expect(self, n: int) -> np.ndarray:
        self.now = self.place[:, :n]
        self.found = self.entries.take(self.now, mode="clip")
        return self.found

    def learn(self, ids: np.ndarray) -> None:
        """``ids``: int32."""
        n, found = len(ids), self.found
        votes = ((found & 0xFFFF) == ids).astype(np.int32)
        votes <<= 17
        votes += found  # in the place that follows, a vote less
        kept = votes >= _TWO_VOTES
        votes -= _VOTE
        np.copyto(votes, ids | _VOTE, where=np.logical_not(kept, out=kept))
        self.entries[self.now] = votes
        own = ids.view(np.uint32) * np.uint32(2654435761)
        hashed = np.empty((2, n), dtype=np.uint32)
        hashed[0] = own
        np.bitwise_xor(own, self.one[:n], out=hashed[1])
        hashed[1] *= np.uint32(2246822519)
        hashed >>= np.uint32(32 - SLOT_BITS)
        self.place = hashed + self.base[:, :n]
        self.one[:n] = own >> np.uint32(5)


def states(found: np.ndarray) -> np.ndarray:
    """The state of each lane from the entries of its two contexts (second axis from the end)."""
    sure = np.minimum(found >> 16, SURE - 1)
    one, two = found[..., 0, :], found[..., 1, :]
    return sure[..., 1, :] * (2 * SURE) + sure[..., 0, :] * 2 + ((one ^ two) & 0xFFFF == 0)


class Mixer:
    """Probabilities of the two events in every state of every lane; they learn from a stretch of ids at once."""

    def __init__(self, lanes: int):
        self.records = np.full((2, lanes, 3 * SURE + 1), ONE // 2, dtype=_I)
        self.weights = np.full((2, 3, lanes, 1), 1 << 15, dtype=_I)  # 1 is 1 << 16

    def edges(self, n: int) -> np.ndarray:
        """Where the shares (of ONE) of the order-2 id, the order-1 id and all ids begin and end, by lane and state."""
        self.inputs, self.chance = [], []
        for k in range(2):
            stretched = STRETCH[self.records[k, :n]]
            inputs = [stretched[:, _PLACES[k, :, i]] for i in range(3)]
            dot = sum(w[:n] * x for w, x in zip(self.weights[k], inputs, strict=True)) >> 16
            self.inputs.append(inputs)
            self.chance.append(SQUASH[np.clip(dot, -SPREAD, SPREAD) + SPREAD])
        two = self.chance[0] * _MAY[0]
        both = two + ((ONE - two) * self.chance[1] >> 12) * _MAY[1]
        return two.ravel(), both.ravel()

    def learn(self, keys: np.ndarray) -> None:
        """``keys``: (lane * STATES + state) * 3 + event of coded ids; 0: that of order 2 came, 1: that of order 1, 2: neither."""
        n = len(self.chance[0])
        events = np.bincount(keys, minlength=n * STATES * 3).reshape(n, STATES, 3)
        by_two, by_one, seen = events[..., 0], events[..., 1], events.sum(axis=2)
        for k, (met, came) in enumerate(((seen, by_two), (seen - by_two, by_one))):
            met, came = met * _MAY[k], came * _MAY[k]
            miss = came * ONE - met * self.chance[k]
            for weights, x in zip(self.weights[k], self.inputs[k], strict=True):
                change = np.clip((x * miss).sum(axis=1, keepdims=True) >> 10, -(1 << 13), 1 << 13)
                weights[:n] = np.clip(weights[:n] + change, -(1 << 20), 1 << 20)
            met, came = (_by_record(x.reshape(n, SURE, SURE, 2), k) for x in (met, came))
            old = self.records[k, :n]
            change = (came * ONE - met * old) // (met + 16)
            self.records[k, :n] = np.clip(old + change, 1, ONE - 1)


def _by_record(counts: np.ndarray, event: int) -> np.ndarray:
    """Counts of the states of each lane, summed for every record that ``_PLACES`` mixes in them."""
    if event:
        counts = counts.swapaxes(1, 2)
    other, n = sum(counts[:, k] for k in range(SURE)), len(counts)
    both = counts[..., 0] + counts[..., 1]
    own = sum(both[..., k] for k in range(SURE))
    return np.concatenate([own, other.reshape(n, -1), sum(own[:, k] for k in range(SURE))[:, None]], axis=1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Order 0: shares of 2^16 for ids met so often, each at least 1."""
    if not len(counts):
        return counts
    shares = 1 + counts * ((1 << 16) - len(counts)) // counts.sum()
    shares[np.argmax(shares)] += (1 << 16) - shares.sum()
    return shares


# -- the range coder --------------------------------------------------------------------------------------------------

_TOTAL = 28  # bits of all shares: 12 of the events, 16 of order 0
_LEAST = 1 << 31  # a narrower range takes in 32 more bits; at most 63 are in use
_MASK = (1 << 32) - 1


class Encoder:
    def __init__(self, lanes: int, room: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, (1 << 63) - 1, dtype=_I)
        self.out = np.zeros((lanes, room), dtype=_I)
        self.at = np.arange(lanes, dtype=_I) * room

    def code(self, below: np.ndarray, own: np.ndarray) -> None:
        n = len(below)
        step = self.range[:n] >> _TOTAL
        low, width = self.low[:n], self.range[:n]
        low += (below * step).view(np.uint64)
        np.multiply(own, step, out=width)
        more = np.flatnonzero(width < _LEAST)
        ahead, at = low[more], self.at[more]
        self.out.reshape(-1)[at] = (ahead >> np.uint64(31)).view(_I)  # a word's 33rd bit is carried in ``finish``
        low[more] = (ahead & np.uint64(_LEAST - 1)) << np.uint64(32)
        width[more] <<= 32
        self.at[more] = at + 1

    def finish(self) -> list[np.ndarray]:
        lanes, room = self.out.shape
        self.out.reshape(-1)[self.at] = ((self.low + np.uint64(_LEAST - 1)) >> np.uint64(31)).view(_I)
        sizes = self.at - np.arange(lanes) * room + 1
        for k in range(int(sizes.max()) - 1, 0, -1):
            self.out[:, k - 1] += np.where(k < sizes, self.out[:, k] >> 32, 0)
        return [(row[:n] & _MASK).astype("<u4") for row, n in zip(self.out, sizes, strict=True)]


class Decoder:
    def __init__(self, streams: list[np.ndarray]):
        room = max(map(len, streams)) + 3
        words = np.zeros((len(streams), room), dtype=_I)
        for k, stream in enumerate(streams):
            words[k, : len(stream)] = stream
        self.code = (words[:, 0] << 31) | (words[:, 1] >> 1)
        self.range = np.full(len(streams), (1 << 63) - 1, dtype=_I)
        self.words = (((words[:, 1:-1] & 1) << 31) | (words[:, 2:] >> 1)).astype(np.uint32).ravel()
        self.at = np.arange(len(streams), dtype=_I) * (room - 2)

    def find(self, n: int) -> np.ndarray:
        self.step = self.range[:n] >> _TOTAL
        return self.code[:n] // self.step

    def take(self, below: np.ndarray, own: np.ndarray) -> None:
        n = len(below)
        code, width = self.code[:n], self.range[:n]
        code -= below * self.step
        np.multiply(own, self.step, out=width)
        more = np.flatnonzero(width < _LEAST)
        at = self.at[more]
        code[more] = (code[more] << 32) | self.words.take(at, mode="clip")
        width[more] <<= 32
        self.at[more] = at + 1


@dataclass
class _Lanes:
    """The streams of some blocks, from the longest to the shortest."""

    sizes: list[int]

    def __post_init__(self):
        per_block = -(-np.array(self.sizes, dtype=_I) // STREAM)
        block = np.repeat(np.arange(len(self.sizes)), per_block)
        number = np.arange(len(block)) - np.repeat(np.cumsum(per_block) - per_block, per_block)
        length = np.minimum(np.array(self.sizes, dtype=_I)[block] - number * STREAM, STREAM)
        order = np.argsort(-length, kind="stable")
        self.block, self.begin, self.length = block[order], number[order] * STREAM, length[order]
        self.longest = int(self.length[0]) if len(order) else 0
        self.open = np.searchsorted(-self.length, -np.arange(self.longest), side="left")

    def real(self, begin: int, end: int, steps: np.ndarray) -> np.ndarray:
        """What rows of steps hold for streams that are still open."""
        wide = self.open[begin]
        if self.open[end - 1] == wide:
            return steps.ravel()
        return steps[np.arange(begin, end)[:, None] < self.length[:wide]]

    def stretches(self) -> Iterator[tuple[int, int]]:
        """Steps between which the mixer learns: 32 at first, then as many as were coded, at most 256."""
        begin = 0
        while begin < self.longest:
            end = min(begin + min(max(begin, 32), 256), self.longest)
            yield begin, end
            begin = end


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each block of ids below 65,536."""
    lanes = _Lanes([len(b) for b in blocks])
    n = len(lanes.block)
    room = lanes.longest + 32  # rows must not begin at the same place of a page
    all_ids, all_shares = np.zeros((n, room), dtype=np.uint16), np.zeros((n, room), dtype=np.uint32)
    heads, of_block = [], []
    for block in blocks:
        counts = np.bincount(block, minlength=1 << 16)
        met = np.flatnonzero(counts)
        own = frequencies(counts[met])
        packed = np.zeros(1 << 16, dtype=np.uint32)
        packed[met] = ((np.cumsum(own) - own) << 16) | own - 1
        of_block.append(packed[block])
        heads.append(zlib.compress(np.concatenate([np.diff(met, prepend=0), own - 1]).astype("<u2").tobytes()))
    for lane, (k, begin, length) in enumerate(zip(lanes.block, lanes.begin, lanes.length, strict=True)):
        all_ids[lane, :length] = blocks[k][begin : begin + length]
        all_shares[lane, :length] = of_block[k][begin : begin + length]
    contexts, mixer, coder = Contexts(n), Mixer(n), Encoder(n, lanes.longest + 8)
    for begin, end in lanes.stretches():
        wide = lanes.open[begin]
        ids, shares = (x[:wide, begin:end].T.astype(kind) for x, kind in ((all_ids, np.int32), (all_shares, _I)))
        ids, shares = np.ascontiguousarray(ids), np.ascontiguousarray(shares)
        found = np.zeros((end - begin, 2, wide), dtype=np.int32)
        for t in range(begin, end):
            now = lanes.open[t]
            found[t - begin, :, :now] = contexts.expect(now)
            contexts.learn(ids[t - begin, :now])
        keys = states(found) + np.arange(wide, dtype=_I) * STATES
        first, both = (x.take(keys) for x in mixer.edges(wide))
        came = (found & 0xFFFF) == ids[:, None]
        two = came[:, 1] & (first > 0)
        one = came[:, 0] & (both > first) & ~two
        rest = ONE - both
        below = np.where(two, 0, np.where(one, first << 16, (both << 16) + rest * (shares >> 16)))
        own = np.where(two, first << 16, np.where(one, both - first << 16, rest * ((shares & 0xFFFF) + 1)))
        for t in range(begin, end):
            coder.code(below[t - begin, : lanes.open[t]], own[t - begin, : lanes.open[t]])
        mixer.learn(lanes.real(begin, end, keys * 3 + 2 - one - 2 * two))
    streams = coder.finish() if n else []
    out: list[list] = [[] for _ in blocks]
    for lane in np.lexsort((lanes.begin, lanes.block)):
        out[lanes.block[lane]].append(streams[lane])
    return [
        b"".join([np.array([len(head), *map(len, words)], "<u4").tobytes(), head, *(w.tobytes() for w in words)])
        for head, words in zip(heads, out, strict=True)
    ]


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    lanes = _Lanes(sizes)
    n = len(lanes.block)
    if not n:
        return [np.empty(0, _I) for _ in payloads]
    slots = np.zeros((len(payloads), 1 << 16), dtype=np.uint16)
    packed, ranks, streams = [], np.zeros(len(payloads) + 1, dtype=_I), []
    for k, (payload, size) in enumerate(zip(payloads, sizes, strict=True)):
        lengths = np.frombuffer(payload, "<u4", 1 - -size // STREAM).astype(_I)
        at = 4 * len(lengths)
        head = np.frombuffer(zlib.decompress(payload[at : at + lengths[0]]), "<u2").astype(_I)
        met, own = np.cumsum(head[: len(head) // 2]), head[len(head) // 2 :] + 1
        packed.append(met | (np.cumsum(own) - own) << 16 | own << 32)
        slots[k] = np.repeat(np.arange(len(met), dtype=np.uint16), own)
        ranks[k + 1] = ranks[k] + len(met)
        words = np.frombuffer(payload, "<u4", offset=at + int(lengths[0]))
        streams.append(np.split(words, np.cumsum(lengths[1:])[:-1]))
    packed, slots = np.concatenate(packed), slots.ravel()
    block_slots, block_ranks = lanes.block * (1 << 16), ranks[lanes.block]
    contexts, mixer = Contexts(n), Mixer(n)
    coder = Decoder([streams[k][begin // STREAM] for k, begin in zip(lanes.block, lanes.begin, strict=True)])
    ids = np.zeros((lanes.longest, n), dtype=np.uint16)
    for begin, end in lanes.stretches():
        wide = lanes.open[begin]
        first, both = mixer.edges(wide)
        # The three events of a lane and state: where the share of each begins, and above 16 bits its width.
        events = np.stack([first << 16, first | (both - first) << 16, both | (ONE - both) << 16], axis=1).ravel()
        edges, lane_keys = first | both << 16, np.arange(wide, dtype=_I) * STATES
        keys = np.zeros((end - begin, wide), dtype=_I)
        for t in range(begin, end):
            now = lanes.open[t]
            found = contexts.expect(now)
            key = states(found) + lane_keys[:now]
            edge = edges.take(key, mode="clip")
            value = coder.find(now)
            top = value >> 16
            which = (top >= edge & 0xFFFF).view(np.int8) + (top >= edge >> 16).view(np.int8)
            seen = keys[t - begin, :now]
            np.multiply(key, 3, out=seen)
            seen += which
            share = events.take(seen, mode="clip")
            begins, width = (share & 0xFFFF) << 16, share >> 16
            slot = (value - begins) // width
            literal = packed.take(block_ranks[:now] + slots.take(block_slots[:now] + slot, mode="clip"), mode="clip")
            hit = np.flatnonzero(which < 2)
            literal[hit] = (found[1 - which[hit], hit] & 0xFFFF).astype(_I) | 1 << 48
            coder.take(begins + width * (literal >> 16 & 0xFFFF), width * (literal >> 32))
            got = (literal & 0xFFFF).astype(np.int32)
            contexts.learn(got)
            ids[t, :now] = got
        mixer.learn(lanes.real(begin, end, keys))
    by_lane = np.ascontiguousarray(ids.T)
    out = [np.empty(size, dtype=_I) for size in sizes]
    for lane, (k, begin, length) in enumerate(zip(lanes.block, lanes.begin, lanes.length, strict=True)):
        out[k][begin : begin + length] = by_lane[lane, :length]
    return out


# -- the tokenizer ----------------------------------------------------------------------------------------------------

PIECES = 1_000_000  # pieces whose ids are kept at once
WORDS = 24  # words in a text that is given to the tokenizer

_LETTER, _SIGN, _SPACE, _BREAK = 1, 2, 4, 8
_KIND = np.zeros(256, dtype=np.uint8)  # of ASCII characters; 0: other bytes, beside which nothing is parted
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KIND[32] = _SPACE
_KIND[9:14] = _BREAK
#: Neither blanks but a space before it nor characters of the lead bytes that blanks beyond ASCII have.
_WORD = re.compile(rb" ?[!-~\x80-\xc1\xc3-\xe0\xe4-\xff]+").fullmatch
#: Of letters alone, which no byte-level tokenizer parts.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: How byte-level tokenizers write the bytes of such pieces; 1 stands for the line end, which they write as a character.
_WRITTEN = {1: "\u010a", 32: "\u0120", 0xAD: "\u0143"} | {b: chr(0x122 + b - 0x80) for b in range(0x80, 0xA1)}
SLICE_BYTES = 8_000_000


def parted(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the texts, and the number of the first one of each text (and of all).

    A byte-level tokenizer parts a text before the last blank of a run that a letter or sign follows, after it unless it
    is a space, and between a letter and a sign or blank, whatever surrounds them; what lies between is encoded by itself.
    """
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=_I)
    begins = np.concatenate([[0], ends[:-1]])
    data = np.frombuffer(joined, dtype=np.uint8)
    kind = _KIND[data]
    latin = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF, letters but for two signs
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    cut = np.zeros(len(kind) + 1, dtype=bool)
    begun = (kind[1:] == _LETTER) | (kind[1:] == _SIGN)
    cut[:-2] = (kind[:-1] >= _SPACE) & begun
    cut[ends[ends > begins] - 1] = False  # what follows is another text
    cut[1:-1] |= ((kind[:-1] == _LETTER) & (kind[1:] > _LETTER)) | ((kind[:-1] == _BREAK) & begun)
    cut[begins] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(joined)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return pieces, np.searchsorted(starts, np.append(begins, len(joined)))


class TextEncoder:
    """The ids that a tokenizer of the tokenizers library gives whole texts.

    Where it is a plain byte-level one, each distinct piece of the texts is encoded once and kept; texts that hold an
    added token, and texts for any other tokenizer, are encoded as they are.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        splits = made["pre_tokenizer"] or {}
        self.by_piece = (
            splits.get("type") == "ByteLevel"
            and splits.get("use_regex", True)
            and not splits.get("add_prefix_space", True)
            and not (made["normalizer"] or made["truncation"] or made["padding"] or made["model"].get("dropout"))
        )
        self.added = [t["content"].encode() for t in made["added_tokens"]]
        line = self.whole(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        made |= {"added_tokens": [], "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}}
        self.of_letters = Tokenizer.from_str(json.dumps(made)) if self.by_piece else None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sizes, self.ids = [np.empty(0, np.int32)], [np.empty(0, np.uint16)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype=_I) for one in found]

    def _keep(self, pieces: list[bytes]) -> None:
        """Encode new pieces. Words are parted by line ends, some to a text; those of letters are not parted further."""
        letters, words, rest = [], [], []
        for p in pieces:
            (rest if self.line is None else letters if _LETTERS(p) else words if _WORD(p) else rest).append(p)
        some = [letters[k : k + WORDS] for k in range(0, len(letters), WORDS)]
        lines = [(b"\n\x01\n".join(w) + b"\n\x01").decode("latin-1").translate(_WRITTEN) for w in some]
        found = self.of_letters.encode_batch_fast(lines, add_special_tokens=False)
        self._keep_lines([np.array(one.ids, dtype=_I) for one in found], len(letters))
        lines = [b"\n".join([*words[k : k + WORDS], b""]).decode() for k in range(0, len(words), WORDS)]
        self._keep_lines(self.whole(lines), len(words))
        others = self.whole([p.decode() for p in rest])
        self.ids.append(_checked(np.concatenate([np.empty(0, _I), *others])).astype(np.uint16))
        self.sizes.append(np.array([len(x) for x in others], dtype=np.int32))
        for p in letters + words + rest:
            self.number[p] = len(self.number)

    def _keep_lines(self, found: list[np.ndarray], n: int) -> None:
        ids = _checked(np.concatenate([np.empty(0, _I), *found]))
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != n:
            raise ValueError("the tokenizer does not part words at line ends")
        self.ids.append(ids[ids != self.line].astype(np.uint16))
        self.sizes.append((np.diff(ends, prepend=-1) - 1).astype(np.int32))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_piece:
            return [_checked(x) for x in self.whole([t.decode() for t in texts])]
        apart = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        plain = list(texts)
        for k in apart:
            plain[k] = b""
        pieces, first = parted(plain)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) + len(distinct) > PIECES:
            self._forget()
        at = [self.number.get(p, -1) for p in distinct]
        new = [k for k, number in enumerate(at) if number < 0]
        self._keep([distinct[k] for k in new])
        for k in new:
            at[k] = self.number[distinct[k]]
        self.sizes, self.ids = [np.concatenate(self.sizes)], [np.concatenate(self.ids)]
        begins = (np.cumsum(self.sizes[0], dtype=np.int32) - self.sizes[0])[at]
        sizes = self.sizes[0][at]
        piece = coded.indices.to_numpy()
        n = sizes[piece]
        ends = np.cumsum(n, dtype=np.int32)
        place = np.repeat(begins[piece] - (ends - n), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.ids[0].take(place)
        out = np.split(ids, np.append(0, ends)[first[1:-1]])
        for k, one in zip(apart, self.whole([texts[k].decode() for k in apart]), strict=True):
            out[k] = _checked(one)
        return out


def _checked(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() >= 1 << 16:
        raise ValueError("ids must be below 65,536")
    return ids


@functools.lru_cache(maxsize=1)
def text_encoder(path: str) -> TextEncoder:
    """One for all tasks of a Python worker."""
    return TextEncoder(path)


# -- writing ----------------------------------------------------------------------------------------------------------

FILE = (
    "part int, block int, n_ids int, ids_crc32 long, start long, first_doc long, doc_ids array<long>,"
    " lengths array<int>, continues boolean, ends boolean, payload binary"
)


@dataclass
class _Block:
    start: int  # ids of the part before it
    first_doc: int  # number in the part of its first document
    ids: list[np.ndarray] = field(default_factory=list)
    doc_ids: list = field(default_factory=list)
    continues: bool = False  # whether its first document began before it
    ends: bool = True  # whether its last document ends in it
    size: int = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids), self.doc_ids.append(doc_id)
        self.size += len(ids)


def _in_blocks(docs: Iterable[tuple]) -> Iterator[_Block]:
    start = number = 0
    block = _Block(0, 0)
    for doc_id, ids in docs:
        if block.size and block.size + len(ids) > BLOCK:
            yield block
            start += block.size
            block = _Block(start, number)
        while len(ids) > BLOCK:  # a longer document fills blocks of its own
            block.add(doc_id, ids[:BLOCK])
            block.ends, ids = False, ids[BLOCK:]
            yield block
            start += block.size
            block = _Block(start, number, continues=True)
        block.add(doc_id, ids)
        number += 1
    if block.size:
        yield block


def _encoded(batches: Iterable[pa.RecordBatch], tokenizer: str) -> Iterator[tuple]:
    encoder = text_encoder(tokenizer)
    for batch, texts in slices(batches, size=SLICE_BYTES):
        found = encoder.encode(texts)
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
            yield doc_id, np.append(ids, ids.dtype.type(END_ID))


def _coded(batches: Iterable[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    part, number, held = TaskContext.get().partitionId(), 0, []

    def coded() -> pa.RecordBatch:
        ids = [np.concatenate(b.ids) for b in held]
        columns = {
            "part": pa.array([part] * len(held), pa.int32()),
            "block": pa.array(range(number, number + len(held)), pa.int32()),
            "n_ids": pa.array([b.size for b in held], pa.int32()),
            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            "start": pa.array([b.start for b in held], pa.int64()),
            "first_doc": pa.array([b.first_doc for b in held], pa.int64()),
            "doc_ids": pa.array([b.doc_ids for b in held], pa.list_(pa.int64())),
            "lengths": pa.array([[len(x) for x in b.ids] for b in held], pa.list_(pa.int32())),
            "continues": pa.array([b.continues for b in held]),
            "ends": pa.array([b.ends for b in held]),
            "payload": pa.array(encode_blocks(ids), pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for block in _in_blocks(_encoded(batches, tokenizer)):
        held.append(block)
        if len(held) == TOGETHER:
            yield coded()
            number, held = number + len(held), []
    if held:
        yield coded()


def write_token_file(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of all documents; ``tokenizer`` is a file that the tokenizers library reads."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")))
    ordered.mapInArrow(lambda it: _coded(it, tokenizer), FILE).write.parquet(path)


# -- reading ----------------------------------------------------------------------------------------------------------

DECODED = "part int, doc long, doc_id long, block int, start long, n long, crc long, ids binary"


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(begin, TOGETHER).to_pylist()
            ids = decode_blocks([r["payload"] for r in rows], [r["n_ids"] for r in rows])
            out = []
            for row, block in zip(rows, ids, strict=True):
                data = block.astype("<u4")
                if zlib.crc32(data.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                at, last = 0, len(row["lengths"]) - 1
                for k, (doc_id, n) in enumerate(zip(row["doc_ids"], row["lengths"], strict=True)):
                    whole = (k < last or row["ends"]) and not (k == 0 and row["continues"])
                    one = data[at : at + n].tobytes()
                    place = row["part"], row["first_doc"] + k, doc_id, row["block"], row["start"] + at
                    out.append((*place, n, zlib.crc32(one) if whole else None, None if whole else one))
                    at += n
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [c.split()[0] for c in DECODED.split(", ")]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the file."""
    blocks = spark.read.schema(FILE).parquet(path)
    found = blocks.mapInArrow(_decoded, DECODED)
    # Blocks are decoded once: all rows go to their document, and pieces of the same one are put together there.
    joined = F.expr("crc32(listagg(ids) WITHIN GROUP (ORDER BY block))")
    documents = found.groupBy("part", "doc").agg(
        F.max("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.sum("n").alias("n"),
        F.coalesce(F.max("crc"), joined).alias("crc"),
    )
    parts = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row per part
    return documents.join(F.broadcast(parts), "part").select(
        "doc_id",
        (F.col("start") + F.col("_before")).alias("start"),
        F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )
