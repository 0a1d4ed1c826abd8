"""Numbers that describe how a text is written, in whatever language: for classifiers over whole texts."""

from __future__ import annotations

import numpy as np

from weekpanel.llm.tokens import Words

NAMES = (
    "log_words", "upper", "digits", "symbols", "exclaim", "bars", "stops", "commas", "other_marks", "word_length",
    "word_spread", "short_words", "long_words", "mark_at_end", "repeat_1", "repeat_2", "repeat_3", "distinct",
    "log_line_words", "lines_without_stop",
)

_UPPER, _LOWER, _DIGIT, _SYMBOL, _EXCLAIM, _BAR, _STOP, _COMMA, _OTHER, _SPACE = range(10)
_CLASS = np.full(256, _LOWER, dtype=np.uint8)
_CLASS[:128] = _OTHER
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
for _mark, _kind in ((b"#$%&*@^~<>={}[]\\_+", _SYMBOL), (b"!", _EXCLAIM), (b"|", _BAR), (b".?", _STOP), (b",;:", _COMMA)):
    _CLASS[list(_mark)] = _kind


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values from first[i] to first[i + 1]."""
    if values.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(values), first)).astype(np.float64)
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return upto[first[1:]] - upto[first[:-1]]


def style(texts: list[bytes], words: Words | None = None) -> np.ndarray:
    """One row per text, one column per name in ``NAMES``; zeros for a text without words. ``words``: those of the texts."""
    out = np.zeros((len(texts), len(NAMES)))
    if not texts:
        return out
    words = Words(texts) if words is None else words
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = _CLASS[buffer]
    # Capital Latin letters beyond ASCII: the second byte of a pair that begins with 0xC3.
    kind[1:][(buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E)] = _UPPER
    starts = words.text_starts
    count = [_sums(kind == k, starts) for k in range(10)]
    n = np.diff(words.first).astype(np.float64)
    some = np.maximum(n, 1)
    letters = np.maximum(count[_UPPER] + count[_LOWER], 1)
    length = (words.ends - words.starts).astype(np.float64)
    mean = _sums(length, words.first) / some
    spread = np.sqrt(np.maximum(_sums(length**2, words.first) / some - mean**2, 0))
    last = kind[words.ends - 1] if len(words.ends) else np.empty(0, np.uint8)
    h = words.hashes
    of = np.repeat(np.arange(len(texts)), np.diff(words.first))

    def repeats(lag: int) -> np.ndarray:
        same = np.zeros(len(h))
        same[lag:] = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
        return _sums(same, words.first) / some

    kinds = np.array([len(np.unique(h[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    newline = buffer == 10
    lines = np.maximum(_sums(newline, starts), 1)
    before = np.concatenate(([_STOP], kind[:-1]))
    bare = _sums(newline & (before != _STOP), starts)
    columns = [
        np.log1p(n),
        count[_UPPER] / letters,
        np.sqrt(count[_DIGIT] / letters),
        np.sqrt(np.minimum(count[_SYMBOL] / some, 4)),
        np.sqrt(np.minimum(count[_EXCLAIM] / some, 4)),
        np.sqrt(np.minimum(count[_BAR] / some, 4)),
        np.sqrt(np.minimum(count[_STOP] / some, 4)),
        np.sqrt(np.minimum(count[_COMMA] / some, 4)),
        np.sqrt(np.minimum(count[_OTHER] / some, 4)),
        np.minimum(mean, 40) / 10,
        np.minimum(spread, 40) / 10,
        _sums(length <= 3, words.first) / some,
        _sums(length >= 14, words.first) / some,
        _sums(np.isin(last, (_SYMBOL, _EXCLAIM, _BAR)), words.first) / some,
        repeats(1),
        repeats(2),
        repeats(3),
        kinds / some,
        np.log1p(n / lines),
        bare / lines,
    ]
    out[:] = np.stack(columns, axis=1)
    out[n == 0] = 0
    return out
