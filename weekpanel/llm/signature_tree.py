"""Signature trees over sets of hashed words: nodes hold the OR of their members' bitmaps and a range of sizes.

A member is a set with its size and a bitmap of ``BITS`` bits, in which each element sets one bit. The elements that
two sets share set bits that both bitmaps have, and at most ``size - bits set`` elements of a set hide behind a bit
that another one has set already. So no pair under two nodes can share more than
``bits in both + the smaller of the nodes' largest numbers of hidden elements``, nor more than the smaller of their
largest sizes, while a link at a similarity of 3/4 needs 3/7 of the sizes' sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 1024
LEAF = 32
#: A similarity of 3 / 4 is an overlap of at least 3 / 7 of the two sizes' sum.
PART, OF = 3, 7


def bitmaps(elements: list[np.ndarray]) -> np.ndarray:
    """One row of packed bits per set."""
    bits = np.zeros((len(elements), BITS), dtype=bool)
    counts = [len(x) for x in elements]
    if sum(counts):
        where = (np.concatenate(elements) & np.uint64(BITS - 1)).astype(np.int64)
        bits[np.repeat(np.arange(len(elements)), counts), where] = True
    return np.packbits(bits, axis=1)


@dataclass
class Nodes:
    """Nodes of one level, or members: OR of bitmaps, least and largest size, most hidden elements, least and
    largest group. A pair of one and the same group needs no look."""

    bits: np.ndarray
    small: np.ndarray
    large: np.ndarray
    hidden: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.small)

    def take(self, at: np.ndarray) -> Nodes:
        return Nodes(*(getattr(self, f)[at] for f in ("bits", "small", "large", "hidden", "low", "high")))

    def parents(self) -> Nodes:
        """The level above: ``LEAF`` neighbours each."""
        cuts = np.arange(0, len(self), LEAF)
        return Nodes(
            np.bitwise_or.reduceat(self.bits, cuts, axis=0),
            np.minimum.reduceat(self.small, cuts),
            np.maximum.reduceat(self.large, cuts),
            np.maximum.reduceat(self.hidden, cuts),
            np.minimum.reduceat(self.low, cuts),
            np.maximum.reduceat(self.high, cuts),
        )


def members(bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> Nodes:
    words = np.ascontiguousarray(bits).view(np.uint64)
    sizes = sizes.astype(np.int64)
    return Nodes(words, sizes, sizes, sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64), groups, groups)


def may_link(x: Nodes, y: Nodes) -> np.ndarray:
    """For pairs of nodes at the same places: can any pair under them be a link between different groups?"""
    shared = np.bitwise_count(x.bits & y.bits).sum(axis=1, dtype=np.int64) + np.minimum(x.hidden, y.hidden)
    most = np.minimum(np.minimum(shared, x.large), y.large)
    sizes = (4 * x.large >= 3 * y.small) & (4 * y.large >= 3 * x.small)
    differ = (x.low != x.high) | (y.low != y.high) | (x.low != y.low)
    return differ & sizes & (OF * most >= PART * (x.small + y.small))


def levels(nodes: Nodes) -> list[Nodes]:
    """The tree from its members up to one level of at most ``LEAF`` nodes."""
    tree = [nodes]
    while len(tree[-1]) > LEAF:
        tree.append(tree[-1].parents())
    return tree


def dual_traversal(x: Nodes, y: Nodes | None = None, at_once: int = 200_000) -> np.ndarray:
    """Pairs (place in x, place in y) that may be links; without ``y``, pairs in x with the first before the second.

    Both trees are walked down together, level by level. A pair of nodes whose bound fails is dropped with all that
    is under it.
    """
    if not len(x) or (y is not None and not len(y)):
        return np.empty((0, 2), dtype=np.int64)
    own = y is None
    left = levels(x)
    right = left if own else levels(y)
    height = max(len(left), len(right))
    left, right = left + left[-1:] * (height - len(left)), right + right[-1:] * (height - len(right))
    i, j = np.divmod(np.arange(len(left[-1]) * len(right[-1])), len(right[-1]))
    for level in range(height - 1, -1, -1):
        a, b = left[level], right[level]
        if own:
            ordered = i <= j if level else i < j
            i, j = i[ordered], j[ordered]
        keep = [
            may_link(a.take(i[k : k + at_once]), b.take(j[k : k + at_once])) for k in range(0, len(i), at_once)
        ]
        keep = np.concatenate(keep) if keep else np.empty(0, dtype=bool)
        i, j = i[keep], j[keep]
        if level:
            i, j = _children(i, j, left[level - 1], right[level - 1], left[level], right[level])
    return np.stack([i, j], axis=1)


def _children(i, j, a_below, b_below, a, b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children; a level that stands in for a shorter tree is its own child."""
    step_a, step_b = (LEAF if len(below) > len(level) else 1 for below, level in ((a_below, a), (b_below, b)))
    da, db = np.divmod(np.arange(step_a * step_b), step_b)
    i = (i[:, None] * step_a + da).ravel()
    j = (j[:, None] * step_b + db).ravel()
    real = (i < len(a_below)) & (j < len(b_below))
    return i[real], j[real]


def nearest(nodes: Nodes, at_once: int = 64) -> np.ndarray:
    """Links to try first: (member, member) pairs, one per member at most. Of those that may be linked with it, a
    member takes the one whose bitmap is most like its own."""
    own = np.bitwise_count(nodes.bits).sum(axis=1, dtype=np.int64)
    pairs = []
    for begin in range(0, len(nodes), at_once):
        i = np.repeat(np.arange(begin, min(begin + at_once, len(nodes))), len(nodes))
        j = np.tile(np.arange(len(nodes)), len(i) // len(nodes))
        possible = may_link(nodes.take(i), nodes.take(j)) & (i != j)
        i, j = i[possible], j[possible]
        both = np.bitwise_count(nodes.bits[i] & nodes.bits[j]).sum(axis=1, dtype=np.int64)
        like = both / np.maximum(own[i] + own[j] - both, 1)
        order = np.lexsort((j, -like, i))
        i, j = i[order], j[order]
        first = np.ones(len(i), dtype=bool)
        first[1:] = i[1:] != i[:-1]
        pairs.append(np.stack([i[first], j[first]], axis=1))
    return np.concatenate(pairs) if pairs else np.empty((0, 2), dtype=np.int64)
