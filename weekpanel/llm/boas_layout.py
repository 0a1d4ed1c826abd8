"""Complete ternary trees of digests in van Emde Boas order.

A tree of some levels is cut at half its height: first comes the upper half, then, from left to right, the trees below
it, each stored the same way. Nodes that are near each other in the tree are so near each other in the bytes, at every
scale and for every cache. Where a node lies follows from its depth and its number in that depth by arithmetic alone.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np

ARITY = 3
DIGEST = 32


def size(levels: int) -> int:
    """Nodes of a complete tree."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index):
    """The place of node ``index`` (a number or an array of them) of depth ``depth`` in a tree of so many levels."""
    at = index * 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        width = ARITY ** (depth - upper)
        at = at + size(upper) + index // width * size(lower)
        index, depth, levels = index % width, depth - upper, lower
    return at


def height_for(leaves: int) -> int:
    """How often runs of three become one until one node is left."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // ARITY), height + 1
    return height


def joined(children: list[bytes]) -> bytes:
    """The digest over the children's digests as hex text, one after the other."""
    return sha256(b"".join(c.hex().encode() for c in children)).digest()


def widths(leaves: int, height: int) -> list[int]:
    """Nodes there are in each depth, when the leaves fill the lowest from the left."""
    return [-(-leaves // ARITY ** (height - depth)) for depth in range(height + 1)]


def build(leaves: list[bytes], height: int) -> bytes:
    """The aligned subtree over ``leaves``; the last run of a depth may be short, what is right of it stays empty."""
    out = bytearray(DIGEST * size(height + 1))
    row = leaves
    for depth in range(height, -1, -1):
        for at, digest in zip((address(height + 1, depth, np.arange(len(row))) * DIGEST).tolist(), row):
            out[at : at + DIGEST] = digest
        if depth:
            row = [joined(row[k : k + ARITY]) for k in range(0, len(row), ARITY)]
    return bytes(out)


def paths(nodes: bytes, leaves: int, height: int, siblings: bytes = b"", shape: bytes = b"") -> list[tuple[bytes, bytes]]:
    """Per leaf its siblings up to the root and, in two bytes a step, its place in the run and the run's length.

    ``siblings`` and ``shape`` are the steps above this subtree's own root. Steps are told from the root down, so what
    leaves have in common is looked up once.
    """
    known = [(siblings, shape)]
    for depth, width in enumerate(widths(leaves, height)):
        if depth == 0:
            continue
        places = (address(height + 1, depth, np.arange(width)) * DIGEST).tolist()
        row = [nodes[at : at + DIGEST] for at in places]
        below = []
        for k in range(width):
            first = k - k % ARITY
            run = row[first : first + ARITY]
            above = known[k // ARITY]
            others = b"".join(run[: k - first] + run[k - first + 1 :])
            below.append((others + above[0], bytes((k - first, len(run))) + above[1]))
        known = below
    return known


def folded(digest: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that ``digest`` leads to with these siblings."""
    at = 0
    for place, length in zip(shape[::2], shape[1::2]):
        run = [siblings[at + DIGEST * k : at + DIGEST * (k + 1)] for k in range(length - 1)]
        digest = joined([*run[:place], digest, *run[place:]])
        at += DIGEST * (length - 1)
    return digest
