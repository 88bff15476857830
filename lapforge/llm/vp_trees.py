"""Vantage-point trees over 64-bit fingerprints under the Hamming distance.

Two fingerprints within R bits of each other differ by at most R // 3 bits in one of three disjoint parts, so there is a
tree for each part, with the part's Hamming distance and the radius r = R // 3. A node has a vantage point v and a cut m:
fingerprints with d(v, x) <= m go left, the others right. By the triangle inequality a partner of x that lies right can
only exist if d(v, x) > m - r; such x are visitors on the right side too. So every pair within the radius meets in a leaf,
and all else is pruned. In a leaf the whole 64 bits decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PARTS = tuple(np.uint64(((1 << width) - 1) << shift) for width, shift in ((21, 0), (21, 21), (22, 42)))
BLOCK = 1024


@dataclass
class Tree:
    """Nodes of one tree: vantage point, cut, and the children; a child below zero is the leaf -child - 1."""

    mask: np.uint64
    radius: int
    points: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0


def distance(x: np.ndarray, point: int, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(point)) & mask)


def choose(x: np.ndarray, mask: np.uint64, radius: int, tries: int = 6) -> tuple[int, int] | None:
    """The vantage point and cut that leave the least work, None if no cut leaves less than there is."""
    best, work = None, 0.9 * len(x) ** 2
    for point in x[np.linspace(0, len(x) - 1, tries).astype(int)]:
        upto = np.cumsum(np.bincount(distance(x, point, mask), minlength=int(mask).bit_count() + 1))
        for m in range(len(upto) - 1):
            left = int(upto[m])
            right = len(x) - (int(upto[m - radius]) if m >= radius else 0)
            if left < len(x) and left**2 + right**2 < work:
                best, work = (int(point), m), left**2 + right**2
    return best


def grow(sample: np.ndarray, mask: np.uint64, radius: int, leaf: int) -> Tree:
    """A tree whose leaves hold at most ``leaf`` fingerprints of the sample where cuts allow it."""
    tree = Tree(mask, radius)

    def node(x: np.ndarray) -> int:
        found = choose(x, mask, radius) if len(x) > leaf else None
        if found is None:
            tree.leaves += 1
            return -tree.leaves
        at = len(tree.points)
        tree.points.append(found[0])
        tree.cuts.append(found[1])
        tree.children.append([0, 0])
        d = distance(x, found[0], mask)
        tree.children[at] = [node(x[d <= found[1]]), node(x[d > found[1] - radius])]
        return at

    tree.root = node(sample)
    return tree


def shards(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, position in x) for the home of every fingerprint and for every leaf that it visits."""
    leaves, where, todo = [], [], [(tree.root, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            leaves.append(np.full(len(rows), -at - 1))
            where.append(rows)
            continue
        d = distance(x[rows], tree.points[at], tree.mask).astype(np.int64)
        left, right = tree.children[at]
        todo += [(left, rows[d <= tree.cuts[at]]), (right, rows[d > tree.cuts[at] - tree.radius])]
    return np.concatenate(leaves), np.concatenate(where)


def linked(x: np.ndarray, mask: np.uint64, radius: int, bits: int) -> np.ndarray:
    """For each of the distinct fingerprints the first one, by position, of its component of pairs within ``bits``.

    Pairs are merged as they are found and never kept: a dense group costs comparisons, not memory.
    """
    parent = np.arange(len(x))

    def merge(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal parent
        while True:
            a, b = parent[i], parent[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up

    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        values = x[rows]
        found = choose(values, mask, radius) if len(rows) > BLOCK else None
        if found is not None:
            d = distance(values, found[0], mask).astype(np.int64)
            todo += [rows[d <= found[1]], rows[d > found[1] - radius]]
            continue
        for start in range(0, len(rows), 256):
            near = np.bitwise_count(values[start:start + 256, None] ^ values[None, start:]) <= bits
            i, j = np.nonzero(near)
            keep = j > i
            if keep.any():
                merge(rows[start + i[keep]], rows[start + j[keep]])
    return parent
