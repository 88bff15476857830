"""Share of near copies that the pipeline's stage finds as candidates, and op7 links, by Jaccard similarity of 5-word shingles.

python tests/llm/near_recall.py [SF_DIR]: pairs made by replacing words of random texts, and the pairs in a table's documents.
"""

from __future__ import annotations

import os
import sys
from collections import Counter, defaultdict

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from lapforge.llm import near_copies, vp_trees  # noqa: E402
from lapforge.llm.simhash import fingerprint  # noqa: E402

BANDS = ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 0.98), (0.98, 1.01))


def shingles(text: bytes) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(x: bytes, y: bytes) -> tuple[bool, bool]:
    """Whether the pair is a candidate of the pipeline's stage, and whether op7 links it."""
    pair = np.array([np.frombuffer(near_copies.wide_fingerprint(t), np.uint64) for t in (x, y)])
    parts = [(w, mask) for w in range(near_copies.WORDS) for mask in vp_trees.PARTS]
    found = (pair[0] == pair[1]).all() or any(len(near_copies.forest(pair, *part)[0]) for part in parts)
    return bool(found), (fingerprint(x) ^ fingerprint(y)).bit_count() <= 4


def report(name: str, pairs: list[tuple[float, tuple[bool, bool]]]) -> None:
    for low, high in BANDS:
        held = [ok for jaccard, ok in pairs if low <= jaccard < high]
        print(f"{name}, Jaccard {low:g} to {min(high, 1):g}: of {len(held)} pairs {sum(s for s, _ in held)} found by the stage, {sum(o for _, o in held)} by op7")


def made(pairs: int = 3000, words: int = 304) -> list[tuple[float, tuple[bool, bool]]]:
    rng, out = np.random.default_rng(11), []
    for _ in range(pairs):
        one = [b"w%d" % v for v in rng.integers(0, 50000, words)]
        two = list(one)
        for at in rng.choice(words, rng.integers(1, 9), replace=False):
            two[at] = b"other%d" % rng.integers(0, 50000)
        x, y = b" ".join(one), b" ".join(two)
        a, b = shingles(x), shingles(y)
        out.append((len(a & b) / len(a | b), linked(x, y)))
    return out


def found(sf_dir: str) -> list[tuple[float, tuple[bool, bool]]]:
    """All pairs of different texts; for small tables."""
    import pyarrow.parquet as pq

    texts = sorted({(t or "").encode() for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()})
    sets, where, shared = [shingles(t) for t in texts], defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for held in where.values():
        shared.update((a, b) for k, a in enumerate(held) for b in held[k + 1:])
    return [(j, linked(texts[a], texts[b])) for (a, b), n in shared.items() if (j := n / (len(sets[a]) + len(sets[b]) - n)) >= 0.8]


if __name__ == "__main__":
    report("made", made())
    for folder in sys.argv[1:]:
        report(folder, found(folder))
