"""Cases that once came out wrong: heavy groups in the k-d tree, words of equal hash in substring dedup."""

import itertools
import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT]

from lapforge.llm import common, sharding, substrings  # noqa: E402


def heavy_texts(seed):
    """Eight groups of equal texts with a tenth of the bytes each, and single texts with a fifth."""
    draw = random.Random(seed)
    texts = []
    for _ in range(8):
        text = "".join(draw.choices("abcdé \n", k=draw.choice((499, 999, 1999))))
        texts += [text] * (200_000 // (len(text.encode()) + 1))
    size = sum(len(t.encode()) + 1 for t in texts)
    while size < 2_000_000:
        texts.append("".join(draw.choices("abcdé \n", k=draw.randint(10, 3_000))))
        size += len(texts[-1].encode()) + 1
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shards_are_even_under_heavy_groups(spark, seed):
    texts = heavy_texts(seed)
    rows = sharding.documents_by_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sizes, shards_of = [0] * 8, {}
    for r in rows:
        sizes[r.shard] += r.size
        shards_of.setdefault(texts[r.doc_id], set()).add(r.shard)
    share = sum(sizes) / 8
    assert len(rows) == len(texts) and max(sizes) <= 1.02 * share and min(sizes) >= 0.98 * share, [s / share for s in sizes]
    assert all(len(found) == 1 for found in shards_of.values())
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


@pytest.mark.parametrize("seed", range(20))
def test_heavy_groups_are_dealt_as_well_as_can_be(seed):
    draw = random.Random(seed)
    groups = [((draw.randrange(50),), i, draw.randint(1, 30)) for i in range(draw.randint(0, 9))]
    light, goal_share = draw.randint(0, 60), draw.choice((1 / 2, 1 / 3))
    goal = (light + sum(w for *_, w in groups)) * goal_share
    left, right, lacking = sharding._dealt(groups, 0, goal, light)
    weight = {sharding._atom(o, g, 0): w for o, g, w in groups}
    assert sorted(left + right) == sorted(weight) and lacking == pytest.approx(goal - sum(weight[a] for a in left))
    missed = max(0, -lacking, lacking - light)
    least = min(max(0, -(goal - sum(c)), goal - sum(c) - light) for n in range(len(weight) + 1) for c in itertools.combinations(weight.values(), n))
    assert missed <= least + max(weight.values(), default=0) / 2


def same_hash_words():
    """Two words whose polynomial hashes modulo 2^64 agree, whatever the base: Thue-Morse strings of 1,024 letters."""
    bits = [bin(i).count("1") % 2 for i in range(1_024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_hash_are_no_repeat(spark):
    import numpy as np

    one, other = same_hash_words()
    buf = np.frombuffer(f"\n{one}\n{other}\n".encode(), np.uint8)
    hashes = common.span_hashes(buf, *common.word_bounds(buf, common.ASCII_SPACE))
    assert hashes[0] == hashes[1]  # else this test shows nothing
    words = [f"w{i}" for i in range(41)]
    texts = [" ".join([*words[:20], w, *words[21:]]) for w in (one, other)]
    for copies in (1, 2):
        rows = [(i, t) for i, t in enumerate(texts * copies)]
        got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.n_removed for r in got} == {0 if copies == 1 else 41}


def test_regions_ignore_the_kind_of_space(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, "\n ".join(words)), (2, "x " + "\t".join(words[:40]) + " y")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 60, 1: 60, 2: 40}
