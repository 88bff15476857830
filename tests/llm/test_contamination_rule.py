"""Contamination against a count of agreeing words: no run of min(13, item) words at 80 % may be missed."""

import itertools
import random

import pytest

from lapforge.llm import decontaminate


def agrees(doc, item, least=13):
    """Whether some run of min(least, item) words agrees in 80 % along some alignment."""
    least = min(least, len(item))
    for shift in range(least - len(item), len(doc) - least + 1):
        same = [doc[i + shift] == w for i, w in enumerate(item) if 0 <= i + shift < len(doc)]
        for a in range(len(same) - least + 1):
            if any(5 * sum(same[a:b]) >= 4 * (b - a) for b in range(a + least, len(same) + 1)):
                return True
    return False


@pytest.mark.parametrize("item, length, replaced", [
    (13, 13, 2), (13, 15, 3), (13, 20, 4), (13, 25, 5), (12, 12, 2), (11, 11, 2), (10, 10, 2), (9, 9, 1), (8, 8, 1), (7, 7, 1), (6, 6, 1),
    (5, 5, 1), (4, 4, 0), (3, 3, 0), (2, 2, 0)])
def test_every_placement_has_a_seed(item, length, replaced):
    windows = [sum(1 << (i + s) for i, c in enumerate(m) if c == "1") for m in decontaminate.masks_for(item) for s in range(length - len(m) + 1)]
    for places in itertools.combinations(range(length), replaced):
        gone = sum(1 << p for p in places)
        assert any(not w & gone for w in windows), places


def test_other_rules_have_seeds_too():
    for least, similarity in ((6, 0.5), (8, 0.75), (13, 0.9)):
        for item in range(2, least + 1):
            width = len(decontaminate.masks_for(item, least, similarity)[0])
            for n in range(least, 2 * least) if item == least else [item]:
                m = int(n * (1 - similarity) + 1e-9)
                masks = decontaminate.masks_for(item, least, similarity)
                windows = [sum(1 << (i + s) for i, c in enumerate(x) if c == "1") for x in masks for s in range(n - width + 1)]
                if n <= 12:
                    assert all(any(not w & sum(1 << p for p in c) for w in windows) for c in itertools.combinations(range(n), m))


def test_replaced_words_anywhere(spark):
    rng = random.Random(7)
    items = [(n, [f"i{n}w{j}" for j in range(n)]) for n in [*range(2, 18), 20, 24, 25, 31, 40]]
    cases = [(13, (4, 6)), (8, (2,)), (8, (5,)), (10, (3, 6)), (24, (6, 8, 15, 17)), (5, (2,)), (4, (1,)), (3, ())]
    cases += [(n, tuple(rng.sample(range(n), min(n, n // 5 + k)))) for n, _ in items for k in (0, 1) for _ in range(8)]
    docs = []
    for number, (n, places) in enumerate(cases):
        words = [w if j not in places else f"other{j}" for j, w in enumerate(dict(items)[n])]
        docs.append((number, [f"before{number}"] * rng.randrange(3) + words + ["after"] * rng.randrange(3)))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(
        spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    wanted = {(d, i) for d, x in docs for i, y in items if agrees(x, y)}
    assert set(got) == wanted and {(c, cases[c][0]) for c in (0, 1, 2, 3, 4, 5, 7)} <= wanted and (6, 4) not in wanted
    for (d, i), r in got.items():
        run, item = docs[d][1][r.start_word:r.start_word + r.n_words], dict(items)[i]
        assert r.n_words >= min(13, len(item)) and r.n_agreeing == len(set(run) & set(item)) >= 0.8 * r.n_words
