import numpy as np
import pytest

from lapforge.operators import split_search

SCHEMA = "gp string, a double, b double, y double"


def frame(seed=5, n=240):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, gp = float(draw.integers(0, 9)), float(draw.normal()), "ABC"[draw.integers(0, 3)]
        rows.append((gp, None if draw.random() < 0.1 else a, b, None if draw.random() < 0.05 else a * (gp == "A") + (b > 0.3) + draw.normal()))
    return rows + [("one", 1.0, 1.0, 2.0), ("same", 3.0, 1.0, 1.0), ("same", 3.0, 2.0, 5.0), (None, 1.0, 2.0, 3.0), (None, 2.0, 2.0, 9.0)]


def plain(rows, at, group, factor=1.0):
    """(threshold, gain) by trying every value."""
    pairs = [(r[at], r[3]) for r in rows if r[0] == group and r[at] is not None and r[3] is not None]
    best = None
    for t in sorted({x for x, _ in pairs})[:-1]:
        left, right = [y for x, y in pairs if x <= t], [y for x, y in pairs if x > t]
        gain = factor * (np.var([y for _, y in pairs]) - (len(left) * np.var(left) + len(right) * np.var(right)) / len(pairs))
        if best is None or gain > best[1] + 1e-12:
            best = t, gain
    return best


@pytest.mark.parametrize("bound", [4_000_000, 7])
def test_thresholds_equal_a_search_of_all(spark, bound):
    rows = frame()
    got = split_search.best_thresholds(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "y", group="gp", rows=bound).collect()
    expected = {(g, f): plain(rows, 1 + "ab".index(f), g) for g in {r[0] for r in rows} - {None} for f in "ab"}
    assert {(r.gp, r.feature) for r in got} == {k for k, v in expected.items() if v}
    for r in got:
        assert (r.threshold, r.gain) == (expected[r.gp, r.feature][0], pytest.approx(expected[r.gp, r.feature][1], abs=1e-9))


def test_gini_of_a_rule_and_the_best_feature(spark):
    rows = [(None, float(x), float(x % 3), float(x > 20)) for x in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    best = split_search.best_split(split_search.best_thresholds(df, ["b", "a"], "y", gini=True)).first()
    share = 39 / 60
    assert (best.feature, best.threshold, best.n_left, best.n_right, best.left_mean, best.right_mean) == ("a", 20.0, 21, 39, 0.0, 1.0)
    assert best.gain == pytest.approx(2 * share * (1 - share))
    assert split_search.best_thresholds(df.limit(0), ["a"], "y").count() == 0
