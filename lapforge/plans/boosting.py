"""Gradient-boosted trees for searches: hundreds of trees for each of many candidates.

Spark's own booster starts some fifteen stages for a tree, 0.2 s however few the rows; a search of sixty candidates grows 27,000 trees.
Here features become bins of 32 quantiles (one byte each), and rows are kept in blocks. Up to TASK_ROWS rows a model is one task
that holds some seventy bytes a row. More rows are dealt to tasks, and the same steps run as jobs: one for each level of a tree, whose
histograms are added up in the driver (an array of nodes, features and bins from each task), and one that writes what a tree leaves over.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge import constants as K
from lapforge.session import fresh_path, remove, written_table

#: Rows of a task, and of a block that passes through a histogram at a time.
TASK_ROWS, BLOCK_ROWS = 250_000, 20_000
BINS = 32
_TREE = "tree int, feature array<int>, threshold array<double>, child array<int>, value array<double>"


def _descend(x: np.ndarray, feature, cut, child) -> np.ndarray:
    """The node that each row of bins has come to."""
    at, each = np.zeros(len(x), np.int64), np.arange(len(x))
    while (inner := child[at] >= 0).any():
        at = np.where(inner, child[at] + (x[each, feature[at]] > cut[at]), at)
    return at


def _histogram(blocks, t: int, chosen: np.ndarray, tree: tuple, level: np.ndarray, subsample: float) -> np.ndarray:
    """Weighted residuals and weights by node of the level, feature and bin. The rows of a tree are drawn by its number and the block's."""
    feature, cut, child, _ = tree
    size, columns = BINS + 1, len(chosen)
    slot = np.full(len(feature), -1)
    slot[level] = np.arange(len(level))
    sums = np.zeros((2, len(level), columns, size))
    for block, x, w, r in blocks:
        drawn = w * (np.random.default_rng([K.SPLIT_SEED, t, block]).random(len(w)) < subsample)
        here = slot[_descend(x, feature, cut, child)]
        live = np.flatnonzero((here >= 0) & (drawn > 0))
        cells = (x[np.ix_(live, chosen)] + np.arange(columns) * size + here[live, None] * (columns * size)).ravel()
        for k, v in enumerate((drawn * r, drawn)):
            sums[k] += np.bincount(cells, np.repeat(v[live], columns), sums[k].size).reshape(sums[k].shape)
    return sums


def _grow(start: float, edges: list[np.ndarray], p: Mapping, histogram: Callable, finish: Callable) -> Iterator[tuple]:
    """Yields the trees: squared error, shrunken leaves, level by level. ``histogram`` adds up the rows, ``finish`` takes a tree off them."""
    width, size = len(edges), BINS + 1
    yield 0, [-1], [0.0], [-1], [start]
    columns = max(1, math.ceil(p["colsample"] * width))
    least, deepest = max(float(p["min_child_weight"]), 1e-12), int(p["max_depth"])
    for t in range(1, int(p["n_estimators"]) + 1):
        chosen = np.sort(np.random.default_rng([K.SPLIT_SEED, t]).permutation(width)[:columns])
        feature, threshold, cut, child, value = [-1], [0.0], [0], [-1], [0.0]
        level = [0]
        for depth in range(deepest):
            tree = tuple(map(np.array, (feature, cut, child, value)))
            g, h = histogram(t, chosen, tree, np.array(level), p["subsample"]).cumsum(axis=3)
            g_all, h_all = g[:, 0, -1], h[:, 0, -1]
            means = np.divide(g_all, h_all, out=np.zeros(len(level)), where=h_all > 0)
            if not depth:
                value[0] = float(p["learning_rate"] * means[0])
            gl, hl = g[:, :, :-1], h[:, :, :-1]
            gr, hr = g_all[:, None, None] - gl, h_all[:, None, None] - hl
            fits = (hl >= least) & (hr >= least)
            gain = np.divide(gl * gl, hl, out=np.full(gl.shape, -1.0), where=fits)
            gain += np.divide(gr * gr, hr, out=np.zeros(gl.shape), where=fits)
            gain, gl, hl, gr, hr = (v.reshape(len(level), -1) for v in (gain, gl, hl, gr, hr))
            best = gain.argmax(axis=1)
            below = []
            for i in np.flatnonzero(gain[np.arange(len(level)), best] - g_all * means > 1e-9):
                n, (f, b) = level[i], divmod(int(best[i]), size - 1)
                f = int(chosen[f])
                feature[n], threshold[n], cut[n], child[n] = f, float(edges[f][b]), b, len(feature)
                for g_side, h_side in ((gl[i, best[i]], hl[i, best[i]]), (gr[i, best[i]], hr[i, best[i]])):
                    if h_side >= 2 * least:
                        below.append(len(feature))
                    for column, empty in ((feature, -1), (threshold, 0.0), (cut, 0), (child, -1), (value, float(p["learning_rate"] * g_side / h_side))):
                        column.append(empty)
            if not below:
                break
            level = below
        finish(tuple(map(np.array, (feature, cut, child, value))))
        yield t, feature, threshold, child, value


def _opened(frame: pd.DataFrame, width: int) -> list[tuple]:
    """The blocks of a batch: (number, bins, weight, residual)."""
    return [(int(b.block), np.frombuffer(b.x, np.uint8).reshape(-1, width), np.frombuffer(b.w), np.frombuffer(b.r)) for b in frame.itertuples()]


def _grown_in_a_task(blocks: DataFrame, start: float, edges: list[np.ndarray], p: Mapping) -> list[tuple]:
    def grown(batches):
        held = sorted((b for batch in batches for b in _opened(batch, len(edges))), key=lambda b: b[0])
        held = [(block, x, w, r.copy()) for block, x, w, r in held]

        def finish(tree):
            for _, x, _, r in held:
                r -= tree[3][_descend(x, *tree[:3])]

        for tree in _grow(start, edges, p, lambda *at: _histogram(held, *at), finish):
            yield pd.DataFrame([tree], columns=["tree", "feature", "threshold", "child", "value"])

    return sorted((tuple(r) for r in blocks.coalesce(1).mapInPandas(grown, _TREE).collect()), key=lambda t: t[0])


def _grown_over_tasks(blocks: DataFrame, start: float, edges: list[np.ndarray], p: Mapping) -> list[tuple]:
    spark, width, state = blocks.sparkSession, len(edges), [blocks, None]

    def histogram(*at):
        def added(batches):
            for batch in batches:
                yield pd.DataFrame({"sums": [_histogram(_opened(batch, width), *at).tobytes()]})

        shape = (2, len(at[3]), len(at[1]), BINS + 1)
        return sum(np.frombuffer(r.sums).reshape(shape) for r in state[0].mapInPandas(added, "sums binary").collect())

    def finish(tree):
        def rest(batches):
            for batch in batches:
                batch["r"] = [(r - tree[3][_descend(x, *tree[:3])]).tobytes() for _, x, _, r in _opened(batch, width)]
                yield batch

        path = fresh_path(spark, "boosted")
        state[0].mapInPandas(rest, blocks.schema).write.parquet(path)
        if state[1]:
            remove(spark, state[1])
        state[:] = spark.read.schema(blocks.schema).parquet(path), path

    trees = list(_grow(start, edges, p, histogram, finish))
    if state[1]:
        remove(spark, state[1])
    return trees


class SearchBooster(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol):
    """Trees by the parameters that ``training.draw_params`` draws. ``subsample`` draws rows and ``colsample`` features for each tree;
    ``min_child_weight`` bounds the weight of a leaf. Fitting starts Spark jobs and writes the binned rows."""

    def __init__(self, params: Mapping, *, label: str = K.TARGET, weight: str | None = None):
        super().__init__()
        self.settings = {**K.BOOSTER, "min_child_weight": 1, **params}
        self._set(featuresCol="features", labelCol=label, predictionCol="prediction", **({"weightCol": weight} if weight else {}))

    def _fit(self, dataset: DataFrame) -> SearchBoosterModel:
        spark, settings = dataset.sparkSession, self.settings
        weight = F.col(self.getWeightCol()) if self.isDefined("weightCol") else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"),
                              weight.cast("double").alias("w"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to fit on")
        width, shares = first[0], [i / BINS for i in range(BINS)]
        start = F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w"))
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(start, F.lit(0.0)).alias("start"), *[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"q{i}") for i in range(width)]).first()
        edges = [np.unique(np.array(found[f"q{i}"] or [0.0], float)) for i in range(width)]

        start = found["start"]

        def binned(batches):
            for batch in batches:
                for at in range(0, len(batch), BLOCK_ROWS):
                    part = batch.iloc[at:at + BLOCK_ROWS]
                    x = np.stack(part["x"].to_numpy())
                    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                    yield pd.DataFrame({"x": [bins.tobytes()], "w": [part["w"].to_numpy(float).tobytes()], "r": [(part["y"].to_numpy(float) - start).tobytes()]})

        numbered = rows.mapInPandas(binned, "x binary, w binary, r binary").withColumn("block", F.monotonically_increasing_id())
        blocks = written_table(numbered, "blocks")
        grow = _grown_in_a_task if found["n"] <= TASK_ROWS else _grown_over_tasks
        trees = grow(blocks, start, edges, settings)
        return self._copyValues(SearchBoosterModel([tuple(map(np.array, t[1:])) for t in trees]))


class SearchBoosterModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol):
    """The trees: for each node its feature (-1 in a leaf), threshold, left child (the right one follows) and value."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            out, each = np.zeros(len(rows)), np.arange(len(rows))
            for feature, threshold, child, value in trees:
                at = np.zeros(len(rows), np.int64)
                while (inner := feature[at] >= 0).any():
                    right = ~(rows[each, feature[at]] <= threshold[at])
                    at = np.where(inner, child[at] + right, at)
                out += value[at]
            return pd.Series(out)

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))
