"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts become a few dozen surface features inside the tasks. The model is fitted on the driver by cyclic boosting on
a bounded sample of labelled rows: round by round every feature gets one shallow tree on what the others leave over, and
the trees of a feature add up to one lookup table over its bins. Then the pairs of features with the strongest
interaction get tables over two features in the same way. A score is the logistic function of the sum of one entry of
each table, looked up for all rows of a batch at once.

Labels are used of rows only whose crc32 of the id as text, modulo 3, isn't 1. At most ``max_rows`` of them are used for
the fit, those with the smallest hash of id and features. Neither labels nor lang, source or id are inputs of a score.

Null text counts as empty and gets a score like any text. A null label is no label; labels that repeat or contradict each
other count once each; labels other than 0 count as 1. Without labels, or with labels of one kind only, every score is the
smoothed share of ones. A null id counts as an empty one for the fold and finds no labels. Extra columns are kept, those
named like a new one replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm.common import bounded_sample, side_table, table, with_text_columns
from lapforge.llm.registry import register

FEATURES = (
    "bytes", "words", "upper", "digits", "symbols", "exclamations", "bars", "non_ascii", "spaces", "lines", "word_bytes",
    "distinct_words", "repeated_neighbours", "sentence_ends", "capitalised", "distinct_lines", "single_byte_words",
)
MAX_ROWS = 50_000


def _byte_class(chars: str) -> np.ndarray:
    flags = np.zeros(256)
    flags[list(chars.encode())] = 1
    return flags


_CLASSES = np.stack([
    _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_class("0123456789"), _byte_class("#$%&*+/<=>@\\^_`{}~[]()"),
    _byte_class("!"), _byte_class("|"), np.arange(256) >= 128, _byte_class(" \t"), _byte_class("\n"), _byte_class(".?!"),
    _byte_class("abcdefghijklmnopqrstuvwxyz"),
]).astype(np.float64)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) if texts else np.zeros((0, 256))
    upper, digits, symbols, calls, bars, high, spaces, lines, ends, lower = (counts @ _CLASSES.T).T
    size = counts.sum(1)
    n, distinct, repeats, capital, unlike, single = (np.zeros(len(texts)) for _ in range(6))
    for i, text in enumerate(texts):
        words = text.split()
        n[i], distinct[i] = len(words), len(set(words))
        repeats[i] = sum(map(eq, words, words[1:]))
        capital[i] = sum(map(bytes.istitle, words))
        single[i] = sum(1 for w in words if len(w) == 1)
        split = text.split(b"\n")
        unlike[i] = len(set(split)) / len(split)
    some, word = np.maximum(size, 1), np.maximum(n, 1)
    letters = np.maximum(upper + lower, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n), upper / letters, digits / some, symbols / some, calls / some, bars / some, high / some,
        spaces / some, lines / some, (size - spaces - lines) / word, distinct / word, repeats / word, ends / word,
        capital / word, unlike, single / word,
    ])


@dataclass
class Additive:
    """Bin edges of each feature, a table for each feature, tables for pairs, and the constant."""

    edges: list[np.ndarray]
    single: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for j, (edges, values) in enumerate(zip(self.edges, self.single)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, values in self.pairs:
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> int:
    """The best place to split ordered bins in two, 0 if none is better than no split."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1)
    best = int(gain.argmax()) if len(gain) else 0
    return best + 1 if len(gain) and gain[best] > g.sum() ** 2 / (h.sum() + 1) + 1e-12 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 2.0) -> np.ndarray:
    """A tree of the given depth over ordered bins, as a value for each bin."""
    cut = _cut(g, h, least) if depth else 0
    if not cut:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, least), _tree(g[cut:], h[cut:], depth - 1, least)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> tuple[np.ndarray, float]:
    """Split one axis, then the other axis on each side; the values of all cells and the gain."""
    best, gain = np.full(g.shape, _leaf(g, h)), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            out, sides = np.empty(a.shape), 0.0
            for part in (slice(None, cut), slice(cut, None)):
                row_g, row_h = a[part].sum(0), b[part].sum(0)
                values = _tree(row_g, row_h, 1, least)
                out[part] = values
                sides += float((values * row_g).sum())
            if sides > gain:
                best, gain = (out.T if turned else out), sides
    return best.copy(), gain


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 30, pairs: int = 6,
        rate: float = 0.15) -> Additive:
    """Cyclic boosting of the tables. With one kind of label only, a constant."""
    edges, coarse = ([_edges(x[:, j], k) if len(x) else np.zeros(0) for j in range(x.shape[1])] for k in (bins, coarse_bins))
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    total = np.full(len(y), model.constant)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, where in enumerate(fine):
            g, h = slopes()
            k = len(model.single[j])
            step = rate * _tree(np.bincount(where, g, k), np.bincount(where, h, k))
            model.single[j] += step
            total += step[where]
    shapes = [len(e) + 1 for e in coarse]
    cell = lambda a, b: wide[a] * shapes[b] + wide[b]

    def sums(a, b, g, h):
        k = shapes[a] * shapes[b]
        return (np.bincount(cell(a, b), v, k).reshape(shapes[a], shapes[b]) for v in (g, h))

    g, h = slopes()
    ranked = sorted(((_pair_tree(*sums(a, b, g, h))[1], a, b) for a in range(len(edges)) for b in range(a)), reverse=True)[:pairs]
    model.pairs = [(a, b, np.zeros((shapes[a], shapes[b]))) for _, a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            step = rate * _pair_tree(*sums(a, b, *slopes()))[0]
            values += step
            total += step.ravel()[cell(a, b)]
    return model


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def with_features(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    return with_text_columns(df, text, "features array<double>", lambda: lambda texts: [_rows(features(texts))],
                             () if keep_text else (text,))


def fit_on(described: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Additive:
    """Fit on described rows (key, features) that have a label and aren't held out, at most ``max_rows``."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) != 0).cast("double").alias("_y"))
    rows = described.where(~held_out(key)).join(marked, F.col(key) == F.col("_key")).select("_key", "features", "_y")
    sample = bounded_sample(rows, ["_key", "features", "_y"], max_rows, rows.count()).select("features", "_y").toArrow()
    y = sample.column("_y").to_numpy()
    x = sample.column("features").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    return fit(x, y)


def quality_scores(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Without the text: the rows of ``df`` with held_out, score and predicted."""
    described = side_table(with_features(df, text), "quality-features")
    model = df.sparkSession.sparkContext.broadcast(fit_on(described.select(key, "features"), labels, key))
    kept = [c for c in described.columns if c not in ("features", "score")]
    schema = described.select(*kept).schema.add("score", "double")

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.value.scores(x))], names=schema.fieldNames())

    return described.mapInArrow(run, schema).withColumn("held_out", held_out(key)).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, with the columns of ``df``."""
    described = side_table(with_features(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text"), "quality-features")
    model = df.sparkSession.sparkContext.broadcast(fit_on(described, labels.withColumnRenamed(key, "key"), "key"))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    scored = with_text_columns(whole, ("row", text), "score double", lambda: lambda texts: [pa.array(model.value.scores(features(texts)))])
    return scored.where(F.col("score") >= least).select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels"))
