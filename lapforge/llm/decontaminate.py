"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into words of letters and digits (ASCII punctuation and space separate). A seed is a window
of words under a mask: positions with a 0 don't count, so a hash survives substituted words there. Hashes of benchmark
items and of documents are joined, and every place where they meet is verified: along the alignment that the hit gives,
some run of words must agree in at least ``similarity`` of its places over ``least`` words, or over the whole item if that
is shorter.

The masks leave no such run without a seed. A run of 26 words or more has a half of at least 13 that agrees as well, and
runs of 14 to 25 words hold one of 13, 15, 20 or 25 with 2, 3, 4 or 5 replaced words; LONG and SHORT were chosen by
enumerating all placements of these (the tests repeat that). Documents are hashed under the masks that the lengths of the
benchmark's items ask for.

A bit filter of a fixed size, FILTER_BITS, made from the hashes of the benchmark, is broadcast, and only document hashes
that it lets pass are shuffled; the join decides. Should a benchmark outgrow the filter, more hashes are shuffled, and the
result is the same. A hash that a large share of the documents has is spread by a salted join.

Null text counts as empty. Items of one word are no run of words and are passed over, and null items too. Repeated rows are reported once each, repeated items too. Empty tables give an empty report.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm.common import chunks, mixed, salted_join, side_table, span_hashes, table, texts_of, word_bounds
from lapforge.llm.registry import register

#: Masks for 13 words and 80 %: 1 counts, 0 is ignored. Weight 6; for items of 13 words or more, and of fewer by their length.
LONG = ("11010111", "11100010011", "1001101011", "111111")
SHORT = {
    12: ("11101011", "101100111", "111111"),
    11: ("1110111", "110100111", "1111101", "111111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    9: ("1111011", "1101111"),
    8: ("111111", "1111011", "1101111"),
}
FILTER_BITS = 1 << 26
_SHIFTS = (0, 13, 26, 38)

_BETWEEN_WORDS = np.ones(256, bool)
_BETWEEN_WORDS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", *range(128, 256)]] = False


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of the first word of each text."""
    low = [t.decode().lower().encode() for t in texts]
    buf = np.frombuffer(b" " + b" ".join(low) + b" ", np.uint8)
    starts, ends = word_bounds(buf, _BETWEEN_WORDS)
    offsets = np.cumsum([1] + [len(t) + 1 for t in low])[:-1]
    return span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def masks_for(length: int, least: int = 13, similarity: float = 0.8) -> tuple[str, ...]:
    """Masks of which one at least hits any run of min(least, length) words or more that agrees in ``similarity``."""
    if length >= 8 and (least, similarity) == (13, 0.8):
        return SHORT.get(length, LONG)
    runs = range(least, 2 * least) if length >= least else [length]
    replaced = [int(n * (1 - similarity) + 1e-9) for n in runs]
    if length < min(8, least) and replaced == [1]:
        return tuple("1" * i + "0" + "1" * (length - i - 1) for i in range(length))
    # Between m replaced words the longest of m + 1 gaps can't be shorter.
    width = min(-(-(n - m) // (m + 1)) for n, m in zip(runs, replaced))
    if width < 1:
        raise ValueError(f"a similarity of {similarity} asks for no equal words")
    return ("1" * width,)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window under the mask."""
    n = max(0, len(words) - len(mask) + 1)
    total = np.full(n, int("1" + mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total = mixed(total) + words[i:i + n]
    return mixed(total)


def _bits(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(s)) & np.uint64(FILTER_BITS - 1) for s in _SHIFTS]


def _passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter lets pass."""
    at = np.arange(len(h))
    for s in _SHIFTS:
        bit = (h[at] >> np.uint64(s)) & np.uint64(FILTER_BITS - 1)
        at = at[(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return at


def best_run(agree: np.ndarray, least: int, similarity: float) -> tuple[int, int, int] | None:
    """Start, length and agreeing words of the longest run of at least ``least`` words that agrees well enough."""
    gain = np.concatenate([[0], np.cumsum(np.where(agree, 1 - similarity, -similarity))])
    lowest = np.minimum.accumulate(gain)
    stops = np.arange(least, len(gain))
    good = stops[lowest[stops - least] <= gain[stops] + 1e-9]
    if not len(good):
        return None
    starts = np.searchsorted(-lowest, -(gain[good] + 1e-9))
    i = int(np.argmax(good - starts))
    start, stop = int(starts[i]), int(good[i])
    return start, stop - start, int(agree[start:stop].sum())


def _keys(key: str, text: str):
    return [F.xxhash64(key, text).alias("k"), F.xxhash64(text, key).alias("l")]


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
                 item_text: str = "text", least: int = 13, similarity: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item that overlap: key, item, the longest run and its agreement.

    Columns: ``key`` and ``item`` under their own names, start_word, n_words, n_agreeing, and the row's hashes k and l.
    """
    spark = df.sparkSession

    def cut(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            for i, j in chunks(texts):
                words, first = hashed_words(texts[i:j])
                ends = [*first[1:].tolist(), len(words)]
                lists = [words[a:b].view(np.int64) for a, b in zip(first.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lists, pa.list_(pa.int64()))], names=["item", "words"])

    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    item_type = items.schema["item"].dataType.simpleString()
    items = side_table(items.mapInArrow(cut, f"item {item_type}, words array<bigint>").where(F.size("words") > 1)
                       .withColumn("no", F.monotonically_increasing_id()), "benchmark-words")
    # At most ``least`` lengths.
    lengths = [r.n for r in items.select(F.least(F.size("words"), F.lit(least)).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_for(n, least, similarity)})

    def item_seeds(batches):
        for batch in batches:
            for no, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = words.values.to_numpy().view(np.uint64)
                for m in masks_for(min(least, len(values)), least, similarity):
                    h = seeds(values, m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(np.full(len(h), no)), pa.array(np.arange(len(h), dtype=np.int32)),
                         pa.array(np.full(len(h), len(values), np.int32))], names=["h", "no", "at", "n"])

    planted = side_table(items.select("no", "words").mapInArrow(item_seeds, "h long, no long, at int, n int"), "benchmark-seeds")
    # The filter: at most FILTER_BITS / 64 rows come to the driver, whatever the size of the benchmark.
    bit = F.explode(F.array(*[F.expr(f"shiftrightunsigned(h, {s}) & {FILTER_BITS - 1}L") for s in _SHIFTS]))
    packed = planted.select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).select("id", *_keys("id", "text"), "text")
    id_type = rows.schema["id"].dataType.simpleString()

    def suspects(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            for i, j in chunks(texts):
                words, first = hashed_words(texts[i:j])
                text_of = np.repeat(np.arange(j - i), np.diff([*first.tolist(), len(words)]))
                hits = []
                for mask in masks:
                    h = seeds(words, mask)
                    at = _passing(h, shared.value)
                    at = at[text_of[at] == text_of[at + len(mask) - 1]]
                    hits.append((text_of[at], at - first[text_of[at]], h[at]))
                text_no, at, h = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
                order = np.argsort(text_no, kind="stable")
                text_no, at, h = text_no[order], at[order], h[order]
                found, where = np.unique(text_no, return_index=True)
                offsets = pa.array(np.append(where, len(text_no)).astype(np.int32))
                ends = [*first[1:].tolist(), len(words)]
                lists = [words[first[t]:ends[t]].view(np.int64) for t in found.tolist()]
                head = [c.take(pa.array(found + i)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(lists, pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32)))], names=["id", "k", "l", "words", "hs", "ats"])

    suspect = side_table(rows.mapInArrow(suspects, f"id {id_type}, k long, l long, words array<long>, hs array<long>, ats array<int>"), "suspects")
    hits = suspect.select("k", "l", F.explode(F.arrays_zip("hs", "ats")).alias("hit")).select("k", "l", F.col("hit.hs").alias("h"), F.col("hit.ats").alias("place"))
    aligned = salted_join(hits, planted, ["h"]).select("k", "l", "no", "n", (F.col("place") - F.col("at")).alias("shift")).distinct()
    # Only the words beside the item go on.
    first = F.greatest("shift", F.lit(0))
    pairs = aligned.join(suspect.select("k", "l", "id", "words"), ["k", "l"]).select(
        "k", "l", "id", "no", "shift", F.slice("words", first + 1, F.col("n") + F.col("shift") - first).alias("words"))
    pairs = salted_join(pairs, items.select("no", "item", F.col("words").alias("theirs")), ["no"]).select("id", "k", "l", "item", "shift", "words", "theirs")

    def verify(batches):
        for batch in batches:
            keep, found = [], []
            ours, theirs, shifts = batch.column(5), batch.column(6), batch.column(4).to_numpy()
            for i in range(batch.num_rows):
                x, y, shift = ours[i].values.to_numpy(), theirs[i].values.to_numpy(), int(shifts[i])
                a = max(0, shift)
                run = best_run(x == y[a - shift:a - shift + len(x)], min(least, len(y)), similarity)
                if run:
                    keep.append(i)
                    found.append((a + run[0], run[1], run[2]))
            part = batch.take(pa.array(keep, pa.int64()))
            columns = [pa.array([f[c] for f in found], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names=["id", "k", "l", "item", "start_word", "n_words", "n_agreeing"])

    overlaps = pairs.mapInArrow(verify, f"id {id_type}, k long, l long, item {item_type}, start_word long, n_words long, n_agreeing long")
    best = overlaps.groupBy("id", "k", "l", "item").agg(
        F.max(F.struct("n_agreeing", "n_words", (-F.col("start_word")).alias("start"))).alias("run"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item), (-F.col("run.start")).alias("start_word"),
                       F.col("run.n_words").alias("n_words"), F.col("run.n_agreeing").alias("n_agreeing"), "k", "l")


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that overlap no benchmark item, with the columns of ``df``."""
    found = side_table(contaminated(df, benchmark, text, key).select("k", "l").distinct(), "contaminated")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_keys(f"`{key}`", f"`{text}`"))
    return rows.join(found, ["k", "l"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in df.columns])


@register("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).drop("k", "l")
