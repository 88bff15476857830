"""SimHash near-dedup with vantage-point trees.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Copies share a
fingerprint, so the search runs over distinct fingerprints, counted with a combine in the map tasks. The tops of three
vantage-point trees (one for each third of the bits, see ``vp_trees``) are grown on a bounded sample of fingerprints; then
every fingerprint goes to its home shard and to the shards that it can have partners in. A shard of more than PIECE
fingerprints (a dense group of near copies that no cut divides) is dealt into blocks, and every pair of blocks is a piece of
its own. A task holds one shard or piece at a time, goes on splitting it in the same way, compares exactly in the last
leaves and returns for each fingerprint one link to the first of its group there. Components of these links are found by
distributed star steps.

Null text counts as empty; a text without words has the fingerprint zero, linked like any other. Null ids are passed over
by "smallest id"; if all ids of a group are null, so is its component. Of repeated rows exactly one stays. Extra columns
are kept, those named like a new one replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm import vp_trees
from lapforge.llm.common import bounded_sample, salted_join, side_table, table, with_text_columns
from lapforge.llm.components import components
from lapforge.llm.registry import register

#: Fingerprints that the tops of the trees are grown on, and fingerprints to a shard.
SAMPLE = 1 << 16
SHARD = 1 << 13
#: Fingerprints of a shard that a task compares at once.
PIECE = 1 << 16


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Lower-case A-Z, words between ASCII white space, shingles joined by a space; repeats count."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts]).tolist()
    k = min(words, len(parts))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())])
    n = len(hashes) // 8
    # Bits are counted a slice at a time, so that a long text doesn't need 64 bytes a shingle.
    rows, counts = np.frombuffer(hashes, np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        counts += np.unpackbits(rows[i:i + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, text: str | tuple[str, str] = "text", words: int = 4, keep_text: bool = True) -> DataFrame:
    """``df`` with the column ``fp``, the fingerprint as a signed long."""
    def compute(texts):
        return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return with_text_columns(df, text, "fp long", lambda: compute, () if keep_text else (text,))


def near_links(distinct: DataFrame, bits: int = 4, sample_rows: int = SAMPLE, shard_rows: int = SHARD,
               piece_rows: int = PIECE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``bits`` of each other."""
    spark = distinct.sparkSession
    radius = bits // len(vp_trees.PARTS)
    total = distinct.count()
    drawn = bounded_sample(distinct.select("fp"), ["fp"], sample_rows, total).toArrow()
    sample = drawn.column("fp").to_numpy().view(np.uint64)
    leaf = max(16, int(shard_rows * len(sample) / max(total, 1)))
    trees = spark.sparkContext.broadcast([vp_trees.grow(sample, mask, radius, leaf) for mask in vp_trees.PARTS])
    firsts = np.cumsum([0] + [t.leaves for t in trees.value])

    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for first, tree in zip(firsts, trees.value):
                leaves, where = vp_trees.shards(tree, x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((leaves + first).astype(np.int32)), pa.array(x[where].view(np.int64))], names=["shard", "fp"])

    def search(batches):
        def links(piece, x):
            tree = trees.value[int(np.searchsorted(firsts, piece >> 40, side="right")) - 1]
            x = np.unique(x.view(np.int64)).view(np.uint64)
            first = vp_trees.linked(x, tree.mask, tree.radius, bits)
            other = first != np.arange(len(x))
            return pa.RecordBatch.from_arrays(
                [pa.array(x[other].view(np.int64)), pa.array(x[first[other]].view(np.int64))], names=["a", "b"])

        for piece, x in _runs(batches):
            yield links(int(piece), x.view(np.uint64))

    dealt = side_table(distinct.select("fp").mapInArrow(deal, "shard int, fp long"), "near-shards")
    # At most one row for each leaf of the trees.
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
    pieces = dealt.join(F.broadcast(sizes), "shard").select(
        "shard", "fp", block.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("j"))
    piece = F.shiftleft(F.col("shard").cast("long"), 40).bitwiseOR(F.shiftleft(F.least("i", "j"), 20)).bitwiseOR(F.greatest("i", "j"))
    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    return pieces.select(piece.alias("piece"), "fp").repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(
        search, "a long, b long")


def _runs(batches):
    """(key, values) for each run of equal keys in sorted batches of (key, value)."""
    key, held = None, []
    for batch in batches:
        keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.diff(keys)) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
            if start == stop:
                continue
            if held and keys[start] != key:
                yield key, np.concatenate(held)
                held = []
            key = keys[start]
            held.append(values[start:stop])
    if held:
        yield key, np.concatenate(held)


def fingerprint_groups(tagged: DataFrame, smallest, bits: int = 4) -> DataFrame:
    """(fp, stay) for the fingerprints of groups with more than one row; ``stay`` is the least of ``smallest``."""
    distinct = side_table(tagged.groupBy("fp").agg(F.count("*").alias("n"), smallest.alias("stay")), "fingerprints")
    roots = side_table(components(side_table(near_links(distinct, bits), "near-links")), "near-roots")
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    joined = joined.where("n > 1 OR root IS NOT NULL").select("fp", "stay", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("stay").alias("stay"))
    return salted_join(joined.select("fp", "root"), least, ["root"]).select("fp", "stay")


def near_components(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, bits: int = 4) -> DataFrame:
    """Without the text: the rows of ``df`` with ``fingerprint`` (hexadecimal) and ``component_id``."""
    kept = [c for c in df.columns if c not in (text, "fingerprint", "component_id")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    tagged = side_table(with_fingerprints(rows, "text", words, keep_text=False), "tagged")
    groups = fingerprint_groups(tagged, F.min("id"), bits)
    return salted_join(tagged, groups.withColumn("found", F.lit(True)), ["fp"], "left").select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("found"), F.col("stay")).otherwise(F.col("id")).alias("component_id"))


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``df`` without those near another that stays; of a group the smallest id stays."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("id"))
    tagged = side_table(with_fingerprints(rows, ("row", text), words).withColumn("seq", F.monotonically_increasing_id()), "tagged")
    groups = fingerprint_groups(tagged.select("fp", "id", "seq"), F.min(F.struct(F.col("id").isNull(), "id", "seq")), bits)
    return salted_join(tagged, groups, ["fp"], "left").where(F.col("stay").isNull() | (F.col("stay.seq") == F.col("seq"))).select(
        *[F.col("row").getField(c).alias(c) for c in df.columns])


@register("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
