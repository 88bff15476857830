"""Sharding by a k-d tree over metadata, in DataFrame operations only.

The rows of a node are cut at the weighted median of the dimension in which the node is widest, weighted by bytes, until
every leaf is one shard's share. A median is found without sorting or gathering rows: a row's key (the dimension's value,
then its group, then its id) is read as digits of 16 bits, and one aggregate for each digit finds the digit in which the
cut lies, for all nodes of a level at once. The histograms stay in Spark; per node one row comes to the driver and goes
back as a broadcast, so both are bounded by the number of shards, which is at most MAX_SHARDS.

Groups (equal texts) stay together: a cut never goes through a group unless the group alone is larger than a shard. Groups
heavy enough to spoil an even cut are found first, and each node deals its own to its two sides, groups of like weight in
the order of the cut dimension, so that both sides lack in proportion; the cut, found among the light rows, fills up what
the left lacks. There are at most ``shards / tolerance`` heavy groups, and only their weights come to the driver. The dimensions must be equal for equal
texts, as those of ``documents_by_bytes`` are: bytes, share of multi-byte characters, and lines per byte.

Null text has no bytes and a size of 1. Null and not-a-number dimensions count as the smallest value; one that doesn't
vary is never cut. Ties are decided by group and id, so repeated rows go together like a group, or are split by a
hash of their position where a group has to be split. An empty table gives no rows. Columns of the input named like the
new ones are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lapforge.llm.common import side_table, table
from lapforge.llm.registry import register

MAX_SHARDS = 1 << 20
DIGITS = 6  # two of the dimension, two of the group, two of the row
GROUP_DIGITS = 4
EVERYTHING = [1 << 16]  # above all digits
NODE = "node long, dim int, upto array<int>, whole boolean, left array<long>, right array<long>"


def kd_shards(df: DataFrame, dimensions: list[Column], size: Column, group: Column, shards: int | None = None, target_bytes: int | None = None,
              tolerance: float = 0.01) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in every shard).

    ``size`` is a row's weight, ``group`` a whole number below 2^32 that groups rows. Either the number of ``shards`` is
    given or ``target_bytes``, from which it follows. A group heavier than ``tolerance`` of a shard's share is dealt as a
    whole before the cut; lighter ones go to the nearer side of it.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    raw = side_table(df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), size.cast("long").alias("w"), group.cast("long").alias("g"),
        *[F.coalesce(F.nanvl(d.cast("double"), F.lit(None)), F.lit(float("-inf"))).alias(f"v{i}") for i, d in enumerate(dimensions)])
        .withColumn("t", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32))), "kd-rows")
    finite = [F.when(F.abs(F.col(f"v{i}")) < float("inf"), F.col(f"v{i}")) for i in range(len(dimensions))]
    whole = raw.agg(F.count("*").alias("n"), F.sum("w").alias("w"), *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(finite) for f in (F.min, F.max)]).first()
    if shards is None:
        shards = max(1, -(-(whole["w"] or 0) // target_bytes))
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"{shards} shards; at most {MAX_SHARDS}")
    # A dimension's value as a whole number of 32 bits, in the same order.
    top, ordinals = (1 << 32) - 1, []
    for i in range(len(dimensions)):
        low, high = whole[f"min{i}"], whole[f"max{i}"]
        at = F.lit(0.0) if low is None or high == low else (F.col(f"v{i}") - F.lit(low)) / F.lit(high - low)
        ordinals.append(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)) * top).cast("long"))
    rows = raw.select("row", "w", "g", "t", F.array(*ordinals).alias("o"), F.lit(1).cast("long").alias("node"))
    share = (whole["w"] or 0) / shards
    weights = rows.groupBy("o", "g").agg(F.sum("w").alias("w")).where((F.col("w") > tolerance * share) & (F.col("w") <= share))
    heavy = {1: [(tuple(r["o"]), r["g"], r["w"]) for r in weights.collect()]}
    open_nodes, leaves = {1: (0, shards)}, {}
    while open_nodes:
        leaves |= {node: first for node, (first, k) in open_nodes.items() if k == 1}
        open_nodes = {node: x for node, x in open_nodes.items() if x[1] > 1}
        if open_nodes:
            cuts = _cuts(rows, open_nodes, len(dimensions), share, heavy)
            heavy = _descended(heavy, cuts)
            rows = side_table(_beside(rows, cuts), "kd-level")
            open_nodes = {child: x for node, (first, k) in open_nodes.items()
                          for child, x in ((2 * node, (first, k // 2)), (2 * node + 1, (first + k // 2, k - k // 2)))}
    number = _frame(rows, [(node, first) for node, first in leaves.items()], "node long, shard int")
    chunks = max(16, (whole["n"] or 0) // (shards * 50_000))
    placed = rows.join(F.broadcast(number), "node").select("row", "w", "g", "t", "shard", F.pmod(F.xxhash64("t"), F.lit(chunks)).alias("chunk"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("g", "w", "t")) - 1
    return placed.withColumn("inside", inside).join(counts, ["shard", "chunk"]).select(
        *[F.col("row").getField(c).alias(c) for c in kept], "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"))


def _frame(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A short list of rows as a literal of the plan."""
    kind = StructType.fromDDL(schema)
    listed = json.dumps([dict(zip(kind.fieldNames(), row)) for row in rows])
    return like.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), ArrayType(kind))))


def _keyed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of the nodes in ``cuts`` with their key's digits and their group's name in that dimension."""
    o = F.element_at("o", F.col("dim") + 1)
    digits = [part for value in (o, F.col("g"), F.col("t")) for part in (F.shiftright(value, 16), value.bitwiseAND(0xFFFF))]
    return rows.join(F.broadcast(cuts), "node").withColumn("digits", F.array(*[d.cast("int") for d in digits])).withColumn(
        "atom", F.shiftleft(o, 32).bitwiseOR(F.col("g")))


def _beside(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Every row of a cut node in the child it belongs to."""
    keyed = _keyed(rows, _frame(rows, cuts, NODE))
    # Arrays compare like words in a dictionary; a key that goes on after an equal start is larger.
    below = F.slice("digits", 1, F.size("upto")) <= F.col("upto")
    below = F.when(F.col("whole"), below).otherwise(F.slice("digits", 1, F.size("upto")) < F.col("upto"))
    goes_left = F.array_contains("left", F.col("atom")) | (below & ~F.array_contains("right", F.col("atom")))
    moved = keyed.select("row", "w", "g", "t", "o", (F.col("node") * 2 + F.when(goes_left, 0).otherwise(1)).alias("node"))
    stay = rows.join(F.broadcast(_frame(rows, [(c[0],) for c in cuts], "node long")), "node", "left_anti")
    return moved.unionByName(stay.select(moved.columns))


def _atom(o: tuple, g: int, dim: int) -> int:
    """A group's name in a dimension, as the long that ``_keyed`` gives its rows."""
    atom = o[dim] << 32 | g
    return atom - (1 << 64) if atom >= 1 << 63 else atom


def _descended(heavy: dict, cuts: list[tuple]) -> dict:
    """The heavy groups of every child."""
    out = {}
    for node, dim, _, _, left, _ in cuts:
        aside = set(left)
        for o, g, w in heavy.get(node, ()):
            out.setdefault(2 * node + (_atom(o, g, dim) not in aside), []).append((o, g, w))
    return out


def _dealt(groups: list[tuple], dim: int, goal: float, light: float) -> tuple[list[int], list[int], float]:
    """Heavy groups for the left and for the right, and the weight of light rows that the left then lacks.

    Groups of like weight (within a factor of two) are dealt together, the heaviest first, so that the children can be cut
    evenly too: the first of them in the order of the dimension go left, as many as leave both sides lacking in proportion.
    """
    weights: dict[tuple, int] = {}
    for o, g, w in groups:
        key = (o[dim], g, _atom(o, g, dim))
        weights[key] = weights.get(key, 0) + w
    classes: dict[int, list] = {}
    for key, w in weights.items():
        classes.setdefault(w.bit_length(), []).append(key)
    rest = light + sum(weights.values())
    part, lacking, left = goal / rest if rest else 0, goal, []
    for _, members in sorted(classes.items(), reverse=True):
        members.sort()
        rest -= sum(weights[k] for k in members)
        sums = [0]
        for key in members:
            sums.append(sums[-1] + weights[key])
        count = min(range(len(sums)), key=lambda i: abs(lacking - sums[i] - part * rest))
        left += members[:count]
        lacking -= sums[count]
    aside = set(left)
    return [k[2] for k in left], [k[2] for k in weights if k not in aside], lacking


def _cuts(rows: DataFrame, nodes: dict, dimensions: int, share: float, heavy: dict) -> list[tuple]:
    """For each node (node, dimension, key, whether the key itself goes left, groups that go left, that go right)."""
    widths = [(F.max(F.col("o")[i]) - F.min(F.col("o")[i])).alias(f"d{i}") for i in range(dimensions)]
    listed = _frame(rows, [(n,) for n in nodes], "node long")
    found = {r["node"]: r for r in rows.join(F.broadcast(listed), "node").groupBy("node").agg(F.sum("w").alias("w"), *widths).collect()}
    done, todo = [], {}
    for node, (_, k) in nodes.items():
        if node not in found:
            done.append((node, 0, [0], False, [], []))
            continue
        r, groups = found[node], heavy.get(node, [])
        dim = max(range(dimensions), key=lambda i: (r[f"d{i}"], -i))
        light = r["w"] - sum(w for _, _, w in groups)
        left, right, lacking = _dealt(groups, dim, r["w"] * (k // 2) / k, light)
        if 0 < lacking < light:
            todo[node] = {"dim": dim, "goal": lacking, "left": left, "right": right, "upto": []}
        else:
            done.append((node, dim, [0] if lacking <= 0 else EVERYTHING, False, left, right))
    while todo:
        params = _frame(rows, [(n, x["dim"], x["upto"], True, x["left"], x["right"]) for n, x in todo.items()], NODE)
        goals = _frame(rows, [(n, float(x["goal"])) for n, x in todo.items()], "node long, goal double")
        at = F.size("upto")
        inside = _keyed(rows, params).where(
            (F.slice("digits", 1, at) == F.col("upto")) & ~F.array_contains("left", F.col("atom")) & ~F.array_contains("right", F.col("atom")))
        bins = inside.groupBy("node", F.element_at("digits", at + 1).alias("digit")).agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("digit"))
        total = F.sum("w").over(Window.partitionBy("node"))
        bins = bins.withColumn("upto", upto).withColumn("total", total).join(F.broadcast(goals), "node")
        first = bins.where("upto >= least(goal, total)").groupBy("node").agg(F.min(F.struct("digit", "upto", "w")).alias("b"))
        for r in first.collect():
            node, b = r["node"], r["b"]
            x = todo[node]
            x["goal"] -= b["upto"] - b["w"]
            x["upto"] = [*x["upto"], b["digit"]]
            if len(x["upto"]) == DIGITS or (len(x["upto"]) == GROUP_DIGITS and b["w"] <= share):
                done.append((node, x["dim"], x["upto"], x["goal"] >= b["w"] / 2, x["left"], x["right"]))
                del todo[node]
    return done


def documents_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for all documents."""
    plain = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(plain) + 1).cast("long")
    crc = F.crc32(plain.cast("binary"))
    lines = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit("\n"), F.lit("")))
    described = docs.select(F.col(key), size.alias("size"), crc.alias("text_crc32"), (F.char_length(plain) / size).alias("narrow"),
                            (lines / size).alias("lines"))
    placed = kd_shards(described, [F.log2("size"), F.col("narrow"), F.col("lines")], F.col("size"), F.col("text_crc32"), shards)
    return placed.select(key, "size", "text_crc32", "shard", "slot")


@register("op2_kd_sharding")
def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = documents_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
