"""Exact dedup by distributed MSD radix partitioning.

Texts are compared without ASCII white space, as strings of bytes led by their length. Each level splits the groups that
are left by the next bytes, a digit whose width grows from level to level: one aggregate counts the digits of every group,
and rows whose digit nobody shares are done. Only the others keep their bytes for the next level. A group whose texts have
ended holds equal texts; no digest decides. Counting is pre-aggregated in the map tasks and the counts come back by a
salted join, so a group with a third of all rows never meets in one task.

Null text counts as empty, and all empty texts are equal. Repeated rows are documents of their own: exactly one row of a
group has ``kept``. Among rows that tie in length and id any one stays. A null id comes after every other id. Columns of
the input named like the new ones are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm.common import payload, salted_join, side_table, table, unpacked
from lapforge.llm.registry import register

SPACE = r"[ \t\n\x0B\f\r]+"
HOT = 10_000
NEW = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(df: DataFrame, text: str = "text", key: str = "doc_id", carry_text: bool = True, **digits: int) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; without its text unless ``carry_text``.

    ``digits``: see :func:`_grouped`.
    """
    columns = [c for c in df.columns if carry_text or c != text]
    rows = df.select(payload(df, *([] if carry_text else [text])).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    found = _grouped(rows, text if carry_text else None, **digits)
    return found.select(*unpacked("row", columns, *NEW), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``df``."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    return _grouped(rows, text).where("kept").select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary")


def _grouped(df: DataFrame, field: str | None, first: int = 64, growth: int = 512, widest: int = 1 << 20) -> DataFrame:
    """(row, keep_id, group_size, kept, sha) from (row, id, text); ``field`` is where ``row`` has the text too.

    ``first`` is the bytes of the first digit, each later digit is ``growth`` times as wide, up to ``widest``. The first
    level spreads the rows of every digit; later ones know the size of a group and spread those of over HOT rows.
    """
    bare = _bare(F.col("text"))
    rows = df.select(
        "row", "id", F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("chars"), "text", bare.alias("bare"))
    rows = rows.select("row", "id", "chars", F.sha2("bare", 256).alias("sha"), F.octet_length("bare").alias("length"),
                       F.substring("bare", 1, first).alias("digit"), *([] if field else ["text"]))
    rest = _bare(F.col("row").getField(field) if field else F.col("text"))
    digits = df.select(bare.alias("bare")).select(
        F.octet_length("bare").alias("length"), F.substring("bare", 1, first).alias("digit"))
    # Level one: the length and the first bytes.
    shared = side_table(_labelled(digits.groupBy("length", "digit"), 0), "radix-keys")
    level = side_table(
        salted_join(rows, shared, ["length", "digit"], "left").select(
            "row", "id", "chars", "sha", "length", "label", "hot",
            F.when(F.col("label").isNotNull(), F.substring(rest, first + 1, 1 << 30)).alias("rest"),
            F.monotonically_increasing_id().alias("seq")), "radix-level")
    alone, ended, used, width, number = [], [], first, first, 0
    while True:
        alone.append(level.where("label IS NULL"))
        ended.append(level.where(f"label IS NOT NULL AND length <= {used}"))
        level = level.where(f"label IS NOT NULL AND length > {used}")
        if level.isEmpty():
            break
        width, number = min(width * growth, widest), number + 1
        level = level.withColumn("digit", F.substring("rest", 1, width))
        shared = side_table(_labelled(level.groupBy("label", "digit", F.col("hot").alias("was_hot")), number), "radix-keys")
        shared = shared.withColumnsRenamed({"label": "split", "parent": "label", "hot": "stays_hot", "was_hot": "hot"})
        level = side_table(
            salted_join(level, shared, ["label", "digit"], "left", hot="hot").select(
                "row", "id", "chars", "sha", "length", F.col("split").alias("label"), F.col("stays_hot").alias("hot"),
                F.when(F.col("split").isNotNull(), F.expr(f"substring(rest, {width + 1})")).alias("rest"), "seq"), "radix-level")
        used += width
    members = _together(ended).select("row", "id", "chars", "sha", "label", "seq")
    stays = members.groupBy("label").agg(
        F.count("*").alias("group_size"), F.min(F.struct(-F.col("chars"), F.col("id").isNull(), "id", "seq")).alias("stay"))
    grouped = salted_join(members, stays, ["label"]).select(
        "row", F.col("stay.id").alias("keep_id"), "group_size", (F.col("stay.seq") == F.col("seq")).alias("kept"), "sha")
    single = _together(alone).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                     F.lit(True).alias("kept"), "sha")
    return single.unionByName(grouped)


def _labelled(grouped, number: int) -> DataFrame:
    """The digits that more than one row has, each with a label that no other level gives."""
    base = F.lit(number << 56).cast("long")
    keys = grouped.agg(F.count("*").alias("n")).where("n > 1").withColumn("hot", F.col("n") > HOT).drop("n")
    if "label" in keys.columns:
        keys = keys.withColumnRenamed("label", "parent")
    return keys.withColumn("label", base + F.monotonically_increasing_id())


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@register("op3_exact_dedup", """
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare
  FROM documents),
ranked AS (
  SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size,
    first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id
  FROM norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
