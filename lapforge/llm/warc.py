"""WARC fixity audit with Merkle trees.

Every record of an archive has a digest. Records are hashed in the order of their offsets into ranges of 2^LEAF_BITS bytes,
ranges into ranges of FAN_BITS more bits, and so on up to one root. Two replicas are equal if their roots are. If not, the
audit goes down from the root: of each level it looks only at the children of nodes that differ, and ends at the records
that are altered, missing or extra. A node's children are few (2^FAN_BITS, or the records of one smallest range), so no
task holds more than that of one node; both replicas' trees are built in one pass, and a level is written before the next.

Offsets come from a distributed running sum: records are put in order by ranges, each range is summed, and the sums of the
ranges before it are added.

Null urls and payloads count as empty. Records with equal ids stand next to each other in the order of their digests;
equal records are told apart by their offset only. An empty archive has no root and nothing to report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapforge.llm.common import side_table, table
from lapforge.llm.registry import register

LEAF_BITS = 16
FAN_BITS = 4
RANGE_ROWS = 200_000
HEAD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "
MIDDLE = "\r\nContent-Type: text/html\r\nContent-Length: "


def warc_record(url: Column, body: Column) -> Column:
    """The record's text: head, payload and end."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit(HEAD), url, F.lit(MIDDLE), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def with_offsets(records: DataFrame, key: str, length: str, digest: str) -> DataFrame:
    """``records`` with ``offset``, the running sum of the lengths before it in the order of key and digest."""
    parts = max(1, records.count() // RANGE_ROWS)
    order = [F.col(key), F.col(digest), F.col(length)]
    ranged = records.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_tie")
    ranged = side_table(ranged.withColumn("_part", F.spark_partition_id()), "warc-ranges")
    sums = ranged.groupBy("_part").agg(F.sum(length).alias("bytes"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_upto", F.sum(length).over(inside)).join(sums, "_part")
    return summed.withColumn("offset", F.col("base") + F.col("_upto") - F.col(length)).drop("_part", "_tie", "_upto", "base")


def merkle_audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Where the replica differs: offset, length, status (altered, missing, extra), expected and found digest.

    Both have offset, length and digest of every record; the replica's offsets are those it keeps its records at.
    """
    level = side_table(primary.select(F.lit(True).alias("first"), "offset", "length", "digest").unionByName(
        replica.select(F.lit(False).alias("first"), "offset", "length", "digest")), "merkle-records")
    levels, bits = [level.select("first", F.col("offset").alias("node"), F.col("length"), "digest")], LEAF_BITS
    highest = level.agg(F.max("offset")).first()[0] or 0
    while True:
        below = levels[-1]
        children = F.sort_array(F.collect_list(F.struct("node", *(["length"] if len(levels) == 1 else []), "digest")))
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), "|")
        if len(levels) == 1:
            joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["length"].cast("string"), c["digest"])), "|")
        step = LEAF_BITS if len(levels) == 1 else FAN_BITS
        levels.append(side_table(below.groupBy("first", F.shiftright("node", step).alias("node")).agg(
            F.sha2(joined.cast("binary"), 256).alias("digest")), "merkle-level"))
        if highest >> bits == 0:
            break
        bits += FAN_BITS
    differ = None
    for number in range(len(levels) - 1, 0, -1):
        here = levels[number]
        if differ is not None:
            here = here.join(differ, F.shiftright(here["node"], FAN_BITS) == differ["bad"], "left_semi")
        differ = here.groupBy(F.col("node").alias("bad")).agg(
            F.max(F.when(F.col("first"), F.col("digest"))).alias("a"), F.max(F.when(~F.col("first"), F.col("digest"))).alias("b"))
        differ = side_table(differ.where("NOT (a <=> b)").select("bad"), "merkle-differ")
    leaves = level.join(differ, F.shiftright(level["offset"], LEAF_BITS) == differ["bad"], "left_semi")
    at = leaves.groupBy("offset").agg(*[F.max(F.when(side, F.col(c))).alias(f"{c}_{name}")
                                        for c in ("length", "digest") for side, name in ((F.col("first"), "a"), (~F.col("first"), "b"))])
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("altered")
    return at.where("NOT (digest_a <=> digest_b) OR NOT (length_a <=> length_b)").select(
        "offset", F.coalesce("length_a", "length_b").alias("length"), status.alias("status"),
        F.col("digest_a").alias("expected"), F.col("digest_b").alias("found"))


def damaged(url: Column, body: Column) -> tuple[Column, Column]:
    """A second replica for the audit to find faults in, from the records themselves: the payload, and whether it is lost."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    kind = (F.octet_length(url) + F.octet_length(body)) % 40
    changed = F.when(kind == 7, F.concat(F.lit("\x01"), F.expr("substring(_body, 2)"))).when(
        kind == 19, F.expr("substring(_body, 1, length(_body) div 2)")).otherwise(body)
    return changed, kind == 31


def audit_pages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("_url"), F.coalesce(F.col(body), F.lit("")).alias("_body"))
    other, lost = damaged(F.col("_url"), F.col("_body"))
    first, second = warc_record(F.col("_url"), F.col("_body")), warc_record(F.col("_url"), other)
    hashed = rows.select("key", F.octet_length(first).cast("long").alias("length"), F.sha2(first.cast("binary"), 256).alias("digest"),
                         F.octet_length(second).cast("long").alias("length2"), F.sha2(second.cast("binary"), 256).alias("digest2"), lost.alias("lost"))
    archive = side_table(with_offsets(side_table(hashed, "warc-digests"), "key", "length", "digest"), "warc-archive")
    # What a reader of the replica finds at the same offsets.
    replica = archive.where("NOT lost").select("offset", F.col("length2").alias("length"), F.col("digest2").alias("digest"))
    found = merkle_audit(archive.select("offset", "length", "digest"), replica)
    return found.join(archive.select("offset", F.col("key").alias(key)), "offset").select(key, "offset", "length", "status", "expected", "found")


def _sql() -> str:
    crlf = "chr(13) || chr(10)"
    text = lambda t: " || ".join(f"'{x}'" if x else "''" for x in t.split("\r\n")).replace(" || ", f" || {crlf} || ")
    record = lambda body: f"{text(HEAD)} || url || {text(MIDDLE)} || strlen({body}) || {crlf} || {crlf} || {body} || {crlf} || {crlf}"
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
kinds AS (
  SELECT *, (strlen(url) + strlen(body)) % 40 AS kind FROM parts),
bodies AS (
  SELECT *, CASE kind WHEN 7 THEN chr(1) || substr(body, 2) WHEN 19 THEN substr(body, 1, length(body) // 2) ELSE body END AS body2 FROM kinds),
records AS (
  SELECT page_id, kind, {record("body")} AS a, {record("body2")} AS b FROM bodies),
placed AS (
  SELECT page_id, strlen(a) AS length, sha256(a) AS expected, CASE WHEN kind <> 31 THEN sha256(b) END AS found,
    CAST(sum(strlen(a)) OVER (ORDER BY page_id) - strlen(a) AS BIGINT) AS "offset" FROM records)
SELECT page_id, "offset", length, CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS status, expected, found
FROM placed WHERE found IS DISTINCT FROM expected"""


@register("op8_warc_fixity", _sql())
def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(table(spark, sf_dir, "pages"))
