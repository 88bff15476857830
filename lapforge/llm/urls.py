"""URL filter by the ratio of two character language models.

Rules decide first: a rule is a host and the start of a path, fits that host and its subdomains, and the longest fitting
rule wins. All other urls are judged by two Markov models of variable order, one learned from the urls that a rule accepts
and one from those that a rule rejects. The probability of a character after the ORDER - 1 characters before it is
smoothed from the longest context to the shortest (Witten-Bell): p(x | h) = (n(hx) + t(h) p(x | h')) / (n(h) + t(h)), with
t(h) the number of different characters seen after h and h' the context without its first character; a context that was
never seen hands down the shorter one's value, and the last resort is BASE. A url's score is the mean over its characters
of the logarithm of accepted over rejected. The threshold is calibrated on every FOLDth labelled url, which the models
don't learn from: the score that best separates the two kinds, the one nearest to 0 of equals.

Everything runs on distinct urls. The counts of all grams stay in Spark; windows over a context hold at most one row for
each character of the alphabet. Grams that nearly all urls share are spread by a salted join. Scores are summed as whole
numbers of 2^-24, so they don't depend on the order of addition.

A null url, or one without ``://``, has an empty host and path; its score is that of its text (null: of the empty text).
Without accepted or rejected urls the threshold is 0. Repeated rows are judged alike. Extra columns are kept, those named
like a new one replaced. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapforge.llm.common import salted_join, side_table, table
from lapforge.llm.registry import register

ORDER = 5
FOLD = 5
BASE = 1 / 256
UNIT = 1 << 24
TASK_URLS = 4000
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
NEW = ("host", "path", "rule", "verdict", "score")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(url: Column, order: int = ORDER) -> Column:
    """The gram that ends at every character of the padded url, the end mark included."""
    lower = F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chars = F.split(F.concat(F.lit("\x02" * (order - 1)), lower, F.lit("\x03")), "")
    chars = F.filter(chars, lambda c: c != "")
    return F.transform(F.sequence(F.lit(order), F.size(chars)), lambda i: F.array_join(F.slice(chars, i - (order - 1), order), ""))


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) from (gram, accepted, rejected): the log ratio of the last character after the others, in UNITs."""
    sides, last = ("accepted", "rejected"), None
    for k in range(1, order + 1):
        level = counts.groupBy(F.expr(f"right(gram, {k})").alias("g")).agg(*[F.sum(s).alias(s) for s in sides])
        context = Window.partitionBy(F.expr(f"left(g, {k - 1})"))
        level = level.select("g", *sides, *[F.sum(s).over(context).alias(f"n_{s}") for s in sides],
                             *[F.sum((F.col(s) > 0).cast("long")).over(context).alias(f"t_{s}") for s in sides])
        if last is None:
            level = level.select("*", *[F.lit(BASE).alias(f"p_{s}") for s in sides])
        else:
            level = level.withColumn("shorter", F.expr(f"right(g, {k - 1})")).join(last, "shorter")
        p = {s: F.when(F.col(f"n_{s}") > 0, (F.col(s) + F.col(f"t_{s}") * F.col(f"p_{s}")) / (F.col(f"n_{s}") + F.col(f"t_{s}")))
             .otherwise(F.col(f"p_{s}")) for s in sides}
        last = level.select(F.col("g").alias("shorter"), *[p[s].alias(f"p_{s}") for s in sides])
    ratio = F.round((F.ln("p_accepted") - F.ln("p_rejected")) * UNIT).cast("long")
    return last.select(F.col("shorter").alias("gram"), ratio.alias("ratio"))


def threshold(bins: list[tuple[int, int, int]], width: float) -> float:
    """The lower edge of the bin from which on accepting separates best; bins are (number, accepted, rejected)."""
    accepted, rejected = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not accepted or not rejected:
        return 0.0
    found = sorted(bins)
    numbers = np.array([b[0] for b in found] + [found[-1][0] + 1])
    above = np.append(np.cumsum([b[1] for b in found][::-1])[::-1], 0) / accepted
    below = np.append(0, np.cumsum([b[2] for b in found])) / rejected
    quality = above + below
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return float(numbers[best[np.argmin(np.abs(numbers[best]))]] * width)


def judged(df: DataFrame, url: str = "url", rules=RULES, order: int = ORDER, width: float = 0.001) -> DataFrame:
    """``df`` with host, path, rule, verdict (``allow`` or ``block``) and score. ``width`` is the step of the threshold."""
    kept = [c for c in df.columns if c not in NEW]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(url), F.lit("")).alias("u"))
    host, path = host_and_path(F.col("u"))
    named = rows.select("u").distinct().select("u", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    named = named.select("*", rule.alias("rule"), verdict.alias("decided")).withColumn("no", F.monotonically_increasing_id())
    named = named.withColumn("apart", F.pmod(F.crc32(F.col("u").cast("binary")), F.lit(FOLD)) == 0)
    named = side_table(named, "urls")
    # A url is small and its grams are many: tasks get a number of urls, not of bytes.
    tasks = max(1, -(-named.count() // TASK_URLS))
    places = named.repartition(tasks).select("no", "decided", "apart", F.explode(grams(F.col("u"), order)).alias("gram"))
    learned = [F.sum(((F.col("decided") == what) & ~F.col("apart")).cast("long")).alias(side) for what, side in (("allow", "accepted"), ("block", "rejected"))]
    counts = side_table(places.groupBy("gram").agg(*learned).na.fill(0), "url-grams")
    ratios = side_table(gram_ratios(counts, order), "url-ratios")
    sums = salted_join(places.select("no", "gram"), ratios, ["gram"]).groupBy("no").agg((F.sum("ratio") / F.count("*") / UNIT).alias("score"))
    scored = side_table(named.join(sums, "no"), "url-scores")
    step = F.floor(F.col("score") / width).cast("long")
    bins = scored.where("apart AND decided IS NOT NULL").groupBy(step.alias("bin")).agg(
        F.sum((F.col("decided") == "allow").cast("long")), F.sum((F.col("decided") == "block").cast("long"))).collect()
    least = threshold([tuple(b) for b in bins], width)
    method = F.when(F.col("score") >= least, F.lit("allow")).otherwise(F.lit("block"))
    final = scored.select("u", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "score")
    return salted_join(rows, final, ["u"]).select(*[F.col("row").getField(c).alias(c) for c in kept], *NEW)


@register("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"))
