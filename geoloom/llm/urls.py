"""URL filters: host and path rules, then a character language-model ratio.

Two variable-order Markov models over the characters (code points) of host and
path are counted from the URLs that rules accept and reject. A URL without a
rule is blocked if the difference of its log-likelihoods by character is over a
threshold calibrated on rule-decided URLs that were not counted.

Counts are exact and live in tables: nothing of the models reaches the driver
and no plan asks for a broadcast of them. Each distinct n-gram of the URLs to
judge gets its log-ratio once, as a whole number of 2**-32, so that sums do not
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import table

#: allow, host, path.
RULES = [(True, "com", "/"), (False, "example.com", "/en/"), (True, "www.example.com", "/en/"), (False, "net", "/es/"), (False, "net", "/fr/")]

#: Longest context, one URL in so many held out, bins of scores.
ORDER, HELD_OUT, BINS = 4, 8, 400
SPAN = 8.0
#: Weight of the next shorter context, and the chance of any code point without one.
SMOOTH, UNIFORM = 2.0, 1 / 1114112
_ONE = 2.0**32


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[bool, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of name and allow; null if none does."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit(True).alias("allow")))
    for allow, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = out.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(allow).alias("allow")))
    return out


def grams(s: Column) -> Column:
    """The ORDER + 1 characters that end at each character of ``s`` and at its end; before the first and as the last stands U+0000."""
    zero = F.lit("\0")
    inner = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    chars = F.concat(F.array_repeat(zero, ORDER), inner, F.array(zero))
    at = F.sequence(F.lit(0), F.size(inner))
    # the array is a lambda variable, so it is made once
    many = F.transform(F.array(F.struct(chars.alias("c"), at.alias("at"))), lambda x: F.transform(x["at"], lambda i: F.concat(*[F.get(x["c"], i + j) for j in range(ORDER + 1)])))
    return F.get(many, F.lit(0))


def count(urls: DataFrame) -> DataFrame:
    """gram, rejected, accepted for the distinct full-length n-grams of ``urls`` (s, allow); sums are made map-side."""
    each = urls.select("allow", F.explode(grams(F.col("s"))).alias("gram"))
    return each.groupBy("gram").agg(F.sum((~F.col("allow")).cast("long")).alias("rejected"), F.sum(F.col("allow").cast("long")).alias("accepted"))


def model(counted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order the counts of the n-grams (g, g0, g1) and of their contexts (c, c0, c1), all sums of :func:`count`."""
    out = []
    for k in range(ORDER + 1):
        sums = counted.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("rejected").alias("g0"), F.sum("accepted").alias("g1"))
        context = F.substring("g", 1, k) if k else F.lit("")
        out.append((sums, sums.groupBy(context.alias("c")).agg(F.sum("g0").alias("c0"), F.sum("g1").alias("c1"))))
    return out


def ratio_table(wanted: DataFrame, known: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram, ratio (long, in 2**-32) for the n-grams ``wanted`` (gram): log-likelihood under the rejecting model less that under the accepting one.

    Each order is smoothed with the one below, with the weight of its context's count.
    """
    df = wanted.withColumn("p0", F.lit(UNIFORM)).withColumn("p1", F.lit(UNIFORM))
    for k, (of_gram, of_context) in enumerate(known):
        df = df.join(of_gram, F.substring("gram", ORDER + 1 - k, k + 1) == F.col("g"), "left")
        if k:
            df = df.join(of_context, F.substring("gram", ORDER + 1 - k, k) == F.col("c"), "left")
        else:
            df = df.join(F.broadcast(of_context), F.lit(True), "left")  # one row at most
        for i in range(2):
            df = df.withColumn(f"p{i}", (F.coalesce(f"g{i}", F.lit(0)) + SMOOTH * F.col(f"p{i}")) / (F.coalesce(f"c{i}", F.lit(0)) + SMOOTH))
        df = df.select("gram", "p0", "p1")
    return df.select("gram", F.round((F.log("p0") - F.log("p1")) * _ONE).cast("long").alias("ratio"))


def score(urls: DataFrame, counted: DataFrame) -> DataFrame:
    """s, ratio (log-likelihood difference by character) for the distinct ``s`` of ``urls``.

    A string's n-grams are summed under two 64-bit hashes of it.
    """
    hashes = [F.xxhash64("s").alias("h0"), F.xxhash64(F.lit("url"), F.col("s")).alias("h1")]
    distinct = urls.select("s").distinct()
    each = table(distinct.select(*hashes, F.explode(grams(F.col("s"))).alias("gram")).groupBy("h0", "h1", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    ratios = table(ratio_table(each.select("gram").distinct(), model(counted)), "ratios")
    sums = each.join(ratios, "gram").groupBy("h0", "h1").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n") / _ONE).alias("ratio"))
    return distinct.select("s", *hashes).join(sums, ["h0", "h1"]).select("s", "ratio")


def threshold(held: DataFrame) -> float:
    """The ratio that best parts held-out rejected from accepted URLs (balanced accuracy), from a histogram of all of them."""
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("ratio") + SPAN) * (BINS / (2 * SPAN))))).cast("int")
    seen = [[0] * BINS for _ in range(2)]
    for allow, b, n in held.groupBy("allow", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():  # 2 * BINS rows at most
        seen[int(allow)][b] = n
    rejected, accepted = map(sum, seen)
    if not rejected or not accepted:
        return float("inf") if not rejected else 0.0
    good, below = [], [0, 0]
    for b in range(BINS + 1):
        good.append((rejected - below[0]) / rejected + below[1] / accepted)  # rejected at or above, accepted below
        below = [n + s[b] if b < BINS else n for n, s in zip(below, seen, strict=True)]
    best = [b for b, g in enumerate(good) if g >= max(good) - 1e-12]
    return best[len(best) // 2] * 2 * SPAN / BINS - SPAN


def judge(pages: DataFrame, rules: list[tuple[bool, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (null where a rule decides) for every row.

    Null urls and urls without ``://`` have empty host and path; the models
    judge them like any other. Without URLs that a rule rejects nothing more is
    blocked. A ratio equal to the threshold is allowed. Rows that repeat are judged alike.
    Very long urls are counted whole. Other columns are not read. An empty table gives no rows.
    """
    host, path = parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("s", F.concat("host", "path"))
    known = rows.filter("r IS NOT NULL").select("s", F.col("r.allow").alias("allow"))
    fold = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT))
    counted = table(count(known.filter(fold != 0)), "counted")
    held, open_rows = known.filter(fold == 0), rows.filter("r IS NULL")
    scores = table(score(held.select("s").union(open_rows.select("s")), counted), "scores")
    cut = threshold(held.join(scores, "s"))
    verdict = F.when(F.col("ratio") > cut, "block").otherwise("allow")
    judged = open_rows.join(scores, "s").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "ratio")
    ruled = rows.filter("r IS NOT NULL").select("page_id", "host", "path", F.col("r.name").alias("rule"), F.when(F.col("r.allow"), "allow").otherwise("block").alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    return ruled.union(judged)


def query(pages: DataFrame) -> DataFrame:
    return judge(pages).drop("ratio")
