"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, fresh, uniform, uniform_sql, word_count

#: No document is repeated more often, so no target exceeds so many times its source.
MAX_RATE = 3
#: Draws tried for each source; the one that comes nearest the target is taken.
TRIALS = 32


def targets(sizes: DataFrame) -> DataFrame:
    """Words that the mix should take of each source.

    ``sizes`` has a row for each source: source, source_size. In code point
    order with null last, the sources weigh 1, 2, 3, 1, … and share all words;
    a target stops at MAX_RATE times its source and the excess is shared again
    by weight. That fixed point has a level L with target = min(cap, L·weight):
    with the sources in order of cap / weight, the k-th is capped exactly if
    its ratio is at most the level that the words and weights from k on give.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    w = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * MAX_RATE).cast("double"))
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = Window.orderBy("ratio", F.col("source").isNull(), "source")
    w = w.withColumn("capped_before", F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weight_left", F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    w = w.withColumn("held", F.col("ratio") <= F.col("level"))
    # the level of the first source that is not held
    w = w.withColumn("l", F.first(F.when(~F.col("held"), F.col("level")), ignorenulls=True).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select("source", "source_size", F.when(F.col("held"), F.col("cap")).otherwise(F.col("l") * F.col("weight")).alias("target"))


def _key(doc_id: Column, text: Column) -> Column:
    """What a document's draw depends on: its id and its text, so rows without an id or with the same one are drawn independently."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def plan(docs: DataFrame, seed: str = "mix", trials: int = TRIALS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each source: source, source_size, target, rate, trial.

    A document is emitted floor(rate) times, and once more if its draw is
    below the fraction. Trials are independent draws; the taken one is that
    whose words come nearest the target, the first on a tie. Sources are summed in
    two steps with map-side sums, so a hot source is no hot task. A broadcast
    of this result is bounded by the number of sources, which the window
    above it already holds in one task.
    """
    size = word_count(F.col(text)).alias("size")
    base = docs.select(F.col(source).alias("source"), _key(F.col(doc_id), F.col(text)).alias("key"), size)
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole")).withColumnRenamed("source", "of")
    drawn = base.join(F.broadcast(goal), F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", "target", "rate", "whole", "size", "part", *[u.alias(f"u{i}") for i, u in enumerate(uniform(F.col("key"), seed, trials))])
    sums = drawn.groupBy("source", "source_size", "target", "rate", "whole").agg(*[F.sum(F.when(F.col(f"u{i}") < F.col("part") * 4294967296.0, F.col("size")).otherwise(0)).alias(f"s{i}") for i in range(trials)])
    misses = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{i}") - F.col("target")).alias("miss"), F.lit(i).alias("trial")) for i in range(trials)]
    return sums.select("source", "source_size", "target", "rate", F.array_min(F.array(*misses))["trial"].alias("trial"))


def copies(docs: DataFrame, seed: str = "mix", trials: int = TRIALS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the number of copies of each row, and the new columns' names.

    Null text has size 0. Rows that repeat both id and text (null: none) are one document
    stated several times and drawn alike; all others are drawn independently. An
    empty table gives no rows. A source without words has target 0 and rate 0.
    With ``trials`` 1 every document has one plain Bernoulli draw; with more, the
    draws of a source's documents are not independent, as the draw nearest its target is taken.
    """
    goal = plan(docs, seed, trials, doc_id, text, source)
    names = dict(zip(("key", "of", "size", "source_size", "target", "copies", "rate", "trial"), fresh(docs, "key", "of", "size", "source_size", "target", "copies", "rate", "trial"), strict=True))
    goal = goal.select(F.col("source").alias(names["of"]), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), F.col("rate").alias(names["rate"]), F.col("trial").alias(names["trial"]))
    df = docs.withColumn(names["key"], _key(F.col(doc_id), F.col(text))).withColumn(names["size"], word_count(F.col(text)))
    df = df.join(F.broadcast(goal), F.col(source).eqNullSafe(F.col(names["of"])))
    u = F.array(*uniform(F.col(names["key"]), seed, trials))[F.col(names["trial"])]
    whole = F.floor(names["rate"])
    df = df.withColumn(names["copies"], (whole + (u < (F.col(names["rate"]) - whole) * 4294967296.0).cast("int")).cast("int"))
    return df, names


def mix(docs: DataFrame, **options: str | int) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken (options as in :func:`copies`)."""
    df, n = copies(docs, **options)
    again = F.explode(F.array_repeat(F.lit(1), F.col(n["copies"])))
    name = fresh(df, "again")[0]
    return df.filter(F.col(n["copies"]) > 0).withColumn(name, again).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    df, n = copies(docs.select("doc_id", "text", "source"))
    return df.select("doc_id", F.col(n["size"]).alias("size"), F.col(n["source_size"]).alias("source_size"), F.col(n["target"]).alias("target"), (F.col(n["copies"]) * F.col(n["size"])).cast("long").alias("taken"))


def sql(documents: str = "documents", tail: str = "SELECT doc_id, size, source_size, target, CAST(n * size AS BIGINT) AS taken FROM emitted") -> str:
    """DuckDB SQL for :func:`query` (``tail`` may read other columns)."""
    key = "(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')))"
    draws = ", ".join(f"{uniform_sql(key, 'mix', i)}" for i in range(TRIALS))
    return f"""
    WITH sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, [{draws}] AS u FROM {documents}),
    src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight FROM sized GROUP BY source),
    caps AS (SELECT *, {MAX_RATE}.0::DOUBLE * source_size AS cap, {MAX_RATE}.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM src),
    levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
    goal AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * (SELECT min_by(level, ratio) FROM levels WHERE ratio > level) END AS target FROM levels),
    rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goal),
    joined AS (SELECT s.*, r.source_size, r.target, r.rate FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
    tried AS (SELECT source, t, floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN u[t] < (rate - floor(rate)) * 4294967296.0 THEN size ELSE 0 END) - any_value(target) AS off FROM joined, range(1, {TRIALS + 1}) r(t) GROUP BY source, t),
    best AS (SELECT source, arg_min(t, {{'m': abs(off), 't': t}}) AS t FROM tried GROUP BY source),
    emitted AS (SELECT j.*, CAST(floor(rate) + CASE WHEN u[b.t] < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM joined j JOIN best b ON j.source IS NOT DISTINCT FROM b.source)
    {tail}
    """


