"""Rendezvous hashing of records over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, uniform, uniform_sql

#: Rows that one numbering task should get, and the most parts of a shard.
ROWS_PER_PART, MAX_PARTS, MIN_PARTS = 1_000_000, 4096, 32


def record_key(doc_id: Column, text: Column) -> Column:
    """A record's id as text; a record without an id is keyed by its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256)))


def _scores(key: Column, weights: Sequence[float]) -> list[Column]:
    draws = uniform(key, "shard", len(weights))
    return [F.struct((-F.log((u + 0.5) / 4294967296.0) / F.lit(float(w))).alias("s"), F.lit(j).alias("j")) for j, (u, w) in enumerate(zip(draws, weights, strict=True))]


def best(key: Column, weights: Sequence[float]) -> Column:
    """The least score s of ``key`` among the shards, and the shard j that has it.

    Shard j's draw u in (0, 1) scores ``-ln(u) / weight``; the lower shard wins
    a tie. A draw depends on the key and j alone, so an added shard can only
    win records, never move one between old shards, and each shard expects
    a share in proportion to its weight.
    """
    scores = _scores(key, weights)
    return F.least(*scores) if len(scores) > 1 else scores[0]


def shard(docs: DataFrame, weights: Sequence[float], grown: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard and its slot there.

    Adds nothing to ``docs``; returns doc_id, size (UTF-8 bytes of the text
    plus 16), text_crc32, law, shard, slot, grown_shard. Null text counts as
    empty (size 16, CRC 0). Rows without an id are keyed by their text. Rows
    that repeat an id go to the same shard and take consecutive slots in the
    order of checksum and size. An empty table gives no rows. Slots count from
    0 without gaps: a shard is numbered in parts (a bounded number, by a draw
    on the key), each part after the rows of the parts before it, so no task
    numbers a whole shard.

    grown: weight of one further shard; null skips grown_shard.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    key = record_key(F.col(doc_id), F.col(text))
    base = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"))
    n_parts = F.least(F.lit(MAX_PARTS), F.greatest(F.lit(MIN_PARTS), F.ceil(F.col("n") / F.lit(float(ROWS_PER_PART * len(weights)))).cast("int")))
    parts = docs.select(F.count(F.lit(1)).alias("n")).select(n_parts.alias("parts"))
    further = F.lit(None).cast("int")
    if grown is not None:
        rival = _scores(F.col("key"), [*weights, grown])[-1]
        further = F.when(rival["s"] < F.col("best.s"), rival["j"]).otherwise(F.col("best.j"))
    placed = base.withColumn("best", best(F.col("key"), weights)).crossJoin(F.broadcast(parts)).select(
        "doc_id", "size", "text_crc32",
        F.col("best.j").alias("shard"),
        further.alias("grown_shard"),
        (uniform(F.col("key"), "part", 1)[0] % F.col("parts")).cast("int").alias("part"),
    )
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_PARTS rows for each shard
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(inner) - 1).join(F.broadcast(starts), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def with_shard(docs: DataFrame, weights: Sequence[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the column ``shard`` (under another name if it is taken)."""
    name = "shard" if "shard" not in docs.columns else fresh(docs, "shard")[0]
    return docs.withColumn(name, best(record_key(F.col(doc_id), F.col(text)), weights)["j"])


def query(docs: DataFrame, shards: int = 40) -> DataFrame:
    return shard(docs, [1.0] * shards, grown=1.0)


def sql(shards: int = 40) -> str:
    """DuckDB SQL for :func:`query`."""
    key = "coalesce(CAST(doc_id AS VARCHAR), 'text:' || sha256(coalesce(text, '')))"

    def pick(n: int) -> str:
        scores = ", ".join(f"{{'s': -ln(({uniform_sql('key', 'shard', j)} + 0.5) / 4294967296.0), 'j': {j}}}" for j in range(n))
        return f"CAST(least({scores}).j AS INTEGER)"

    # DuckDB has no CRC-32: the table of the polynomial 0xEDB88320 and a fold over the bytes
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)"
    return f"""
    WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(0, 256) r(i) UNION ALL SELECT i, {step}, k + 1 FROM bits WHERE k < 8),
    tabs AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS tab FROM bits WHERE k = 8),
    k AS (SELECT doc_id, coalesce(text, '') AS text, {key} AS key FROM documents),
    p AS (SELECT least({MAX_PARTS}, greatest({MIN_PARTS}, ceil(count(*) / {float(ROWS_PER_PART * shards)}))) AS parts FROM documents),
    s AS (SELECT doc_id, octet_length(encode(text)) + 16 AS size, {crc} AS text_crc32, {pick(shards)} AS shard, {pick(shards + 1)} AS grown_shard, {uniform_sql("key", "part", 0)} % CAST(parts AS BIGINT) AS part FROM k, p, tabs)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id) - 1 AS slot, grown_shard FROM s
    """


