"""Exact deduplication over an extendible-hash index on shared files.

The key of a text is its 64-bit hash; the leading bits of a key, looked up in
the directory, give its bucket. The directory starts with one bucket and
doubles as long as a bucket is overfull. Each bucket has one owner task, which
reads the rows dealt to it in the order of their keys, chains texts that share
a key, tells them apart by comparing bytes, and writes its range of keys as a
file of the index in the shared folder.

No number of bits splits the copies of one text. A key that alone would fill a
good part of a bucket is therefore hot: its rows are combined by the tasks that read
them (map-side, by key and bytes) and its owner gets a few rows of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import table

#: Bytes of text that a bucket may hold before it splits, and the least that is worth a task.
BUCKET_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: Most directory bits. Where they would not do (over 2 TB of text), buckets hold a share of the whole instead, and owners sort with spills.
MAX_DEPTH = 15
#: A key is hot that has over this part of all rows or of all bytes, so there are at most twice as many hot keys; and not below so many rows.
HOT_SHARE, HOT_ROWS = 1 / 16384, 64


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def _prefix(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def directory(sizes: dict[int, int], capacity: int = BUCKET_BYTES) -> list[tuple[int, int, int]]:
    """Buckets (first prefix, bits, bytes) for the bytes under each MAX_DEPTH-bit prefix.

    Splits overfull buckets by one more bit until each fits or has MAX_DEPTH bits. As splits
    depend on contents alone, this is the directory that any order of inserts gives.
    """
    done, todo = [], [(0, 0, sizes)]
    while todo:
        first, bits, held = todo.pop()
        total = sum(held.values())
        if total > capacity and bits < MAX_DEPTH:
            middle = first + (1 << (MAX_DEPTH - bits - 1))
            todo += [(first, bits + 1, {p: v for p, v in held.items() if p < middle}), (middle, bits + 1, {p: v for p, v in held.items() if p >= middle})]
        else:
            done.append((first, bits, total))
    return sorted(done)


def bucket_of(key: Column, buckets: list[tuple[int, int, int]]) -> Column:
    """The number of a key's bucket: directory lookup in an array of 2**MAX_DEPTH entries at most."""
    deepest = max(bits for _, bits, _ in buckets)
    slots: list[int] = []
    for number, (_, bits, _) in enumerate(buckets):
        slots += [number] * (1 << (deepest - bits))
    at = F.shiftrightunsigned(_prefix(key), MAX_DEPTH - deepest)
    return F.get(F.lit(slots), at)


def plan(spark: SparkSession, keyed: DataFrame) -> tuple[list[tuple[int, int, int]], DataFrame]:
    """The directory for ``keyed`` (key, bytes), and its hot keys (column hot; 2 / HOT_SHARE at most).

    Keys are counted once into a small table. Hot rows count towards a bucket's bytes once.
    """
    counts = table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")), "keys")
    rows, size = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()[:]
    is_hot = (F.col("rows") > max(HOT_ROWS, rows * HOT_SHARE)) | ((F.col("rows") > 1) & (F.col("bytes") > max(LEAST_BYTES, size * HOT_SHARE)))
    once = F.when(is_hot, F.col("bytes") / F.col("rows")).otherwise(F.col("bytes")).cast("long")
    sizes = {r["prefix"]: r["bytes"] for r in counts.groupBy(_prefix(F.col("key")).alias("prefix")).agg(F.sum(once).alias("bytes")).collect()}  # 2**MAX_DEPTH rows at most
    total = sum(sizes.values())
    share = total // (4 * spark.sparkContext.defaultParallelism)
    capacity = max(LEAST_BYTES, min(BUCKET_BYTES, share), total >> (MAX_DEPTH - 1))
    return directory(sizes, capacity), counts.filter(is_hot).select(F.col("key").alias("hot"))


def _parted(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of cold and of hot keys. The broadcast holds the hot keys, of which ``plan`` bounds the number."""
    marked = rows.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    return marked.filter("hot IS NULL").drop("hot"), marked.filter("hot IS NOT NULL").drop("hot")


def _owned(rows: DataFrame, buckets: list[tuple[int, int, int]]) -> DataFrame:
    """``rows`` with their bucket, each at the bucket's owner task, whose windows and groups then sort by key without moving rows again."""
    return rows.withColumn("bucket", bucket_of(F.col("key"), buckets)).repartitionById(len(buckets), F.col("bucket"))


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index, and the rows of hot keys (doc_id, key, text_sha256) that look themselves up in it.

    Columns: bucket, key, chain (number of the text among those that share the key), text_sha256,
    keep_id, group_size, doc_id, hot. There is a row for each row of ``docs`` with a cold
    key, and one for each distinct text with a hot key (doc_id null, hot true).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text(text).alias("text")).withColumn("key", key_of(F.col("text")))
    buckets, hot = plan(spark, rows.select("key", F.octet_length("text").cast("long").alias("bytes")))
    cold_rows, hot_rows = _parted(rows, hot)
    combined = hot_rows.groupBy("key", "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    dealt = _owned(cold_rows.select("key", "text", "doc_id", F.col("doc_id").alias("top"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("hot")).unionByName(combined.withColumn("doc_id", F.lit(None).cast(rows.schema["doc_id"].dataType)).withColumn("hot", F.lit(True))), buckets)
    # within an owner's key, the sort brings equal bytes together; the bucket is part of the key, so no row moves again
    chain = Window.partitionBy("bucket", "key").orderBy("text")
    copies = Window.partitionBy("bucket", "key", "text")
    chained = dealt.withColumn("chain", F.dense_rank().over(chain)).withColumn("keep_id", F.max("top").over(copies)).withColumn("group_size", F.sum("n").over(copies))
    entries = chained.select("bucket", "key", "chain", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size", "doc_id", "hot")
    return table(entries, "index"), hot_rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"))


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Of equal texts the largest doc_id stays; null text equals empty text, a
    null id is the smallest. Rows that repeat both id and text count as
    one document stated several times: all are marked as the kept one (use
    :func:`keep_last` to keep one row). Very long texts are compared whole; a text must fit
    one row of Spark (2 GB). An empty table gives no rows. Other columns are not read.
    """
    entries, hot_rows = index(docs, doc_id, text)
    out = ("doc_id", "keep_id", "group_size", "text_sha256")
    known = entries.filter("hot").select(F.col("key").alias("k"), F.col("text_sha256").alias("sha"), "keep_id", "group_size")  # its hot keys are bounded by plan
    looked_up = hot_rows.join(F.broadcast(known), (F.col("key") == F.col("k")) & (F.col("text_sha256") == F.col("sha")))
    found = entries.filter("NOT hot").select(*out).unionByName(looked_up.select(*out))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of each distinct text, that with the largest doc_id (of several, the largest row), with the columns of ``docs``.

    The same directory, owners and chains as :func:`index`, with the row itself carried along.
    """
    others = [c for c in docs.columns if c not in (doc_id, text)]
    row = F.struct(F.col(doc_id).alias("id"), F.col(text).isNotNull().alias("has"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = docs.select(_text(text).alias("text"), row.alias("row")).withColumn("key", key_of(F.col("text")))
    buckets, hot = plan(docs.sparkSession, rows.select("key", F.octet_length("text").cast("long").alias("bytes")))
    cold_rows, hot_rows = _parted(rows, hot)
    combined = hot_rows.groupBy("key", "text").agg(F.max("row").alias("row"))
    chains = _owned(cold_rows.select("key", "text", "row").unionByName(combined), buckets).groupBy("bucket", "key", "text").agg(F.max("row").alias("row"))
    back = {doc_id: F.col("row.id"), text: F.when(F.col("row.has"), F.col("text"))} | {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    return chains.select(*[back[c].alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return assign(docs)


SQL = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
    FROM t WINDOW g AS (PARTITION BY text)
"""
