"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes after which a batch of rows goes to a Python worker. Spark's 64 MB are held several times, by the worker and outside the heap.
BATCH_BYTES = 1 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once.

    A plain column reference may be inlined by the optimizer at each use; a
    lambda variable is computed once however often the body names it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a session on one
    machine (``local[…]``) without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="geoloom-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks that read the table, not
    the work that made it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoloom-{uuid.uuid4().hex}/{name}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a :func:`table` that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Has a session's setting at ``value`` for what runs within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Has Spark remove the shuffle files of each query that ends within, as its result is written."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Has Spark send BATCH_BYTES at a time to Python workers, in what is written within."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def uniform(key: Column, salt: str, n: int) -> list[Column]:
    """``n`` independent whole numbers below 2**32 drawn from ``key``.

    One MD5 yields four, so both Spark and any SQL engine with MD5 agree.
    """
    out = []
    for i in range(n):
        digest = F.md5(F.concat(key, F.lit(f":{salt}:{i // 4}")).cast("binary"))
        out.append(F.conv(F.substring(digest, 8 * (i % 4) + 1, 8), 16, 10).cast("long"))
    return out


def uniform_sql(key: str, salt: str, i: int) -> str:
    """DuckDB's form of ``uniform(key, salt, …)[i]``."""
    return f"CAST('0x' || substr(md5({key} || ':{salt}:{i // 4}'), {8 * (i % 4) + 1}, 8) AS BIGINT)"
