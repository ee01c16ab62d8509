"""What Python workers hold at once, and after a task."""

import pyarrow as pa

from geoloom.llm import bpe, common, near
from tests.llm.cases import SCHEMA, documents

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_near_sends_small_batches(spark, monkeypatch):
    """Every table of the near-dedup stage is written with small batches, and the session keeps its own setting."""
    seen = []

    def noted(df, name):
        seen.append(spark.conf.get(LIMIT))
        return common.table(df, name)

    monkeypatch.setattr(near, "table", noted)
    spark.conf.set(LIMIT, "12345678")
    try:
        near.group(spark.createDataFrame(documents(), SCHEMA), radius=4)
        assert spark.conf.get(LIMIT) == "12345678"
    finally:
        spark.conf.unset(LIMIT)
    assert seen and set(seen) == {str(common.BATCH_BYTES)}


def test_small_batches(spark):
    """Rows of 4,000 bytes arrive in batches of some BATCH_BYTES; none is lost."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    with common.small_batches(spark):
        got = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 4000) AS t").mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 3000
    assert max(r.bytes for r in got) < 1.1 * common.BATCH_BYTES


def test_encoder_forgets(spark):
    """After an encoding task its worker remembers no words."""
    path = bpe.default_path()
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(4)
    assert bpe.encode(docs).count() == len(documents())
    bpe.encode(docs).collect()

    def known(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.encoder(path).memo)] * b.num_rows)], ["n"])

    got = spark.range(16, numPartitions=16).mapInArrow(known, "n long").collect()
    assert [r.n for r in got] == [0] * 16
