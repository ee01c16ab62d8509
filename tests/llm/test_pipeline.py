"""The pipeline against a plain version of its stages."""

import sys
from collections import Counter
from pathlib import Path

from geoloom.llm import bpe, mixing, quality
from tests.llm.cases import SCHEMA, documents
from tests.llm.test_near import plain
from tests.llm.test_operators import counts, plain_components

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


def test_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns pass every stage; an empty table gives an empty result."""
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], documents()):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name.startswith("bpe") or out.columns == docs.columns
            out.write.mode("overwrite").parquet(path := str(tmp_path / f"{len(rows)}-{name.replace(' ', '-')}"))
            docs = spark.read.parquet(path)
        assert (docs.count() == 0) == (not rows)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    rules = quality.learn(quality.sample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    judged = {r.doc_id: r for r in quality.judge(docs, rules).collect()}
    kept = [r for r in rows if not counts(r.text)[-1] and judged[r.doc_id].rule is None]
    last = {}
    for r in kept:
        if r.text not in last or last[r.text].doc_id < r.doc_id:
            last[r.text] = r
    kept = sorted(last.values(), key=lambda r: r.doc_id)
    roots = plain_components([plain(r.text) for r in kept], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    kept = [r for i, r in enumerate(kept) if roots[i] == i]
    left = spark.createDataFrame(kept, docs.schema)
    taken = Counter(r.doc_id for r in mixing.mix(left).collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(path)
    assert Counter(r.doc_id for r in docs.collect()) == taken
    got = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in got.collect()) == taken
    assert got.columns == bpe.encode(left).columns
