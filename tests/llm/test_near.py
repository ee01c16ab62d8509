"""The near-dedup stage against a plain comparison of all pairs."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from geoloom.llm import near, simhash
from tests.llm.cases import SCHEMA, documents, sentence
from tests.llm.test_operators import plain_components


def plain(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_near(spark):
    r = random.Random(3)
    rows = documents()
    for i in range(40):  # near copies with some words replaced in a row: similarities around 0.8
        w = sentence(r, 100).split()
        changed = [*w[:50], *[f"z{j}" for j in range(1 + i % 14)], *w[50 + 1 + i % 14 :]]
        rows += [(1000 + 2 * i, " ".join(w), *[None] * 8), (1001 + 2 * i, " ".join(changed), *[None] * 8)]
    w = sentence(r, 60).split()  # a group of near copies that form a chain
    for i in range(40):
        rows.append((2000 + i, " ".join([*[f"y{j}" for j in range(2 * i)], *w[2 * i :]] if 2 * i < 60 else [f"y{j}" for j in range(60)]), *[None] * 8))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = [plain(x[1]) for x in rows]
    roots = plain_components(list(range(len(rows))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for x, root in zip(rows, roots, strict=True):
        least[root] = min((i for i in (least.get(root), x[0]) if i is not None), default=None)
    want = sorted(((x[0], least[root]) for x, root in zip(rows, roots, strict=True)), key=repr)
    got = near.group(docs).collect()
    assert sorted(((g.doc_id, g.component_id) for g in got), key=repr) == want
    assert sum(roots[i] != roots[i + 1] for i in range(len(documents()), len(documents()) + 80, 2)) not in (0, 40)
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    assert near.group(docs.limit(0)).count() == 0


def test_pipeline_stage(spark):
    """The stage drops a copy with similarity 0.83 whose SimHash fingerprint differs in more than 4 bits (documents 1 and 177)."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id IN (1, 6, 7, 145, 177)")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 6, 7]


def test_pipeline_stage_uses_simhash(spark):
    """The stage drops a copy whose SimHash fingerprint differs in 2 bits and whose shingles have a similarity of 0.79 (documents 452 and 794)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id IN (1, 6, 452, 794)")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 6, 452]


def test_simhash_and_shingles(spark):
    """Components over both kinds of links, also where one joins what the other left apart."""
    r = random.Random(5)
    rows = documents()
    for i in range(30):  # near copies in chains, as far apart as fingerprints or shingles just link
        w = sentence(r, 300).split()
        for j in range(4):
            rows.append((3000 + 4 * i + j, " ".join(w), *[None] * 8))
            for k in range(1 + (i + j) % 6):
                w[40 * k + 9 * j] = f"z{i}y{j}"
    for i in range(10):  # a repeated passage decides the fingerprint, the words of its own the set of shingles
        passage = sentence(r, 21)
        rows += [(4000 + 2 * i + j, f"{passage} " * 20 + sentence(r, 40), *[None] * 8) for j in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sets, fps = [plain(x[1]) for x in rows], [simhash.fingerprint(x[1]) for x in rows]
    bits = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4
    shingled = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    found = []
    for links in (bits, shingled, lambda a, b: bits(a, b) or shingled(a, b)):
        roots = plain_components(list(range(len(rows))), links)
        least = {}
        for x, root in zip(rows, roots, strict=True):
            least[root] = min((i for i in (least.get(root), x[0]) if i is not None), default=None)
        found.append(sorted(((x[0], least[root]) for x, root in zip(rows, roots, strict=True)), key=repr))
    assert found[2] not in found[:2]
    got = near.group(docs, radius=4).collect()
    assert sorted(((g.doc_id, g.component_id) for g in got), key=repr) == found[2]
    assert near.group(docs.limit(0), radius=4).count() == 0


def test_rows_keep_lists_as_arrays():
    batch = pa.RecordBatch.from_pydict({"key": [1, 2, 3], "s": pa.array([[5, 6], [], [2**62]], pa.list_(pa.int64()))})
    for b, want in ((batch, [(1, [5, 6]), (2, []), (3, [2**62])]), (batch.slice(1), [(2, []), (3, [2**62])]), (batch.slice(0, 0), [])):
        rows = list(near._rows(b))
        assert [(r["key"], r["s"].tolist()) for r in rows] == want
        assert all(r["s"].dtype == np.int64 and r["s"].base is None for r in rows)
