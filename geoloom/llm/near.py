"""Near-duplicates by SimHash, and by the Jaccard similarity of word shingles, MinHash candidates verified on the shingles.

With a radius, texts whose SimHash fingerprints differ in at most so many bits are near copies,
found by :func:`simhash.link`; these links come first, and shingles are compared
between what they have not connected.

Texts are near copies as well if their sets of five-word shingles have a similarity of
at least 0.8. Candidates share one of BANDS keys of ROWS minima each: a pair at
0.8 shares none with probability (1 - 0.8**ROWS)**BANDS, 3 in a million.
A sketch of 64 bits and the sizes discard most of the others; the rest
are verified on their whole shingle sets.

A large group of near copies is not compared pair by pair: first every member of a
key is verified against one of them, then, TURNS times at most, against other ones
where members are in different components still. What different components are
left in a key is compared pair by pair. So all pairs are either verified or connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import simhash
from geoloom.llm.common import small_batches, table
from geoloom.llm.graph import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
#: Bits in which sketches may differ: pairs at 0.8 differ in 6.4 on average, in over 20 about once in a million.
APART = 20
#: Rows that share the copies of one text in the verifying join.
SALTS = 64
#: Turns in which the members of a key are verified against one of them, before pairs of different components are.
TURNS = 2
#: Nodes of a key in a block.
BLOCK = 512

_ODD = np.random.default_rng(simhash.SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(whole, simhash.SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    n = len(words) - shingle + 1
    starts = (ends - lengths)[:n].tolist()
    return np.unique(np.fromiter((digest(whole[a:b], simhash.SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of a set under each of BANDS * ROWS permutations."""
    out = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        out = np.minimum(out, (s[at : at + 1024, None] * _ODD).min(axis=0))
    return out


def sketches(docs: DataFrame, doc_id: str, text: str, fingerprints: bool = False) -> DataFrame:
    """doc_id, text_key, node (digest of the shingle set), n (its size), sketch, bands, fp (the SimHash fingerprint, if wanted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, bits, bands, fps = [], [], [], [], []
            for t in b.column("t").to_pylist():
                s = shingles(t)
                m = minima(s)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED))
                sizes.append(len(s))
                bits.append(np.packbits((m[:64] >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.int64)[0])
                raw = m.tobytes()
                bands.append([xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)])
                fps.append(simhash.fingerprint(t) if fingerprints else 0)
            flat = pa.array(np.array(bands, np.uint64).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(bits, np.int64)), lists, pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["doc_id", "text_key", "node", "n", "sketch", "bands", "fp"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, n int, sketch long, bands array<long>, fp long")


def similar(rows: DataFrame, radius: int) -> DataFrame:
    """Links u, v between nodes of ``rows`` (node, fp) that connect all whose fingerprints differ in at most ``radius`` bits.

    A fingerprint stands for the least node that has it; its other nodes are linked to that one.
    """
    named = table(rows.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "fingerprints")
    several = table(named.filter("first <> last").select(F.col("fp").alias("f"), "first"), "several")
    same = rows.select("fp", "node").distinct().join(several, F.col("fp") == F.col("f")).filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    at = lambda x: named.select(F.col("fp").alias(f"f{x}"), F.col("first").alias(f"n{x}"))
    between = table(simhash.link(named.select("fp"), radius), "links").join(at("u"), F.col("u") == F.col("fu")).join(at("v"), F.col("v") == F.col("fv")).select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    return same.union(between.filter("u <> v")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs u, v whose texts (node, t) have SIMILARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str | None, np.ndarray] = {}  # of the texts that repeat in a batch
            good = []
            for x, y in zip(b.column("t").to_pylist(), b.column("o").to_pylist(), strict=True):
                if x not in known:
                    known = {x: shingles(x)}
                good.append(similarity(known[x], shingles(y)) >= SIMILARITY)
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    # a node with very many partners has its text in SALTS rows at most, and they are dealt by both
    first = dealt.select("u", "salt").distinct().join(texts.select(F.col("node").alias("u"), "t"), "u")
    second = texts.select(F.col("node").alias("v"), F.col("t").alias("o"))
    other = dealt.select("v", "u", "salt").join(second, "v")
    return other.join(first, ["u", "salt"]).select("u", "v", "t", "o").mapInArrow(run, "u long, v long")


def sets_of(texts: DataFrame) -> DataFrame:
    """node, sketch, bands, s (the sorted shingle hashes) of ``texts`` (node, t, sketch, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x).view(np.int64) for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("sketch"), b.column("bands"), pa.array(found, pa.list_(pa.int64()))], ["node", "sketch", "bands", "s"])

    return texts.select("node", "sketch", "bands", "t").mapInArrow(run, "node long, sketch long, bands array<long>, s array<long>")


class _Members:
    """The members of a block of a key, and which of them a query is a near copy of."""

    def __init__(self, rows: list[dict]) -> None:
        self.node = np.array([r["node"] for r in rows], np.int64)
        self.comp = np.array([r["comp"] for r in rows], np.int64)
        self.sketch = np.array([r["sketch"] for r in rows], np.int64)
        self.bands = np.array([r["bands"] for r in rows], np.int64)
        self.sets = [r["s"].view(np.uint64) for r in rows]
        self.n = np.array([len(s) for s in self.sets])

    def near(self, q: dict) -> np.ndarray:
        s, bands = q["s"].view(np.uint64), q["bands"]
        n = len(s)
        band = int(np.flatnonzero(bands == q["key"])[0])
        # a pair is compared once: in the first key it shares, and of two outside the largest component by the larger node
        ok = (self.comp != q["comp"]) & ((self.comp == q["big"]) | (self.node < q["node"]))
        ok &= np.minimum(self.n, n) >= SIMILARITY * np.maximum(self.n, n)
        ok &= np.bitwise_count(self.sketch ^ np.int64(q["sketch"])) <= APART
        ok &= ~(self.bands[:, :band] == bands[:band]).any(axis=1)
        at = np.flatnonzero(ok)
        if not len(at):
            return at
        flat = np.concatenate([self.sets[i] for i in at])
        ends = np.cumsum(self.n[at])
        hit = s[np.minimum(np.searchsorted(s, flat), n - 1)] == flat
        both = np.diff(np.concatenate([[0], np.cumsum(hit)[ends - 1]]))
        return at[both >= SIMILARITY * (n + self.n[at] - both)]


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one; lists stay numpy arrays, as a Python number takes several times its eight bytes."""
    lists = [c for c in b.schema.names if pa.types.is_list(b.schema.field(c).type)]
    plain = b.drop_columns(lists).to_pylist()
    flat = {c: (b.column(c).values.to_numpy(), b.column(c).offsets.to_numpy()) for c in lists}
    for i, r in enumerate(plain):
        # copies, as a view would keep its whole batch
        yield r | {c: v[at[i] : at[i + 1]].copy() for c, (v, at) in flat.items()}


def across(shared: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links u, v of the same key between different components, of all pairs that have not been connected.

    Queries are the nodes outside a key's largest component. A key's members are dealt to blocks of some BLOCK
    nodes, and every query passes each block; only near copies leave the task, so pairs are never rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, members = None, [], None
        for b in batches:
            u, v = [], []
            for r in _rows(b):
                if (r["key"], r["block"]) != group:
                    group, rows, members = (r["key"], r["block"]), [], None
                if r["role"] == 0:
                    rows.append(r)
                elif rows:
                    members = members or _Members(rows)
                    for node in members.node[members.near(r)].tolist():
                        u.append(min(node, r["node"]))
                        v.append(max(node, r["node"]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    placed = shared.select("key", "node").join(comps.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    keys = sizes.groupBy(F.col("key").alias("k")).agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"), F.max_by("comp", F.struct("c", "comp")).alias("big"), F.count(F.lit(1)).alias("kinds"))
    here = table(placed.join(table(keys.filter("kinds > 1").drop("kinds"), "keys"), F.col("key") == F.col("k")).drop("k"), "mixed")
    sets = table(sets_of(texts.join(here.select("node").distinct(), "node", "left_semi")), "sets")
    members = here.withColumn("role", F.lit(0)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    queries = here.filter("comp <> big").withColumn("role", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = members.unionByName(queries).drop("blocks").join(sets, "node")
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "role", "node").mapInArrow(run, "u long, v long").distinct()


def mixed(shared: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """The rows of ``shared`` whose key still has nodes of different components, with comp and pivot, a member that differs by key and turn."""
    placed = shared.drop("rep").join(comps.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
    member = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "n", "sketch", "comp")
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(member).alias("pivot")).filter("low <> high").select(F.col("key").alias("k"), "pivot")
    return placed.join(table(several, "several"), F.col("key") == F.col("k")).drop("k")


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after ``links`` (u, v) between nodes; only the components linked now are searched."""
    c = lambda x: comps.select(F.col("node").alias(f"_{x}"), F.col("comp").alias(f"c{x}"))
    between = links.join(c("u"), F.col("u") == F.col("_u")).join(c("v"), F.col("v") == F.col("_v")).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    roots = components(between).withColumnRenamed("node", "of")
    return table(comps.join(roots, F.col("comp") == F.col("of"), "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int | None = None) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits of the shingle set), component_id for every row, as :func:`simhash.group`.

    Links are a similarity of the shingles and, with a ``radius``, SimHash fingerprints at most so many bits apart.
    """
    with small_batches(docs.sparkSession):
        return _group(docs, doc_id, text, radius)


def _group(docs: DataFrame, doc_id: str, text: str, radius: int | None) -> DataFrame:
    rows = table(sketches(docs, doc_id, text, radius is not None), "sketches")
    # rows of one node are one set; a key that only one node has links nothing, and map-side sums find the others
    keyed = rows.select("node", "n", "sketch", F.explode("bands").alias("key")).distinct()
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.struct("node", "n", "sketch")).alias("rep")).filter("low <> high").select(F.col("key").alias("k"), "rep")
    several = table(several, "several")  # so that the join is a plain one, split where a key is frequent
    shared = table(keyed.join(several, F.col("key") == F.col("k")).drop("k"), "shared")
    wanted = rows.select("node", "doc_id", "text_key", "sketch", "bands").join(shared.select("node").distinct(), "node", "left_semi")
    one = wanted.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")).select("node", "sketch", "bands", F.col("r.doc_id").alias("d"), F.col("r.text_key").alias("k"))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    texts = given.join(one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).select("node", "t", "sketch", "bands")
    texts = table(texts.dropDuplicates(["node"]), "texts")

    close = lambda rep: (F.bit_count(F.col("sketch").bitwiseXOR(F.col(f"{rep}.sketch"))) <= APART) & (F.least("n", f"{rep}.n") >= SIMILARITY * F.greatest("n", f"{rep}.n"))
    pair = lambda rep: (F.least("node", f"{rep}.node").alias("u"), F.greatest("node", f"{rep}.node").alias("v"))
    tried = table(shared.filter((F.col("node") != F.col("rep.node")) & close("rep")).select(*pair("rep")).distinct(), "tried")
    linked = shared.select("node")
    if radius is not None:
        near = table(similar(rows, radius), "similar")
        linked = linked.union(near.select("u")).union(near.select("v"))
    comps = table(linked.distinct().withColumn("comp", F.col("node")), "components")
    if radius is not None:
        comps = merged(comps, near)
    comps = merged(comps, table(verified(tried, texts), "links"))
    for turn in range(TURNS):
        here = mixed(shared, comps, turn).filter((F.col("comp") != F.col("pivot.comp")) & close("pivot"))
        some = table(here.select(*pair("pivot")).distinct().join(tried, ["u", "v"], "left_anti"), "tried")
        links = table(verified(some, texts), "links")
        if not links.limit(1).count():
            break
        tried, comps = tried.union(some), merged(comps, links)
    comps = merged(comps, table(across(shared, comps, texts), "across"))
    roots = comps.select("node", F.col("comp").alias("root"))

    nodes = rows.groupBy(F.col("node").alias("fp")).agg(F.min("doc_id").alias("first"))
    label = simhash.labelled(nodes, roots).withColumnRenamed("fp", "node")
    return rows.select("doc_id", "text_key", "node").join(label, "node").select("doc_id", "text_key", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int | None = None) -> DataFrame:
    """One document of each component, as :func:`simhash.keep_first` chooses it."""
    return simhash.first_of(docs, group(docs, doc_id, text, radius), doc_id, text)
