"""SimHash near-duplicates by the generalised pigeonhole principle.

If two fingerprints differ in at most r bits and the 64 bits are cut into m
parts with thresholds t_i that sum to r - m + 1, then some part differs in at
most t_i bits (t_i = -1: the part is not probed). Bits that vary together
share a part; dynamic programming on the estimated number of candidates picks
the thresholds. A part with t_i > 0 is probed with every choice of t_i bits masked
out, so that candidates always share an exact key and meet in a sort instead
of a join; each is then verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, table
from geoloom.llm.graph import components

SEED, BITS = 42, 64
#: Parts of a component that are dealt to different tasks; fingerprints sampled to estimate candidates (this decides costs only, no result).
SALTS, SAMPLED = 64, 4096
#: Seconds for a probed key and for a compared pair, to weigh one against the other.
PROBE_S, PAIR_S = 1.5e-6, 1e-8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text's word shingles, counted with repeats; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), fp (the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and, for each pair of bits, how many have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            ones = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64)
            total += len(ones)
            both += ones.T @ ones
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), total).astype(np.int64))], ["at", "n"])

    found = fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in found:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def arrange(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` parts: each part starts with the least free bit and takes the free bits that vary most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-18))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    free, parts = list(range(BITS)), []
    for i in range(m):
        want = len(free) // (m - i)
        part = [free.pop(0)]
        while len(part) < want:
            part.append(free.pop(int(np.argmax(phi[np.ix_(part, free)].sum(axis=0)))))
        parts.append(sorted(part))
    return parts


def allocate(cost: Callable[[int, int], float], m: int, radius: int, most: int = 2) -> tuple[float, list[int]]:
    """Thresholds -1 to ``most`` for ``m`` parts that sum to radius - m + 1 at the least cost(part, threshold)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        then: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, most + 1):
                new = c + (cost(i, t) if t >= 0 else 0.0)
                if total + t not in then or new < then[total + t][0]:
                    then[total + t] = new, [*ts, t]
        best = then
    return best.get(radius - m + 1, (float("inf"), []))


def sample(fps: DataFrame, most: int = SAMPLED) -> np.ndarray:
    """At most ``most`` of the distinct fingerprints, those with the least hashes."""
    found = fps.select("fp").orderBy(F.xxhash64("fp")).limit(most).toArrow().column("fp")
    return found.to_numpy().view(np.uint64)


def agreeing(seen: np.ndarray, bits: list[int], most: int = 2) -> np.ndarray:
    """The pairs of ``seen`` that differ in 0, 1, … ``most`` of ``bits``."""
    x = seen & np.uint64(sum(1 << b for b in bits))
    out = np.zeros(most + 1)
    for i in range(0, len(x), 256):
        apart = np.bitwise_count(x[i : i + 256, None] ^ x[None, :])
        out += [np.count_nonzero(apart == d) for d in range(most + 1)]
    out[0] -= len(x)  # with itself
    return out / 2


def plan(n: int, both: np.ndarray, radius: int, seen: np.ndarray) -> list[tuple[list[int], int]]:
    """Parts (their bits) and thresholds with the least estimated work for ``n`` fingerprints.

    A pair that differs in d <= t bits of a part of b bits shares C(b - d, t - d) of the keys with t bits
    masked. Such pairs are counted among ``seen``, a sample, as bits of a part vary together.
    Below what a sample can show, bit i of two fingerprints agrees with probability
    a_i = p² + (1 - p)² and the estimate is the product over the part, which is a lower bound for correlated bits.
    """
    p = np.diag(both) / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    whole = n * n / 2
    scale = whole / max(len(seen) * (len(seen) - 1) / 2, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, radius + 3):
        parts = arrange(n, both, m)
        counted = [agreeing(seen, part) for part in parts]

        def cost(i: int, t: int, parts: list[list[int]] = parts, counted: list[np.ndarray] = counted) -> float:
            a = agree[parts[i]]
            e = np.zeros(t + 1)  # elementary symmetric sums of 1 / a
            e[0] = 1
            for x in 1 / a:
                e[1:] += x * e[:-1].copy()
            shown = scale * sum(counted[i][d] * comb(len(a) - d, t - d) for d in range(t + 1))
            return n * comb(len(a), t) * PROBE_S + max(whole * float(np.prod(a)) * e[t], shown) * PAIR_S

        c, ts = allocate(cost, m, radius)
        if c < best[0]:
            best = c, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]
    return best[1]


def keys(fp: Column, parts: list[tuple[list[int], int]]) -> Column:
    """Every key of a fingerprint: the number of a mask and the fingerprint's bits under it."""
    out = []
    for bits, t in parts:
        for masked in combinations(bits, t):
            mask = sum(1 << b for b in bits if b not in masked)
            out.append(F.struct(F.lit(len(out)).alias("mask"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v")))
    return F.array(*out)


def run_links(x: np.ndarray, radius: int, block: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked within ``x`` (distinct uint64), in bounded memory.

    Small runs are compared at once. In others each fingerprint is compared with those not
    reached yet, and what it reaches leaves them: a dense cluster costs little
    more than its size, and no more links are made than there are fingerprints.
    """
    out = []
    if len(x) <= block:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        if np.count_nonzero(near) <= 5 * len(x):
            a, b = np.nonzero(np.triu(near, 1))
            return [(x[a], x[b])] if len(a) else []
    rest = x
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            here = todo.pop()
            hit = np.bitwise_count(rest ^ here) <= radius
            if hit.any():
                found = rest[hit]
                out.append((np.full(len(found), here), found))
                todo.extend(found)
                rest = rest[~hit]
    return out


def _link(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u = np.concatenate([a for a, _ in links]).view(np.int64)
        v = np.concatenate([b for _, b in links]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def of(mask: np.ndarray, v: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of complete runs of equal keys."""
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (v[1:] != v[:-1])) + 1
        edges = np.concatenate([[0], new, [len(x)]])
        links: list[tuple[np.ndarray, np.ndarray]] = []
        made = 0
        for i in np.flatnonzero(np.diff(edges) > 1):
            found = run_links(x[edges[i] : edges[i + 1]], radius)
            links += found
            made += sum(len(a) for a, _ in found)
            if made > 100_000:
                yield emit(links)
                links, made = [], 0
        if links:
            yield emit(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "v", "fp"))
            last = len(now[0]) - 1
            if held and (held[-1][0][-1], held[-1][1][-1]) == (now[0][last], now[1][last]) == (now[0][0], now[1][0]):
                held.append(now)
                continue
            mask, v, x = (np.concatenate([h[k] for h in [*held, now]]) for k in range(3))
            cut = len(x)
            while cut and mask[cut - 1] == mask[-1] and v[cut - 1] == v[-1]:
                cut -= 1
            if cut:
                yield from of(mask[:cut], v[:cut], x[:cut].view(np.uint64))
            held = [(mask[cut:], v[cut:], x[cut:])]
        if held:
            mask, v, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            yield from of(mask, v, x.view(np.uint64))

    return run


def link(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links u, v between the distinct fingerprints ``fp`` that connect all within ``radius`` bits."""
    parts = plan(*bit_counts(fps), radius, sample(fps))
    probes = fps.select("fp", F.explode(keys(F.col("fp"), parts)).alias("k")).select("k.mask", "k.v", "fp")
    return probes.repartition("mask", "v").sortWithinPartitions("mask", "v").mapInArrow(_link(radius), "u long, v long")


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """fp, component_id (the least ``first`` of its component) for ``nodes`` (fp, first); ``roots`` (node, root) has those with links.

    Nodes without links are done at once. Of the others each root's least id is
    repeated for SALTS parts of its nodes, so a component with a third of all nodes is dealt to many tasks.
    """
    named = table(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "root"), "named")
    linked = named.filter("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    part = linked.groupBy("root", "salt").agg(F.min("first").alias("component_id"))
    least = part.groupBy("root").agg(F.min("component_id").alias("component_id"), F.collect_set("salt").alias("salts"))
    spread = least.select("root", "component_id", F.explode("salts").alias("salt"))
    found = linked.join(spread, ["root", "salt"]).select("fp", "component_id")
    return found.union(named.filter("root IS NULL").select("fp", F.col("first").alias("component_id")))


def group(docs: DataFrame, radius: int = 4, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits), component_id for every row.

    Very long texts are hashed in blocks of shingles; other columns are not read.
    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id
    is the smallest doc_id reachable, null where all have none. Null and empty
    texts have fingerprint zero and are linked like any other. Rows that
    repeat share their component. An empty table gives no rows.
    """
    rows = table(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    fps = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(link(fps, radius))
    label = labelled(fps, roots)
    return rows.join(label, "fp").select("doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with the columns of ``docs``: the smallest doc_id, then the least text hash.

    Rows without an id stay only where no row of their component has one. Rows that repeat id and
    text are one document; all of them stay (exact deduplication comes first).
    """
    return first_of(docs, group(docs, radius, shingle, doc_id, text), doc_id, text)


def first_of(docs: DataFrame, grouped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`keep_first` keeps of the components in ``grouped`` (as :func:`group` gives them)."""
    ranked = grouped.select(F.col("component_id").alias("c"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"), "doc_id", "text_key")
    ranked = ranked.filter(F.col("doc_id").eqNullSafe(F.col("c")))
    key, c, k = fresh(docs, "key", "c", "k")
    kept = ranked.groupBy("c", "f").agg(F.min("text_key").alias(k)).select(F.col("c").alias(c), k).distinct()
    d = docs.withColumn(key, F.xxhash64(F.col(text)))
    return d.join(kept, F.col(doc_id).cast("long").eqNullSafe(F.col(c)) & (F.col(key) == F.col(k)), "left_semi").drop(key)


def query(docs: DataFrame) -> DataFrame:
    return group(docs).select("doc_id", "fingerprint", "component_id")


