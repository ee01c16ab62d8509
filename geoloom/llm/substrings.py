"""Removal of repeated word passages by seed and extend.

A window is LENGTH consecutive words of one document. Every k-gram of words
has a hash; the anchor of a window is its last k-gram with the least hash, so
equal windows have equal anchors at equal places (winnowing). Anchors that
occur twice seed the search: each is extended both ways over all windows that
it anchors, to a segment. Equal segments need no comparison of their
windows; only the distinct segments of an anchor are compared window by window.
Windows that start earlier elsewhere are merged to maximal repeats and their
words removed.

Words, segments and windows are compared by hashes: two places count as equal
if 48 bits of their anchor and 64 bits of the segment or window agree. Among n
of them a false match has a probability below n**2 / 2**113, that is 1 in 10,000
for 10**15 windows; two words of a corpus that share their 64 bits matter only
between the same 19 neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import table

LENGTH, GRAM = 20, 6
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values: a polynomial over mixed values, by doubling."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * _MIX
        out, done, power = None, 0, x  # power: hashes of 2**i values
        width, shift = 1, _ODD
        while k:
            if k & 1:
                n = len(h) - (done + width) + 1
                part = power[done : done + n]
                out = part.copy() if out is None else out[:n] * shift + part
                done += width
            k >>= 1
            if k:
                power = power[: len(power) - width] * shift + power[width:]
                width, shift = width * 2, shift * shift
        return out ^ (out >> np.uint64(29))


def anchors(h: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the anchors: their hashes, their places, the first window of each and its number of windows."""
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    g = _rolling(h, gram)
    span = length - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.concatenate([span - 1 - np.argmin(views[i : i + 65536, ::-1], axis=1) + np.arange(i, min(i + 65536, len(views))) for i in range(0, len(views), 65536)])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    return g[at[first]], at[first], first, count


#: Bits of an anchor's hash; segments are told apart by 64 bits more.
ANCHOR_BITS = np.uint64((1 << 48) - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _segment(h: np.ndarray, first: int, count: int) -> int:
    """Hash of the words that the windows of an anchor cover."""
    return xxhash.xxh64_intdigest(h[first : first + count - 1 + LENGTH].tobytes()) - (1 << 63)


def _frequent(docs: DataFrame) -> DataFrame:
    """b: the anchors of (doc_id, t) that occur twice or more; sums within a batch and map-side make a frequent one cheap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(_hashes(_words(t)))[0] & ANCHOR_BITS for t in b.column("t").to_pylist()]
            if found:
                a, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(a), pa.array(n)], ["a", "n"])

    return docs.select("t").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").select(F.col("a").alias("b"))


def _seeds(docs: DataFrame) -> DataFrame:
    """a (anchor), s (its segment), doc_id, at (place) for every anchor of (doc_id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, s, d, at = [], [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                h = _hashes(_words(t))
                g, p, first, count = anchors(h)
                a.append(g & ANCHOR_BITS)
                s.append(np.fromiter((_segment(h, f, c) for f, c in zip(first.tolist(), count.tolist(), strict=True)), np.int64, len(p)))
                at.append(p)
                d.append(np.full(len(p), i))
            if a:
                rows = pa.array(np.concatenate(d))
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(a)), pa.array(np.concatenate(s)), b.column("doc_id").take(rows), pa.array(np.concatenate(at).astype(np.int32))], ["a", "s", "doc_id", "at"])

    return docs.select("doc_id", "t").mapInArrow(run, "a long, s long, doc_id long, at int")


def _squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, t) with the text compressed, for exchanges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(z, pa.binary())], ["doc_id", "k", "z"])

    return docs.mapInArrow(run, "doc_id long, k long, z binary")


def _text(z: bytes | None) -> str | None:
    return None if z is None else zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _strike(words: list[bytes], cuts: list) -> tuple[int, list[bytes]]:
    """How many words the spans in ``cuts`` cover, and the others."""
    if not cuts:
        return 0, words
    change = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(cuts, np.int64)
    np.add.at(change, at[:, 0], 1)
    np.add.at(change, at[:, 1], -1)
    gone = (np.cumsum(change[:-1]) > 0).tolist()
    stay = [w for w, g in zip(words, gone, strict=True) if not g]
    return len(words) - len(stay), stay


_RESULT = "doc_id long, k long, n_words long, n_removed long, kept_sha256 string, kept string"
_SPANS = pa.list_(pa.list_(pa.int32()))


def _extend(docs: DataFrame, texts: bool) -> DataFrame:
    """Results and segments of (doc_id, k, z, found: repeated anchors as at, a, open).

    An anchor that has one segment everywhere (not open) and isn't its first
    loses all its windows at once. A document without open anchors is done: its row
    has the result. Others keep z and the cuts so far, and give a row for each
    open anchor's segment: a, s, start, w (hashes of its windows).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("row", "n_words", "n_removed", "kept_sha256", "kept", "z", "cut", "a", "s", "start", "w")}

            def put(i: int, out: dict[str, list] = out, **values: object) -> None:
                for c, v in out.items():
                    v.append(i if c == "row" else values.get(c))

            for i, (z, found) in enumerate(zip(b.column("z").to_pylist(), b.column("found").to_pylist(), strict=True)):
                words = _words(_text(z))
                cuts, again = [], []
                if found:
                    h = _hashes(words)
                    g, places, first, count = anchors(h)
                    mine = {int(p): j for j, p in enumerate(places)}
                    for f in found:
                        j = mine.get(f["at"])
                        if j is None or int(g[j] & ANCHOR_BITS) != f["a"]:  # of another text with this id
                            continue
                        if f["open"]:
                            again.append(j)
                        else:
                            cuts.append([int(first[j]), int(first[j] + count[j]) - 1 + LENGTH])
                if not again:
                    n, stay = _strike(words, cuts)
                    put(i, n_words=len(words), n_removed=n, kept_sha256=_digest(stay), kept=b" ".join(stay).decode("utf-8", "surrogatepass") if texts and n else None)
                    continue
                put(i, z=z, cut=cuts)
                whole = _rolling(h, LENGTH).view(np.int64)
                for j in again:
                    f, c = int(first[j]), int(count[j])
                    put(i, a=int(g[j] & ANCHOR_BITS), s=_segment(h, f, c), start=f, w=whole[f : f + c])
            at = pa.array(out["row"], pa.int64())
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string(), "z": pa.binary(), "cut": _SPANS, "a": pa.int64(), "s": pa.int64(), "start": pa.int32(), "w": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("k").take(at), *[pa.array(out[c], kind) for c, kind in kinds.items()]], ["doc_id", "k", *kinds])

    return docs.mapInArrow(run, f"{_RESULT}, z binary, cut array<array<int>>, a long, s long, start int, w array<long>")


def _finish(docs: DataFrame, texts: bool) -> DataFrame:
    """Results of (doc_id, k, z, cut, late: more spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for z, cut, late in zip(*(b.column(c).to_pylist() for c in ("z", "cut", "late")), strict=True):
                words = _words(_text(z))
                n, stay = _strike(words, (cut or []) + (late or []))
                for to, v in zip(rows, (len(words), n, _digest(stay), b" ".join(stay).decode("utf-8", "surrogatepass") if texts and n else None), strict=True):
                    to.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), *[pa.array(r, kind) for r, kind in zip(rows, kinds, strict=True)]], ["doc_id", "k", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.mapInArrow(run, _RESULT)


def _places(docs: DataFrame) -> DataFrame:
    """The places of the anchors that occur twice or more.

    The texts are hashed for the counts and again for the places: a table of all
    places would cost more disk than the second pass costs time.
    """
    frequent = table(_frequent(docs), "frequent")  # so that the join is a plain one, split where an anchor is frequent
    return table(_seeds(docs).join(frequent, F.col("a") == F.col("b"), "left_semi"), "places")


def _found(places: DataFrame) -> DataFrame:
    """d2 (doc_id) and found: what there is to do at its repeated anchors.

    What is known of an anchor is a table of its own, so that the join is a
    plain one, whose parts adaptive execution may split where an anchor is frequent.
    """
    each = table(places.groupBy("a").agg(F.min(F.struct("doc_id", "at")).alias("first"), (F.min("s") != F.max("s")).alias("open")).withColumnRenamed("a", "b"), "anchors")
    todo = places.join(each, F.col("a") == F.col("b")).filter(F.col("open") | (F.struct("doc_id", "at") != F.col("first")))
    # of one document: bounded by its text
    return todo.groupBy(F.col("doc_id").alias("d2")).agg(F.collect_list(F.struct("at", "a", "open")).alias("found"))


def _late(segments: DataFrame) -> DataFrame:
    """d2, k2 and late: spans to remove in the windows of open anchors."""
    # the first place of each distinct segment; its window hashes are a function of it
    distinct = table(segments.groupBy("a", "s").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.first("w").alias("w")), "distinct")
    windows = distinct.select("a", "s", F.posexplode("w").alias("i", "v"), "first").select("a", "s", "i", "v", F.struct(F.col("first.doc_id").alias("doc_id"), (F.col("first.start") + F.col("i")).alias("start")).alias("here"))
    earliest = windows.groupBy("a", "v").agg(F.min("here").alias("least"))
    late = windows.join(earliest, ["a", "v"]).filter("here <> least").groupBy("a", "s").agg(F.collect_list("i").alias("late"))  # at most LENGTH of a segment
    # a table, so that the join on it is a plain one, split where a segment is frequent
    known = table(distinct.select("a", "s", "first", F.size("w").alias("c")).join(late, ["a", "s"], "left"), "known")
    found = segments.select("doc_id", "k", "start", "a", "s").join(known, ["a", "s"])
    # any but the first of equal segments loses all its windows, the first only those found elsewhere before
    is_first = F.col("first") == F.struct("doc_id", "start")
    spans = F.when(~is_first, F.array(F.array(F.col("start"), F.col("start") + F.col("c") - 1 + LENGTH))).otherwise(F.transform(F.col("late"), lambda i: F.array(F.col("start") + i, F.col("start") + i + LENGTH)))
    cut = found.withColumn("cut", spans).filter("size(cut) > 0")
    return cut.groupBy(F.col("doc_id").alias("d2"), F.col("k").alias("k2")).agg(F.flatten(F.collect_list("cut")).alias("late"))


def remove_repeats(docs: DataFrame, texts: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, unless ``texts`` is false) for every row.

    A word goes if a window of LENGTH words covers it whose words also start
    earlier (smaller doc_id, or the same document before). A null id is the
    smallest. Null and empty texts, and texts shorter than a window, lose
    nothing. Rows that repeat an id count as one document: where they agree, neither is earlier.
    Very long texts are windows like any other, in arrays of their task. Other columns are not read.
    An empty table gives no rows. kept is null where nothing was removed.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("k"), F.col(text).alias("t"))
    found = _found(_places(d))
    extended = table(_extend(_squeezed(d).join(found, F.col("doc_id").eqNullSafe(F.col("d2")), "left").select("doc_id", "k", "z", "found"), texts), "extended")
    late = table(_late(extended.filter("s IS NOT NULL")), "late")
    open_ = extended.filter("s IS NULL AND n_words IS NULL").select("doc_id", "k", "z", "cut")
    ended = _finish(open_.join(late, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2")), "left").select("doc_id", "k", "z", "cut", "late"), texts)
    done = extended.filter("n_words IS NOT NULL").select(ended.columns)
    return done.union(ended).drop("k")


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
