"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

The most frequent id of the corpus has rank 0. A rank takes 1 to 4 bytes; its
length less one stands in 2 bits of a control byte, four ranks to a byte, and
control bytes stand apart from data bytes. A block holds whole documents and is
decoded at once: a table gives the four lengths of every control byte, their
running sum the places of the data. A file is a range of doc_ids; its
blocks are rows of a Parquet table in the shared folder, so that a task run
twice leaves one file.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import table

#: Ids of a block (more if one document has more) and of a file, bytes of text worked on at once; words remembered by a worker and given to the library as one text.
BLOCK, FILE, SLICE, MEMO, WORDS = 1 << 20, 1 << 26, 1 << 24, 500_000, 100
END = 0

_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Marks that may follow a word's letters; the tokenizer parts the two.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters after which marks are parted, in words as :meth:`Pieces.fast` marks them: of alphabets on which all versions of Unicode agree.
_LETTERS = "\\A[\\x02\\n]?[A-Za-zÀ-ÖØ-öø-ʯΑ-ΡΣ-ώЀ-ҁҊ-ԣ]+\\z"
#: Texts with other white space than single spaces and line ends, or with the characters that mark words here.
_UNEVEN = "[\\x02\\x03\\x1c-\\x1f\\t\\r\\x0b\\x0c\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|  |\\n\\n| \\n|\\n "
#: Separators that Python counts as white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")

#: Lengths of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    r = ranks.astype("<u4")
    codes = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = codes
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """``n`` ranks."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(lengths > j)
        if not len(more):
            break
        out[more] |= raw[starts[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, … (n[0] of them), then those from starts[1], and so on."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """Encodes with the tokenizers library, remembering the ids of pieces.

    A text is parted where no token can reach across: before a space that begins a
    run of other characters, and around white space. A word new to the worker is parted further,
    into letters and marks after them. The library encodes each part once, many
    of them in one text where the white space between shows which ids are whose.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already; the library's own threads would wait for each other
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.end = np.array([END], self.kind).tobytes()
        #: By space or line end: whether a token begins with it (a byte-level vocabulary writes the two as these letters).
        self.begins: dict[str, np.ndarray] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        for before, letter in ((" ", "\u0120"), ("\n", "\u010a")):
            self.begins[before] = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[before][[i for token, i in vocabulary.items() if token.startswith(letter)]] = True
        #: Heads of words as :meth:`fast` marks them, and the ids of each: where they start in ``pool``, and their number.
        self.known, self.starts, self.lengths, self.pool = self._laid(pa.array(["\x02", "\x03", "", "\n"]), [b"", self.end, *self.whole([" ", "\n"])])
        self.pieces: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}  # letters, and what isn't parted
        self.marks: dict[str, bytes] = {"": b""}

    def _laid(self, words: pa.Array, values: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        return words, np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(values), self.kind)

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 10_000):
            out += [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)]
        return out

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, parted into letters and marks after them."""
        heads = self.heads
        if len(heads) > 2 * MEMO:
            heads.clear()
        parted = [h if (h := p.rstrip(_MARKS)).strip(" ").isalpha() else p for p in pieces]
        fresh = list(set(parted).difference(heads))
        heads.update(zip(fresh, self.whole(fresh), strict=True))
        rest = [p[len(h) :] for p, h in zip(pieces, parted, strict=True)]
        return [heads[h] + r for h, r in zip(parted, self.after(rest), strict=True)]

    def after(self, rest: list[str]) -> list[bytes]:
        """The ids of marks that follow letters."""
        marks = self.marks
        if len(marks) > MEMO:
            marks.clear()
            marks[""] = b""
        fresh = list(set(rest).difference(marks))
        marks.update(zip(fresh, self.whole(fresh), strict=True))
        return list(map(marks.__getitem__, rest))

    def apart(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space that come after a space or line end, with that, and their numbers.

        The library gets texts of WORDS words; a word begins at each token that begins with ``before``.
        """
        ids, lengths = [], []
        for i in range(0, len(words), 100 * WORDS):
            some = words[i : i + 100 * WORDS]
            cuts = pa.array([*range(0, len(some), WORDS), len(some)], pa.int32())
            got = np.frombuffer(b"".join(self.whole([before + t for t in pc.binary_join(pa.ListArray.from_arrays(cuts, some), before).to_pylist()])), self.kind)
            n = np.diff(np.append(np.flatnonzero(self.begins[before][got]), len(got)))
            if len(n) != len(some):  # another kind of vocabulary
                _, _, n, got = self._laid(some, self.whole([before + w for w in some.to_pylist()]))
            ids.append(got)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def remember(self, heads: pa.Array) -> np.ndarray:
        """The places of distinct heads in ``known``, after those not there have been encoded."""
        places = pc.fill_null(pc.index_in(heads, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(places < 0)
        lined = pc.match_substring_regex(heads.take(pa.array(new)), "\\A[\\x02\\n]").to_numpy(zero_copy_only=False)
        for before, at in ((" ", new[~lined]), ("\n", new[lined])):
            if not len(at):
                continue
            words = heads.take(pa.array(at))
            ids, n = self.apart(words if before == " " else pc.utf8_slice_codeunits(words, 1), before)
            starts = len(self.pool) + np.cumsum(n) - n
            if before == "\n":
                less = pc.starts_with(words, "\x02").to_numpy(zero_copy_only=False) * self.lengths[3]  # the text begins without a line end
                starts, n = starts + less, n - less
            places[at] = len(self.known) + np.arange(len(at))
            self.known = pa.concat_arrays([self.known, words])
            self.starts, self.lengths, self.pool = (np.concatenate(x) for x in ((self.starts, starts), (self.lengths, n), (self.pool, ids)))
        return places

    def forget(self, keep: np.ndarray) -> None:
        """Only these places of ``known``, and the first four, stay."""
        keep = np.union1d(np.arange(4), keep)
        n = self.lengths[keep]
        self.known, self.pool = self.known.take(pa.array(keep)), self.pool[_ranges(self.starts[keep], n)]
        self.starts, self.lengths = np.cumsum(n) - n, n

    def values(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words that come after a space, or are marked: after a line end, at the start or the end of a text; and their numbers."""
        heads = pc.utf8_rtrim(words, characters=_MARKS)
        heads = pc.if_else(pc.match_substring_regex(heads, _LETTERS), heads, words)
        # what follows each head: bytes of the words from where the heads end
        size = pc.binary_length(heads).to_numpy()
        more = pc.binary_length(words).to_numpy() - size
        some = np.flatnonzero(more)
        rest = words.take(pa.array(some)).cast(pa.binary())
        at = np.frombuffer(rest.buffers()[1], np.int32)[: len(some)] + size[some]
        cuts = np.concatenate([[0], np.cumsum(more[some])]).astype(np.int32)
        raw = np.frombuffer(rest.buffers()[2] or b"", np.uint8)[_ranges(at, more[some])]
        marks = pa.StringArray.from_buffers(len(some), pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        _, mark_starts, mark_lengths, mark_pool = self._laid(marks.dictionary, self.after(marks.dictionary.to_pylist()))
        coded = heads.dictionary_encode()
        places = self.remember(coded.dictionary)
        head = places[coded.indices.to_numpy()]
        starts, n = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        starts[:, 0], n[:, 0] = self.starts[head], self.lengths[head]
        mark = marks.indices.to_numpy()
        starts[some, 1], n[some, 1] = mark_starts[mark] + len(self.pool), mark_lengths[mark]
        pool = np.concatenate([self.pool, mark_pool])[_ranges(starts.ravel(), n.ravel())]
        if len(self.known) > 2 * MEMO:
            self.forget(places)
        return pool, n.sum(axis=1)

    def fast(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """All ids of texts with single spaces and line ends, in parts, and where each text ends.

        Arrow parts the texts and numbers the distinct words; only parts of words that are new become Python strings.
        """
        marked = pc.binary_join_element_wise("\x02", pc.replace_substring(texts, "\n", " \n"), " \x03", "")
        parted = pc.split_pattern(marked, " ")
        coded = parted.flatten().dictionary_encode()
        pool, lengths = self.values(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        out = []
        for i in range(0, len(at), 1 << 18):
            a = at[i : i + (1 << 18)]
            out.append(pool[_ranges(starts[a], lengths[a])])
        ends = np.cumsum(lengths[at])
        return out, ends[parted.offsets.to_numpy()[1:] - 1]

    def slow(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts."""
        parted = [None if _ODD.search(t) or any(a in t for a in self.added) else _PIECE.findall(t) for t in texts]
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        new = list({p for ps in parted if ps for p in ps}.difference(self.pieces))
        self.pieces.update(zip(new, self.learn(new), strict=True))
        known = self.pieces.__getitem__
        return [(self.whole([t])[0] if ps is None else b"".join(map(known, ps))) + self.end for t, ps in zip(texts, parted, strict=True)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Pieces of the work: which of the texts, and their ids as bytes with the end id."""
        odd = pc.match_substring_regex(texts, _UNEVEN)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        rows = pa.array(np.arange(len(texts)))
        some = rows.filter(pc.invert(odd))
        if len(some):
            ids, ends = self.fast(texts.take(some))
            offsets = np.concatenate([[0], ends * self.kind.itemsize]).astype(np.int32)
            yield some, pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(ids))])
        some = rows.filter(odd)
        if len(some):
            yield some, pa.array(self.slow(texts.take(some).to_pylist()), pa.binary())


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some SLICE bytes of text (more if one text has more)."""
    group = np.cumsum(pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy().astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, ids (little-endian, 2 bytes each if the vocabulary allows) with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = pieces(path)
        for whole in batches:
            for b in _slices(whole):
                for rows, ids in e.encode(pc.fill_null(b.column("t"), "")):
                    n = pc.divide(pc.binary_length(ids).cast(pa.int64()), e.kind.itemsize)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), n, ids], ["doc_id", "n", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n long, ids binary")


def _joined(column: pa.Array) -> bytes:
    return b"".join(column.to_pylist())


def ranking(encoded: DataFrame, kind: str, size: int) -> np.ndarray:
    """Ids by falling frequency over all of ``encoded``, the smaller id first on a tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(_joined(b.column("ids")), kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for i, n in encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many rows as the vocabulary
        counts[i] = n
    return np.argsort(-counts, kind="stable").astype(np.uint32)


def write(encoded: DataFrame, by_rank: np.ndarray, kind: str, files: int) -> DataFrame:
    """The written blocks: file, block, ids_before (in the file), doc_ids, lengths, n_ids, control, data."""
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            n = sum(lengths)
            control, data = pack(rank_of[np.frombuffer(b"".join(held), kind)])
            row = [[file], [block], [before], [list(docs)], [list(lengths)], [n], [control], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            block, before = block + 1, before + n
            for x in (docs, lengths, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["file", "block", "ids_before", "doc_ids", "lengths", "n_ids", "control", "data"])

        size = 0
        for b in batches:
            for d, n, ids in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if size and size + n > BLOCK:
                    yield flush()
                    size = 0
                docs.append(d)
                lengths.append(n)
                held.append(ids)
                size += n
        if docs:
            yield flush()

    dealt = encoded.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "n").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    return table(dealt.mapInArrow(run, "file int, block int, ids_before long, doc_ids array<long>, lengths array<long>, n_ids long, control binary, data binary"), "blocks")


def read(blocks: DataFrame, by_rank: np.ndarray, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids (if asked for) of every document, from the files."""
    total = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = total.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                got = by_rank[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw, start = got.tobytes(), row["base"] + row["ids_before"]
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns, names = [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + start), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(got.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.join(F.broadcast(bases), "file").select("ids_before", "base", "doc_ids", "lengths", "n_ids", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def store(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Writes all documents as token files in ascending doc_id order; the blocks and the ids by rank, which :func:`read` needs.

    Null text counts as empty: the end id alone. Rows without an id come first, rows that
    repeat an id stand together, the shorter first. Very long texts are a block of their own. Other columns are not read. An empty table gives no blocks.
    path: the vocabulary file, the same on every machine.
    """
    path = path or default_path()
    known = pieces(path)
    encoded = table(encode(docs, path, doc_id, text), "encoded")
    by_rank = ranking(encoded, known.kind.str, known.size)
    n = encoded.agg(F.sum("n")).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE))
    return write(encoded, by_rank, known.kind.str, files), by_rank


def query(docs: DataFrame) -> DataFrame:
    blocks, by_rank = store(docs)
    return read(blocks, by_rank, ids=False)
