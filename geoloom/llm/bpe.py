"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left ends: leaf i holds the rank of the
pair (symbol i, next symbol), inner nodes the least rank below. The root tells whether
any pair can be merged; going down to the left while it holds the least rank finds the
leftmost lowest-ranked pair; a merge changes three leaves, each updated up to the
root. Words of like length are worked in step, one numpy row each. The vocabulary
file also names the normalizer and the pre-tokenizer that part a text
into words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Words remembered by a worker, and leaves worked on at once.
MEMO, LEAVES = 300_000, 1 << 21
_NONE = np.int32(2**31 - 1)
#: Words of over 2**(LONG - 1) bytes are merged one by one where fewer than FEW are at hand.
LONG, FEW = 9, 16

#: Texts of these characters alone need no normalization but lower case, and Python's character classes part them as the vocabulary's do.
_PLAIN = re.compile(r"[^\t\n\r -~¡-ɏ]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


LETTERS = _byte_letters()
BYTES = {c: b for b, c in LETTERS.items()}


class Encoder:
    """Encodes words of one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)  # only its normalizer and pre-tokenizer
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = max(self.tokens) + 1
        inside = [ids[LETTERS[b]] for b in range(256)]
        self.inside = np.array(inside, np.int32)
        self.last = np.array([ids[LETTERS[b] + self.suffix] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.known = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self.memo: dict[str, tuple[str, str, bytes]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; _NONE where a symbol is missing (-1) or the pair is not merged."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words that aren't empty."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        sizes = np.array([len(w) for w in words])
        levels = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for level in np.unique(levels).tolist():
            group = np.flatnonzero(levels == level)
            step = max(1, LEAVES >> level)
            for i in range(0, len(group), step):
                part = group[i : i + step].tolist()
                if level >= LONG and len(part) < FEW:
                    for k in part:
                        out[k] = self._alone(words[k], 1 << level)
                    continue
                for k, ids in zip(part, self._in_step([words[k] for k in part], 1 << level), strict=True):
                    out[k] = ids
        return out

    def _alone(self, word: bytes, leaves: int) -> np.ndarray:
        """The ids of one long word: the tree as a list, whose nodes change only as far up as a minimum does."""
        raw = np.frombuffer(word, np.uint8)
        sym = self.inside[raw].copy()
        sym[-1] = self.last[raw[-1]]
        layer = np.full(leaves, _NONE, np.int32)
        layer[: len(sym) - 1] = self.rank(sym[:-1], sym[1:])
        layers = [layer]
        while len(layers[-1]) > 1:
            layers.append(np.minimum(layers[-1][0::2], layers[-1][1::2]))
        tree = [int(_NONE), *np.concatenate(layers[::-1]).tolist()]
        ids, none, size, known, made = sym.tolist(), int(_NONE), self.size, self.known, self.made.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        after[-1] = -1

        def put(leaf: int, value: int) -> None:
            node = leaf + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        while tree[1] != none:
            node, rank = 1, tree[1]
            while node < leaves:
                node *= 2
                node += tree[node] != rank
            i = node - leaves
            j = after[i]
            ids[i], ids[j] = made[rank], -1
            k = after[i] = after[j]
            put(j, none)
            if k >= 0:
                before[k] = i
                put(i, known.get(ids[i] * size + ids[k], none))
            else:
                put(i, none)
            p = before[i]
            if p >= 0:
                put(p, known.get(ids[p] * size + ids[i], none))
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def _in_step(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        n = len(words)
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        at = np.arange(leaves)
        sym = np.where(at < sizes[:, None], self.inside[raw], np.int32(-1))
        rows = np.arange(n)
        sym[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        after = np.where(at + 1 < sizes[:, None], at + 1, -1).astype(np.int32)
        before = np.broadcast_to(at - 1, (n, leaves)).astype(np.int32)
        tree = np.full((n, 2 * leaves), _NONE, np.int32)
        tree[:, leaves : 2 * leaves - 1] = self.rank(sym[:, :-1], sym[:, 1:])
        width = leaves
        while width > 1:
            below = tree[:, width : 2 * width]
            tree[:, width // 2 : width] = np.minimum(below[:, 0::2], below[:, 1::2])
            width //= 2

        def put(w: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[w, node] = value
            node = node >> 1
            for _ in range(leaves.bit_length() - 1):
                tree[w, node] = np.minimum(tree[w, 2 * node], tree[w, 2 * node + 1])
                node = node >> 1

        w = np.flatnonzero(tree[:, 1] != _NONE)
        while len(w):
            node = np.ones(len(w), np.int64)
            for _ in range(leaves.bit_length() - 1):
                node = 2 * node
                node += tree[w, node] > tree[w, node + 1]
            i = node - leaves
            j = after[w, i]
            merged = self.made[tree[w, node]]
            sym[w, i], sym[w, j] = merged, -1
            k = after[w, j]
            after[w, i] = k
            has = k >= 0
            before[w[has], k[has]] = i[has]
            put(w, j, _NONE)
            put(w, i, np.where(has, self.rank(merged, sym[w, k]), _NONE))
            p = before[w, i]
            has = p >= 0
            if has.any():
                put(w[has], p[has], self.rank(sym[w[has], p[has]], merged[has]))
            w = w[tree[w, 1] != _NONE]
        live = sym >= 0
        ends = np.cumsum(live.sum(axis=1))
        return np.split(sym[live], ends[:-1])

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if _PLAIN.search(text) is None:
            return _WORD.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(BYTES[c] for c in piece).decode("utf-8") for piece, _ in pieces]

    def parts(self, text: str) -> list[str | int]:
        """Words, and the ids of added tokens that stand in the text."""
        if self.split is None or "<|" not in text:
            return self.words(text)
        out: list[str | int] = []
        for piece in self.split.split(text):
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                out += self.words(piece)
        return out

    def look(self, texts: list[str]) -> list[list[tuple[str, str, bytes]]]:
        """For each text its words as (ids, decoded tokens, ids as int32): the parts of its encoding."""
        parted = [self.parts(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        fresh = list({w for ws in parted for w in ws if w not in self.memo})
        self.memo |= {w: self.entry(np.array([w], np.int32)) for w in fresh if isinstance(w, int)}
        fresh = [w for w in fresh if not isinstance(w, int)]
        for w, ids in zip(fresh, self.merge([w.encode("utf-8") for w in fresh]), strict=True):
            self.memo[w] = self.entry(ids)
        return [[self.memo[w] for w in ws] for ws in parted]

    def forget(self) -> None:
        """Gives back the memory of remembered words and of batches: a worker outlives its task, and other tasks need it."""
        self.memo = {}
        pa.default_memory_pool().release_unused()

    def entry(self, ids: np.ndarray) -> tuple[str, str, bytes]:
        plain = ids.tolist()
        return " ".join(map(str, plain)), self.decode(plain), ids.astype("<i4").tobytes()

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids, joined by one space: the vocabulary names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _slices(b: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, most):
        yield b.slice(i, most)


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, if asked for), ids_sha256, decoded_sha256 for every row.

    ids_sha256 is of the decimal ids joined by a space, decoded_sha256 of the
    decoded text. Null text counts as empty: no ids. Strings of added tokens
    in a text give their ids. Rows that repeat are encoded alike; a null
    id stays null. Very long texts are encoded whole, very long words in a tree of their own; of equal ranks the
    leftmost is merged. Other columns are not read. An empty table gives no rows. path: the vocabulary file, the same on every machine.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for b in _slices(whole):
                counts, shas, decoded, raw = [], [], [], []
                for ws in e.look([t or "" for t in b.column("t").to_pylist()]):
                    said = " ".join(w[0] for w in ws)
                    counts.append(said.count(" ") + 1 if ws else 0)
                    shas.append(hashlib.sha256(said.encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join(w[1] for w in ws).encode("utf-8")).hexdigest())
                    if ids:
                        raw.append(b"".join(w[2] for w in ws))
                columns, names = [b.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]
                if ids:
                    ends = np.cumsum([0, *counts]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shas), pa.array(decoded)], [*names, "ids_sha256", "decoded_sha256"])
        e.forget()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long{', ids array<int>' if ids else ''}, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column decoded: the text of its ids (null ids: null)."""
    path = path or default_path()
    schema = StructType([*encoded.schema, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [None if x is None else e.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, ids=False)
