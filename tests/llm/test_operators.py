"""Each operator against a plain single-machine version, on the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import bpe, exact_dedup, licenses, mixing, quality, sharding, simhash, substrings, token_files, urls
from geoloom.llm.graph import components
from tests.llm.cases import SCHEMA, documents

ROWS = documents()
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def words(text):
    return re.findall(WORD, text or "")


# 1


def places(text):
    w = licenses.words_of(text or "")
    found = sorted((i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licenses(docs, none):
    got = licenses.query(docs).collect()
    assert bag((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == bag((r[0], *places(r[1])) for r in ROWS)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert licenses.query(none).count() == 0


def test_license_lowers_ascii_only(spark):
    """Only A-Z are lower-cased: with a Kelvin sign a word is another one."""
    notice = "this {} is licensed under the GNU General Public License, version 3"
    docs = spark.createDataFrame([(0, notice.format("WORK")), (1, notice.format("wor\u212a"))], "doc_id long, text string")
    plain, kelvin = (r.score for r in licenses.query(docs).orderBy("doc_id").collect())
    assert kelvin < plain


def test_license_spans(spark):
    mit = licenses.TEMPLATES[2][1].split()
    broken = mit[:30] + ["really"] + mit[30:60] + mit[61:]
    text = "before it " + " ".join(broken) + " after"
    rows = spark.createDataFrame([(1, text), (2, " ".join(mit[:25])), (3, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert got[1].labels == "mit" and 0.9 < got[1].score < 1
    (span,) = [s for s in got[1].spans if s.label == "mit"]
    assert span.first == 2 and span.last == 1 + len(licenses.words_of(" ".join(broken)))
    assert got[2].labels == "" and got[2].score == 0
    assert "gpl-3" in got[3].labels.split(",") and got[3].score == 1


# 2


def test_sharding(docs, none):
    got = sharding.query(docs).collect()
    assert len(got) == len(ROWS)
    want = bag((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.query(none).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    share = Counter(r.shard for r in sharding.with_shard(ids, [1.0, 2.0, 5.0]).collect())
    assert [round(share[i] / 6000, 1) for i in range(3)] == [0.1, 0.2, 0.6] or all(abs(share[i] / 6000 - w / 8) < 0.03 for i, w in enumerate([1, 2, 5]))


# 3


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe(docs, none, word_bpe):
    def want(r):
        ids = word_bpe.encode(r[1] or "", add_special_tokens=False).ids
        return r[0], len(ids), sha(" ".join(map(str, ids))), sha(word_bpe.decode(ids, skip_special_tokens=False))

    assert bag(bpe.query(docs).collect()) == bag(map(want, ROWS))
    assert bpe.query(none).count() == 0


def test_bpe_long_words(spark, word_bpe):
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("etaoinshr"), n)) for n in (257, 600, 30_000)] + ["ab" * 4000, "z" * 1025]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in bpe.encode(docs).collect():
        assert x.ids == word_bpe.encode(texts[x.doc_id], add_special_tokens=False).ids


def test_bpe_round_trip(docs, word_bpe):
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r.decoded == word_bpe.decode(r.ids, skip_special_tokens=False)
        assert sha(r.decoded) == r.decoded_sha256 and len(r.ids) == r.n_tokens


# 4


def counts(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in ROWS if r[0]] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.query(docs, labels).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == bag((r[0], *counts(r[1])) for r in ROWS)
    assert all(r.kept is not r.base_failed for r in got)
    assert quality.query(none, labels).count() == 0
    kept = quality.keep(docs, [])
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_learned_list(spark):
    # quality 0 exactly where many words carry symbols; half of the rows are held out
    rows = [(i, " ".join(f"w{j}{'#' if i % 4 == 0 and j % 2 else ''}x{i * j % 97}" for j in range(80 + i % 30))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 1200, 1) if i % 8 < 5], "doc_id long, quality int, toxic int")
    rules = quality.learn(quality.sample(docs, labels))
    assert rules
    got = {r.doc_id: r.kept for r in quality.judge(docs, rules).collect()}
    unseen = [i for i in got if i % 8 >= 5]
    assert sum(got[i] == (i % 4 != 0) for i in unseen) >= 0.99 * len(unseen)


def plain_features(text):
    w = words(text)
    n, chars, symbols, dup, repeated, _ = counts(text)
    digits, upper, marks = (len(re.findall(p, text or "")) for p in ("[0-9]", "[A-Z]", "[!?]"))
    parts = {"symbols_per_word": (symbols, n), "repeated_words": (repeated, n), "distinct_words": (len(set(w)), n), "duplicate_lines_per_word": (dup, n), "chars_per_word": (chars, n), "upper_case": (upper, chars), "marks_per_word": (marks, n), "digits": (digits, chars)}
    return {k: a / b if b else 0.0 for k, (a, b) in parts.items()}


def test_verdicts_of_a_list(docs):
    """rule and kept are those of a plain evaluation of the rules, in their order."""
    of = quality.Condition
    rules = [(of("symbols_per_word", True, 0.2), of("digits", False, 0.3)), (of("distinct_words", False, 0.5),), (of("chars_per_word", True, 4.0), of("upper_case", True, 0.1)), (of("digits", True, 0.01),)]
    got = quality.judge(docs, rules).collect()
    want = []
    for r in ROWS:
        x = plain_features(r[1])
        first = next((i for i, rule in enumerate(rules) if all(c.holds(x) for c in rule)), None)
        want.append((r[0], first, first is None and not counts(r[1])[-1]))
    assert bag((g.doc_id, g.rule, g.kept) for g in got) == bag(want)
    assert len({w[1] for w in want}) >= 3 and {w[2] for w in want} == {True, False}
    assert bag(quality.keep(docs, rules).select("doc_id").collect()) == bag((w[0],) for w in want if w[2])


# 5


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    goal, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return goal | {s: left * weight[s] / total for s in free}
        goal |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return goal


def test_mixing(docs, none):
    got = mixing.query(docs).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    want = water(sizes)
    assert bag((r.doc_id, r.size, r.source_size) for r in got) == bag((r[0], len(words(r[1])), sizes[r[3]]) for r in ROWS)
    goal = {r.source_size: r.target for r in got}
    for s, t in want.items():
        assert goal[sizes[s]] == pytest.approx(t)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert bag(mixing.query(docs).collect()) == bag(got)
    assert mixing.query(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)


def test_mix_meets_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    taken, goal = Counter(), {}
    key = {i: f"s{i % 5}" for i in range(3000)}
    for r in mixing.query(docs).collect():
        taken[key[r.doc_id]] += r.taken
        goal[key[r.doc_id]] = r.target
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] for s in goal)


def test_mix_of_rows_without_id(spark):
    """Rows without an id, or with the same one, are drawn each for itself; one trial is the plain draw."""
    rows = [(None if i % 2 else 7, f"s{i % 3}", f"{i} " + "w " * 499) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for trials, near in ((mixing.TRIALS, 0.02), (1, 0.15)):
        df, n = mixing.copies(docs, trials=trials)
        for r in df.groupBy("source").agg(F.sum(F.col(n["copies"]) * F.col(n["size"])).alias("taken"), F.max(n["target"]).alias("target")).collect():
            assert abs(r.taken - r.target) <= near * r.target


# 6


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    top = {t: max(ids, key=lambda x: -1 if x is None else x) for t, ids in groups.items()}
    want = bag((r[0], top[r[1] or ""], len(groups[r[1] or ""]), r[0] == top[r[1] or ""], sha(r[1] or "")) for r in ROWS)
    assert bag(exact_dedup.query(docs).collect()) == want
    assert exact_dedup.query(none).count() == 0
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r.text or "" for r in rows) == Counter(list(groups))
    assert all(r.doc_id == top[r.text or ""] for r in rows)


def test_exact_dedup_chains_keys(spark, docs, monkeypatch):
    """Texts whose keys collide are told apart by their bytes, in cold buckets as for hot keys."""
    want = bag(exact_dedup.query(docs).collect())
    monkeypatch.setattr(exact_dedup, "key_of", lambda text: F.shiftleft(F.pmod(F.length(text), F.lit(3)).cast("long"), 62))
    for rows in (1 << 40, 5):
        monkeypatch.setattr(exact_dedup, "HOT_ROWS", rows)
        entries, hot_rows = exact_dedup.index(docs)
        assert (hot_rows.count() > 0) == (rows == 5)
        assert entries.agg(F.max("chain")).first()[0] > 10
        assert bag(exact_dedup.query(docs).collect()) == want
        assert exact_dedup.keep_last(docs).count() == len({r[1] or "" for r in ROWS})


def test_exact_dedup_owners(spark, monkeypatch):
    """Buckets split, each is one owner's range of keys, and copies of a hot text still form one group."""
    monkeypatch.setattr(exact_dedup, "LEAST_BYTES", 2000)
    rows = [(i, f"text {i} " * 20) for i in range(500)] + [(1000 + i, "hot " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    entries, hot_rows = exact_dedup.index(docs)
    assert hot_rows.count() == 300
    seen = entries.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    assert len(seen) > 8
    unsigned = sorted(((r.low & (2**64 - 1), r.high & (2**64 - 1)) if (r.low < 0) == (r.high < 0) else (0, 2**64 - 1)) for r in seen)
    assert all(a[1] < b[0] for a, b in zip(unsigned, unsigned[1:], strict=False))
    got = {r.doc_id: r for r in exact_dedup.query(docs).collect()}
    assert len(got) == 800 and all(got[1000 + i].group_size == 300 and got[1000 + i].keep_id == 1299 for i in range(300))


def test_directory():
    sizes = {p: 10 for p in range(0, 1 << exact_dedup.MAX_DEPTH, 64)} | {5: 10_000}
    buckets = exact_dedup.directory(sizes, 100)
    ends = [b[0] + (1 << (exact_dedup.MAX_DEPTH - b[1])) for b in buckets]
    assert [b[0] for b in buckets][1:] + [1 << exact_dedup.MAX_DEPTH] == ends
    assert all(held <= 100 or bits == exact_dedup.MAX_DEPTH for _, bits, held in buckets)
    assert sum(b[2] for b in buckets) == sum(sizes.values())


# 7


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def url_rule(host, path):
    fit = [(len(h + p), h + p, allow) for allow, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_urls(spark, none):
    r = np.random.default_rng(3)
    texts = [f"http://{'ok' if i % 2 else 'spam'}{r.integers(50)}.{'com' if i % 2 else 'net'}/{['en', 'es'][i % 2 == 0]}/{'page' if i % 2 else 'casino'}{i}" for i in range(400)]
    texts += [f"http://{w}{r.integers(50)}.org/en/{p}{i}" for i in range(30) for w, p in (("ok", "page"), ("spam", "casino"))]
    texts += [None, "", "nothing", "http://", "HTTPS://A.COM", "ftp://EXAMPLE.com/en/x?y#z", "x://www.example.com/en/", "a://b://c.com/", "http://notcom/", "http://é.com/ü", "http://com/", "http://x.net?/es/", "http://x.net/es/a/../b", "http://" + "a" * 5000 + ".org/"]
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(texts)] + [(3, texts[3], "h", "p", "r")], "page_id long, url string, host string, path string, ratio string")
    got = urls.query(pages).collect()
    assert len(got) == len(texts) + 1
    right = []
    for x in got:
        host, path = url_parts(texts[x.page_id])
        name, allow = url_rule(host, path)
        assert (x.host, x.path, x.rule) == (host, path, name)
        if name:
            assert x.verdict == ("allow" if allow else "block")
        elif 400 <= x.page_id < 460:
            right.append(x.verdict == ("block" if "spam" in texts[x.page_id] else "allow"))
    assert len(right) == 60 and sum(right) >= 57
    assert urls.query(pages.filter("page_id < 0")).count() == 0


# 8


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(items, near):
    label = list(range(len(items)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(items))]


def test_simhash(docs, none):
    fps = [plain_fingerprint(r[1]) for r in ROWS]
    roots = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, x in zip(ROWS, roots, strict=True):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    want = bag((r[0], f"{f:016x}", least.get(x)) for r, f, x in zip(ROWS, fps, roots, strict=True))
    assert bag(simhash.query(docs).collect()) == want
    assert simhash.query(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


@pytest.mark.parametrize("parts", [None, [([*range(22)], 1), ([*range(22, 43)], 1), ([*range(43, 64)], 0)]])
def test_links_lose_nothing(spark, monkeypatch, parts):
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64, 40, dtype=np.uint64)
    near = [int(v) for v in x]
    for v in x:
        for _ in range(25):
            w = int(near[r.integers(len(near))]) if r.random() < 0.3 else int(v)
            for b in r.choice(64, r.integers(0, 6), replace=False):
                w ^= 1 << int(b)
            near.append(w)
    near = sorted(set(near))
    if parts:
        monkeypatch.setattr(simhash, "plan", lambda *a: parts)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in near], "fp long")
    links = simhash.link(fps, 4)
    pairs = [(a % 2**64, b % 2**64) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    got = {a: b for a, b in components(links).collect()}
    roots = plain_components(near, lambda a, b: (a ^ b).bit_count() <= 4)
    ours = defaultdict(set)
    for v, x in zip(near, roots, strict=True):
        s = v - (1 << 64) if v >> 63 else v
        ours[x].add(got.get(s, s))
    assert all(len(s) == 1 for s in ours.values()) and len({*map(min, ours.values())}) == len(ours)


def test_run_links_dense_cluster():
    r = np.random.default_rng(2)
    x = np.unique(np.array([sum(1 << int(b) for b in r.choice(12, r.integers(0, 12), replace=False)) for _ in range(3000)], np.uint64))
    links = simhash.run_links(x, 4, block=16)
    assert sum(len(a) for a, _ in links) < len(x)


def test_thresholds():
    total, ts = simhash.allocate(lambda i, t: [1, 100, 1][i] * (t + 1), 3, 4)
    assert sum(ts) == 2 and ts[1] == -1 or total <= 103


def test_components_of_a_path(spark):
    n = 300
    got = dict(components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")).collect())
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


# 9


def plain_repeats(rows):
    first, texts = {}, [words(r[1]) for r in rows]
    order = lambda d, i: (-1 if d is None else d, i)
    for r, w in zip(rows, texts, strict=True):
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (10**9, 0)), order(r[0], i))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < order(r[0], i) for j in range(i, i + 20)}
        out.append((r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return bag(out)


def test_substrings(docs, none):
    assert bag(substrings.query(docs).collect()) == plain_repeats(ROWS)
    assert substrings.query(none).count() == 0


def test_substrings_of_few_words(spark):
    r = np.random.default_rng(5)
    rows = [(i, " ".join("ab"[int(x)] for x in r.integers(0, 2, 60)) + " " + " ".join("abc"[int(x)] for x in np.tile(r.integers(0, 3, 5), 12))) for i in range(40)]
    rows += [(100 + i, " ".join(rows[i][1].split()[10 : 30 + i])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(substrings.query(docs).collect()) == plain_repeats(rows)
    kept = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert all(sha(r.kept) == r.kept_sha256 for r in kept.values() if r.n_removed)


# 10


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_path())
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in ROWS]
    blocks, by_rank = token_files.store(docs)
    got = token_files.read(blocks, by_rank).orderBy("start").collect()
    assert bag((r.doc_id, r.n_tokens, tuple(r.ids)) for r in got) == bag((r[0], len(x), tuple(x)) for r, x in zip(ROWS, ids, strict=True))
    start = 0
    for r in got:
        assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert token_files.query(none).count() == 0


def test_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(x), n) == x).all()


WORDS_AND_MARKS = ["", " ", "\n", "one", " one", "one ", "\none", "one\n", "a b\nc!! d\n", "!!", "\n!!", "it's we'll 12a,b3 (x).", "é,ß;Ж! ʰ: ×, ÷. 日本。 a\u0301! \u200b,", "x" * 300 + "! " + "ab" * 500]


def encoded(pieces, texts):
    got = [None] * len(texts)
    for rows, ids in pieces.encode(pa.array(texts, pa.string())):
        for i, x in zip(rows.to_pylist(), ids.to_pylist(), strict=True):
            got[i] = np.frombuffer(x, pieces.kind).tolist()
    return got


def test_token_files_new_words_share_texts(monkeypatch):
    """New words reach the library many to a text, not one by one."""
    e = token_files.Pieces(token_files.default_path())
    given, whole = [], e.whole
    monkeypatch.setattr(e, "whole", lambda texts: given.extend(texts) or whole(texts))
    letters = "".join(chr(97 + i) for i in range(26))
    new = [a + b + c for a in letters for b in letters for c in "aeiou"]
    texts = [" ".join(new), "\n".join(x + "," for x in new)]
    got = encoded(e, texts)
    assert len(given) < len(new) / 20
    assert got == [x.ids + [0] for x in e.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("memo", [0, 500_000])
@pytest.mark.parametrize("marked", [True, False])
def test_token_files_parts(monkeypatch, memo, marked):
    """Ids go to the right words, whatever is forgotten between, and if no token shows where a word begins."""
    monkeypatch.setattr(token_files, "MEMO", memo)
    monkeypatch.setattr(token_files, "WORDS", 3)
    e = token_files.Pieces(token_files.default_path())
    if not marked:
        for begins in e.begins.values():
            begins[:] = False
    want = [x.ids + [0] for x in e.library.encode_batch(WORDS_AND_MARKS, add_special_tokens=False)]
    for n in (len(want), 3, 1):
        for i in range(0, len(want), n):
            assert encoded(e, WORDS_AND_MARKS[i : i + n]) == want[i : i + n]
