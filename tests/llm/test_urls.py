"""The URL models and verdicts against plain ones."""

import math
from collections import Counter

import numpy as np
import xxhash

from geoloom.llm import urls
from tests.llm.test_operators import url_parts, url_rule


def plain_counts(strings):
    """Counts of the n-grams of every order and of their contexts."""
    n, of = Counter(), Counter()
    for s in strings:
        x = "\0" * urls.ORDER + s + "\0"
        for i in range(urls.ORDER, len(x)):
            for k in range(urls.ORDER + 1):
                n[x[i - k : i + 1]] += 1
                of[k, x[i - k : i]] += 1
    return n, of


def plain_ratio(s, models):
    x = "\0" * urls.ORDER + s + "\0"
    total = 0
    for i in range(urls.ORDER, len(x)):
        p = [urls.UNIFORM] * 2
        for k in range(urls.ORDER + 1):
            p = [(n[x[i - k : i + 1]] + 2 * q) / (of[k, x[i - k : i]] + 2) for q, (n, of) in zip(p, models, strict=True)]
        total += math.log(p[0]) - math.log(p[1])
    return total / (len(x) - urls.ORDER)


def plain_threshold(held):
    """The middle one of the edges of bins with the best balanced accuracy."""
    width = 2 * urls.SPAN / urls.BINS
    bins = [(min(max(math.floor((r + urls.SPAN) / width), 0), urls.BINS - 1), allow) for r, allow in held]
    bad, good = ([b for b, a in bins if a == which] for which in (False, True))
    if not bad:
        return math.inf
    if not good:
        return 0.0
    worth = [sum(b >= e for b in bad) / len(bad) + sum(b < e for b in good) / len(good) for e in range(urls.BINS + 1)]
    best = [e for e, w in enumerate(worth) if w >= max(worth) - 1e-12]
    return best[len(best) // 2] * width - urls.SPAN


def fold(s):
    return (xxhash.xxh64_intdigest(s.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def test_counts_are_exact(spark):
    r = np.random.default_rng(5)
    texts = ["".join(map(chr, r.integers(33, 127, 100))) for _ in range(700)] + ["é😀é😀ü", "", "a"]
    rows = [(t, bool(i % 2)) for i, t in enumerate(texts)]
    known = urls.model(urls.count(spark.createDataFrame(rows, "s string, allow boolean")))
    want = [plain_counts(t for t, allow in rows if allow == which) for which in (False, True)]
    for k, (of_gram, of_context) in enumerate(known):
        for which in range(2):
            n, of = want[which]
            assert {x.g: x[f"g{which}"] for x in of_gram.collect() if x[f"g{which}"]} == {g: v for g, v in n.items() if len(g) == k + 1}
            assert {x.c: x[f"c{which}"] for x in of_context.collect() if x[f"c{which}"]} == {c: v for (j, c), v in of.items() if j == k}


def test_verdicts(spark):
    """All verdicts and ratios are those of a plain version; a third of the urls are one and the same."""
    r = np.random.default_rng(9)
    texts = [f"http://{['ok', 'spam', 'news', 'ça'][i % 4]}{r.integers(30)}.{['com', 'net', 'org', 'io'][r.integers(4)]}/{['en', 'es', 'fr', '😀'][r.integers(4)]}/{['page', 'casino', 'x'][r.integers(3)]}{i}" for i in range(300)]
    texts += ["http://one.org/same"] * 150 + [None, "", "nothing", "http://é.com/ü", "http://" + "a" * 3000 + ".org/"]
    known = []
    for t in texts:
        host, path = url_parts(t)
        known.append((host + path, url_rule(host, path)[1]))
    ruled = [(s, a) for s, a in known if a is not None]
    models = [plain_counts(s for s, a in ruled if a == which and fold(s) % urls.HELD_OUT) for which in (False, True)]
    cut = plain_threshold([(plain_ratio(s, models), a) for s, a in ruled if fold(s) % urls.HELD_OUT == 0])
    got = urls.judge(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string").repartition(3)).collect()
    assert len(got) == len(texts)
    for x in got:
        s, allow = known[x.page_id]
        if allow is not None:
            assert x.ratio is None and x.verdict == ("allow" if allow else "block")
        else:
            assert math.isclose(x.ratio, plain_ratio(s, models), abs_tol=1e-8)
            if abs(x.ratio - cut) > 1e-8:
                assert x.verdict == ("block" if x.ratio > cut else "allow")
    assert {x.verdict for x in got if x.ratio is not None} == {"allow", "block"}
