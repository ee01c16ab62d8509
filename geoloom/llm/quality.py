"""Quality rules: fixed base rules and a learned decision list.

Statistics are one Spark expression over a text, so nothing is exploded or
shuffled. The list is learned by sequential covering from the statistics of a
bounded sample of labelled documents and emitted as one ordered conditional
expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, let, words

#: Most labelled documents that the list is learned from, chosen by a hash of the id.
MAX_LABELLED = 6000
#: A rule is kept if it is right so often on the documents held out from growing it.
LEAST_PRECISION = 0.97
MAX_CONDITIONS, MAX_RULES, LEAST_COVER = 4, 24, 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "n_digits")


def _repeated(w: Column, n: Column) -> Column:
    """Words of the array ``w`` inside 3-word windows that the text has twice or more."""
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")))

    def starts(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
            return same(i - 1) | same(i + 1)

        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["p"]))

    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return F.when(n < 4, F.lit(0)).otherwise(let(let(F.sort_array(grams), starts), covered))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def statistics(text: Column) -> Column:
    """The counts of a text as one struct of longs.

    n_words, word_chars (code points in words), n_symbols (#*$%&|<>),
    n_dup_lines (lines with a word that equal an earlier line), n_repeat_words
    (words in 3-word windows found twice or more), n_distinct (words), n_upper
    (A-Z), n_marks (!?), n_digits. Null text counts as empty; all are then 0.
    """

    def of(t: Column) -> Column:
        def counts(w: Column) -> Column:
            n = F.size(w)
            values = [
                n,
                F.char_length(F.array_join(w, "")),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
                _dup_lines(t),
                _repeated(w, n),
                F.size(F.array_distinct(w)),
                F.regexp_count(t, F.lit("[A-Z]")),
                F.regexp_count(t, F.lit("[!?]")),
                F.regexp_count(t, F.lit("[0-9]")),
            ]
            return F.struct(*[v.cast("long").alias(c) for c, v in zip(COUNTS, values, strict=True)])

        return let(words(t), counts)

    return let(F.coalesce(text, F.lit("")), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


#: What the learned conditions compare: parts of one count in another.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "duplicate_lines_per_word": ("n_dup_lines", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_case": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits": ("n_digits", "word_chars"),
}


def feature(s: Column, name: str) -> Column:
    over, under = FEATURES[name]
    return F.when(s[under] > 0, s[over] / s[under]).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.name] > self.threshold if self.above else row[self.name] <= self.threshold

    def column(self, s: Column) -> Column:
        value = feature(s, self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]
Row = tuple[dict[str, float], bool]


def _best(rows: list[Row], before: float) -> tuple[float, Condition] | None:
    """The condition with the largest information gain on ``rows``."""
    best = None
    bad = sum(y for _, y in rows)
    for name in FEATURES:
        values = sorted((x[name], y) for x, y in rows)
        low_bad = 0
        for i in range(len(values) - 1):
            low_bad += values[i][1]
            if values[i][0] == values[i + 1][0]:
                continue
            low = i + 1
            for above, p, n in ((False, low_bad, low), (True, bad - low_bad, len(values) - low)):
                if p and (gain := p * (log2(p / n) - before)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, Condition(name, above, (values[i][0] + values[i + 1][0]) / 2)
    return best


def _grow(rows: list[Row]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        bad = sum(y for _, y in rows)
        if not bad or bad == len(rows) or not (found := _best(rows, log2(bad / len(rows)))):
            break
        rule += (found[1],)
        rows = [r for r in rows if found[1].holds(r[0])]
    return rule


def _prune(rule: Rule, rows: list[Row]) -> tuple[Rule, int, int]:
    """The leading part of the rule that is best on held-out rows, with its bad and all covered rows."""
    scored = []
    for k in range(1, len(rule) + 1):
        hit = [y for x, y in rows if all(c.holds(x) for c in rule[:k])]
        p, n = sum(hit), len(hit)
        scored.append(((2 * p - n) / n if n else -1.0, -k, p, n))
    _, k, p, n = max(scored)
    return rule[:-k], p, n


def learn(rows: list[tuple[int, dict[str, float], bool]]) -> list[Rule]:
    """An ordered list of rules that reject; what no rule rejects is kept.

    rows: (a number to split by, features, whether the label is bad). Each turn
    grows a conjunction on two thirds of the rows left, prunes it on the
    rest and drops what it covers; it ends with the first rule that isn't
    precise enough there.
    """
    rules: list[Rule] = []
    grow = [(x, y) for k, x, y in rows if k % 3]
    hold = [(x, y) for k, x, y in rows if not k % 3]
    while len(rules) < MAX_RULES and any(y for _, y in grow):
        if not (rule := _grow(grow)):
            break
        rule, p, n = _prune(rule, hold)
        if n < LEAST_COVER or p < LEAST_PRECISION * n:
            break
        rules.append(rule)
        grow, hold = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (grow, hold))
    return rules


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> list[tuple[int, dict[str, float], bool]]:
    """Statistics of at most ``most`` labelled documents, those with the least hash of their id.

    Labels without id or quality, and ids with labels that differ, are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    chosen = known.select(F.col("doc_id").alias("id"), (F.col("low") == 0).alias("bad"), F.xxhash64("doc_id").alias("k")).orderBy("k", "id").limit(most)
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id")
    s = joined.select("k", "id", "bad", statistics(F.col("t")).alias("s"))
    s = s.orderBy("k", "id", "s").limit(most).select("k", "bad", *[feature(F.col("s"), f).alias(f) for f in FEATURES])
    return [(r["k"] % 1009, {f: r[f] for f in FEATURES}, r["bad"]) for r in s.collect()]


def rejects(s: Column, rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that fires, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        fires = rule[0].column(s)
        for c in rule[1:]:
            fires = fires & c.column(s)
        out = out.when(fires, F.lit(i))
    return out


def _kept(s: Column, rules: list[Rule]) -> Column:
    return ~base_failed(s) & rejects(s, rules).isNull()


def judge(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, rule (that rejects, or null) and kept for every row.

    Null and empty texts have no words, so the base rules reject them. Rows
    that repeat are judged alike; a value equal to a threshold is not above it. A very
    long text is an array of its words in one row of its task. Other columns are not read. An empty table gives no rows; without
    labelled documents the list is empty and the base rules decide.
    """
    whole = docs.select(
        F.col(doc_id).alias("doc_id"),
        let(statistics(F.col(text)), lambda s: F.struct(*[s[c].alias(c) for c in COUNTS], base_failed(s).alias("base_failed"), rejects(s, rules).alias("rule"), _kept(s, rules).alias("kept"))).alias("s"),
    )
    return whole.select("doc_id", "s.*")


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that neither the base rules nor the list reject, with the columns of ``docs``."""
    name = fresh(docs, "kept")[0]
    return docs.withColumn(name, let(statistics(F.col(text)), lambda s: _kept(s, rules))).filter(F.col(name)).drop(name)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, learn(sample(docs, labels))).drop("n_distinct", "n_upper", "n_marks", "n_digits", "rule")
