"""License scans by diagonal voting.

The k-gram hashes of all documents are joined to their places in the
templates. A hit votes for its diagonal, the offset between the two places;
neighbouring diagonals are merged, as a word put in or left out shifts the rest
by one. A span is verified by how much of the template its hits cover, in a
stretch of the document not much longer than the template, and by the words
that tell licenses apart (MARKS and version numbers): those in the stretch must be
those of the template. Of overlapping spans with different labels the best stays.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import let
from geoloom.llm.license_texts import TEMPLATES

#: Words of a rolling hash; diagonals that far apart are merged; part of the template to be covered; stretch of a span.
GRAM, NEAR, COVER, STRETCH = 4, 3, 0.7, 1.5

#: Phrases that decide by themselves.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Words that tell licenses with nearly equal notices apart, by their spellings.
MARKS = {
    "affero": "affero", "lesser": "lesser",
    "noncommercial": "nc", "commercial": "nc", "nc": "nc",
    "sharealike": "sa", "alike": "sa", "sa": "sa",
    "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd", "derivs": "nd", "nd": "nd",
}

_LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of a word, with A-Z as they are lower-cased
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _pattern(phrase: str) -> str:
    return f"(?<!{_LETTER})" + _GAP.join(phrase.split()) + f"(?!{_LETTER})"


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_LETTER + "+")).cast("long")


def marks_of(w: list[str]) -> list[str]:
    """The marks of a template's words, sorted: of MARKS, and the number after ``version`` or ``v``."""
    versions = {f"version {b}" for a, b in zip(w, w[1:], strict=False) if a in ("version", "v") and re.fullmatch("[0-9]+", b)}
    return sorted(versions | {MARKS[x] for x in w if x in MARKS})


def _split(text: Column) -> Column:
    """The words as they stand; to split at gaps is faster than to match words."""
    return F.filter(F.split(text, _GAP, -1), lambda w: w != "")


def _words(text: Column) -> Column:
    """The words, with A-Z alone lower-cased: of a word with other letters (as the Kelvin sign) :func:`pyspark.sql.functions.lower` would change those too."""

    def one(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, ascii_uppercase, ascii_lowercase))

    return F.transform(_split(text), one)


def _marks(words: Column) -> Column:
    """n_words, and marked: place and mark of every such word; the few words that can be one are picked first."""
    known = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])

    def picked(x: Column) -> Column:
        return x.isin(*MARKS) | ((x >= "0") & (x < ":") & F.regexp_like(x, F.lit("^[0-9]+$")))

    def mark(w: Column, m: Column) -> Column:
        number = F.when((m["place"] > 0) & F.get(w, m["place"] - 1).isin("version", "v") & (m["word"] < ":"), F.concat(F.lit("version "), m["word"]))
        return F.struct(m["place"].alias("place"), F.coalesce(known[m["word"]], number).alias("mark"))

    def of(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(picked(x), F.struct(i.alias("place"), x.alias("word")))), lambda m: m.isNotNull())
        return F.filter(F.transform(places, lambda m: mark(w, m)), lambda m: m["mark"].isNotNull())

    return F.struct(F.size(words).cast("long").alias("n_words"), of(words).alias("marked"))


def chosen(found: Column, marks: Column) -> Column:
    """Of the spans of a document those with the marks of their template that no better one of another label overlaps."""

    def right(s: Column) -> Column:
        inside = F.filter(marks, lambda m: (m["place"] >= s["from"]) & (m["place"] <= s["to"]))
        return F.array_sort(F.array_distinct(F.transform(inside, lambda m: m["mark"]))) == s["marks"]

    def best(all_: Column, s: Column) -> Column:
        beats = lambda o: (o["label"] != s["label"]) & (o["first"] <= s["last"]) & (s["first"] <= o["last"]) & (F.struct(o["score"], o["covered"]) > F.struct(s["score"], s["covered"]))
        return ~F.exists(all_, beats)

    return let(F.filter(found, right), lambda all_: F.filter(all_, lambda s: best(all_, s)))


def base(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base (array of labels), marked (places and marks) for (doc_id, k, t).

    No phrase starts with words that end another, so one pattern finds all places.
    """
    starts = "".join(sorted({p[0] for p in PHRASES.values()}))  # most places are not one by their first letter
    any_of = f"(?i)(?=[{starts}])(?:" + "|".join(_pattern(p) for p in PHRASES.values()) + ")"
    t, n = F.col("t"), F.col("n_base")
    rows = docs.withColumn("n_base", F.regexp_count(t, F.lit(any_of)).cast("long"))
    before = lambda how: F.when(n > 0, _count(F.regexp_extract(t, f"(?s)^({how})(?={any_of})", 1)))
    labels = F.filter(F.array(*[F.when((n > 0) & F.regexp_like(t, F.lit(f"(?i){_pattern(p)}")), F.lit(label)) for label, p in PHRASES.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("w", let(_words(t), _marks))
    return rows.select("doc_id", "k", "w.n_words", "n_base", before(".*?").alias("first_word"), before(".*").alias("last_word"), labels.alias("base"), "w.marked")


def templates(spark: SparkSession, wordings: list[tuple[str, str]]) -> DataFrame:
    """g (k-gram hash), template, label, n (words), marks, at for every place of the templates; as many rows as they have words."""
    rows = []
    for i, (label, text) in enumerate(wordings):
        w = words_of(text)
        rows += [(*w[at : at + GRAM], i, label, len(w), marks_of(w), at) for at in range(len(w) - GRAM + 1)]
    names = [f"w{i}" for i in range(GRAM)]
    schema = ", ".join([*(f"{x} string" for x in names), "template int", "label string", "n int", "marks array<string>", "at int"])
    return spark.createDataFrame(rows, schema).select(F.xxhash64(*names).alias("g"), "template", "label", "n", "marks", "at")


def spans(docs: DataFrame, wordings: list[tuple[str, str]]) -> DataFrame:
    """Covered spans of (doc_id, k, t): doc_id, k, label, score, first, last (words from 0), covered, marks, from, to (where the whole template would stand)."""

    def grams(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)]))
        return F.when(F.size(w) >= GRAM, hashes).otherwise(F.array().cast("array<bigint>"))

    rolled = docs.select("doc_id", "k", F.posexplode(let(_words(F.col("t")), grams)).alias("place", "g"))
    known = templates(docs.sparkSession, wordings)  # bounded by the templates
    votes = rolled.join(F.broadcast(known), "g").withColumn("diagonal", F.col("place") - F.col("at"))
    # the hits of a diagonal are as many as its template has words at most; rows that repeat vote once
    lines = votes.groupBy("doc_id", "k", "template", "label", "n", "marks", "diagonal").agg(F.collect_set("at").alias("hits"))
    in_order = Window.partitionBy("doc_id", "k", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > NEAR, F.lit(True))
    merged = lines.withColumn("new", apart.cast("int")).withColumn("group", F.sum("new").over(in_order))
    places = F.flatten(F.collect_list(F.transform("hits", lambda h: F.col("diagonal") + h)))
    whole = merged.groupBy("doc_id", "k", "template", "label", "n", "marks", "group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), places.alias("places"))
    covered = F.aggregate(F.transform("hits", lambda h, i: F.least(F.lit(GRAM), F.coalesce(F.get("hits", i + 1) - h, F.lit(GRAM)))), F.lit(0), lambda a, b: a + b)
    first, last = F.array_min("places"), F.array_max("places") + GRAM - 1
    whole_from, whole_to = first - F.array_min("hits"), last + F.col("n") - GRAM - F.array_max("hits")
    found = whole.select("doc_id", "k", "label", "n", (covered / F.col("n")).alias("score"), first.alias("first"), last.alias("last"), covered.alias("covered"), "marks", whole_from.alias("from"), whole_to.alias("to"))
    return found.filter((F.col("score") >= COVER) & (F.col("last") - F.col("first") + 1 <= STRETCH * F.col("n") + NEAR)).drop("n")


def scan(docs: DataFrame, wordings: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row.

    score is 1 if a phrase stands in the text, else the largest part of a
    template that a verified span covers, else 0. Null and empty texts have no
    words, no labels and score 0. Rows that repeat are labelled alike. Of overlapping spans
    that score the same both stay. Very long texts are split into words whole. Other columns are not read. An
    empty table gives no rows. spans: label, score, first and last word.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = spans(d, wordings).groupBy("doc_id", "k").agg(F.collect_list(F.struct("label", "score", "first", "last", "covered", "marks", "from", "to")).alias("found")).withColumnsRenamed({"doc_id": "d2", "k": "k2"})
    rows = base(d).join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2")), "left")
    rows = rows.withColumn("spans", F.transform(chosen(F.col("found"), F.col("marked")), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score"), s["first"].alias("first"), s["last"].alias("last"))))
    more = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", more)).alias("labels"), F.least(score, F.lit(1.0)).alias("score"), "spans")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
