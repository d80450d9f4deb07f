"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

All that is learned comes from a bounded sample of labelled rows (``max_rows``). Its texts are dealt into parts, and the lexicon
that describes a part's rows comes from the other parts, so that no row is judged by terms that it brought in itself; texts to
judge meet the lexicon of all parts. A third of the sample calibrates the trees that the rest gives.
Lexicons are terms (words, and word beginnings of two lengths, as insults are inflected) that mark toxic documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playwatch.llm.common import slices, texts, written

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are terms beside whole words.
STEMS = (5, 4)
#: Parts of the sample, with a lexicon each from the others, and every how many texts one calibrates; without a common divisor.
LEXICONS, JUDGES = 5, 3
#: Words between a lexicon word and a second person for the two to count as near.
NEAR = 5
# Second-person words of the four languages.
SECOND = frozenset(
    "you your yours yourself youre u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros".split()
)
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$*][^\W\d_]|(\w)\1{2}|\b(?:\w[ .\-]){3,}\w\b")
FEATURES = [
    "words_log", "lexicon", "lexicon_log", "stem5", "stem5_log", "stem4", "strongest", "second", "near_second",
    "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated",
]


def terms(word: str) -> list[str]:
    """The terms of a lower-cased word: itself, and its beginnings where it is longer, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """FEATURES of a text; all zero for the empty text. ``lexicon`` maps terms to their log-odds."""
    words = WORD.findall(text)
    n, size = len(words) or 1, len(text) or 1
    lower = list(map(str.lower, words))
    hits = {w: [lexicon.get(t) for t in (w, w[: STEMS[0]] + "-", w[: STEMS[1]] + "-")] for w in set(lower)}
    hits = {w: v for w, v in hits.items() if any(x is not None for x in v)}
    seconds = [i for i, w in enumerate(lower) if w in SECOND]
    counts, strongest, near = [0, 0, 0], 0.0, 0
    for i, w in enumerate(lower) if hits else ():
        if v := hits.get(w):
            for k, x in enumerate(v):
                counts[k] += x is not None
            strongest = max(strongest, *(x or 0.0 for x in v))
            k = bisect_left(seconds, i - NEAR)
            near += k < len(seconds) and seconds[k] <= i + NEAR
    marks = size - sum(map(len, words)) - text.count(" ") - text.count("\n")
    return [
        math.log1p(len(words)), counts[0] / n, math.log1p(counts[0]), counts[1] / n, math.log1p(counts[1]), counts[2] / n, strongest,
        len(seconds) / n, near / n, sum(map(str.isupper, text)) / size, sum(w.isupper() and len(w) > 2 for w in words) / n,
        text.count("!") / size, text.count("?") / size, max(marks, 0) / size if text else 0.0,
        sum(1 for _ in OBFUSCATED.finditer(text)) / n,
    ]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels nothing learns from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text, toxic, part (0 to LEXICONS - 1) and judge of at most ``max_rows`` labelled documents, the first in a hash order.

    Texts are dealt by hash, equal ones alike. The least hash of a class is never a judge's and its greatest always is: with two
    different texts or more a class stands among both, however few rows there are. Of several texts of one doc_id the least counts.
    """
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # bounded by max_rows
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("id"))
    rows = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    draws = rows.select("doc_id", "toxic", F.xxhash64("text").alias("draw"))
    # a row a class
    ends = draws.groupBy("toxic").agg(F.min("draw").alias("least"), F.max("draw").alias("most"))
    judge = (F.col("draw") == F.col("most")) | ((F.col("draw") != F.col("least")) & (F.pmod("draw", F.lit(JUDGES)) == 0))
    dealt = draws.join(F.broadcast(ends), "toxic").select("doc_id", F.pmod("draw", F.lit(LEXICONS)).cast("int").alias("part"), judge.alias("judge"))
    # at most max_rows narrow rows
    return rows.join(F.broadcast(dealt), "doc_id").select("doc_id", "text", "toxic", "part", "judge")


def term_counts(rows: DataFrame) -> DataFrame:
    """term, and for each part and class the documents that hold it (n<part>_<toxic>). rows: text, toxic, part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text, toxic, part in zip(texts(batch["text"]), batch["toxic"].to_pylist(), batch["part"].to_pylist(), strict=True):
                found.update((t, toxic, part) for t in {t for w in set(WORD.findall(text.lower())) for t in terms(w)})
            keys = [pa.array([k[i] for k in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found.values(), pa.int64())], ["term", "toxic", "part", "n"])

    seen = rows.select("text", "toxic", "part").mapInArrow(count, "term string, toxic int, part int, n long")
    cells = [(p, y) for p in range(LEXICONS) for y in (0, 1)]
    return seen.groupBy("term").agg(*(F.sum(F.when((F.col("part") == p) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{p}_{y}") for p, y in cells))


def learned_lexicon(counts: DataFrame, totals: dict[tuple[int, int], int], without: int | None, size: int, least_docs: int = 3) -> dict[str, float]:
    """The ``size`` terms that mark toxic rows best by the G-test, with smoothed log-odds, of all parts or ``without`` one.

    counts: see term_counts; totals: rows by part and class.
    """
    parts = [p for p in range(LEXICONS) if p != without]
    good, bad = (sum(totals.get((p, y), 0) for p in parts) for y in (0, 1))
    if not bad or not good:
        return {}
    b, a = (sum((F.col(f"n{p}_{y}") for p in parts), F.lit(0)) for y in (0, 1))
    seen = counts.select("term", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.1) / (bad - a + 0.5)) - F.log((b + 0.1) / (good - b + 0.5))
    both = F.lit(float(bad + good))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = part(a, (a + b) * bad / both) + part(b, (a + b) * good / both) + part(bad - a, bad - (a + b) * bad / both) + part(good - b, good - (a + b) * good / both)
    best = seen.filter((a >= least_docs) & (a * good > 20 * b * bad)).select("term", odds.alias("odds"), g.alias("g"))
    return {r[0]: float(r[1]) for r in best.orderBy(F.desc("g"), "term").limit(size).collect()}


def with_features(rows: DataFrame, lexicons: list[dict[str, float]], keep: dict[str, str]) -> DataFrame:
    """The columns ``keep`` (name -> type) of rows and FEATURES of their text, by the lexicon that the column part names."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)
    kinds = ", ".join([f"{c} {k}" for c, k in keep.items()] + [f"{f} double" for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [features(t, shared.value[p]) for t, p in zip(texts(part["text"]), part["part"].to_pylist(), strict=True)]
                columns = [pa.array(list(c), pa.float64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *columns], [*keep, *FEATURES])

    return rows.select(*keep, "text", "part").mapInArrow(run, kinds)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 30_000, lexicon_size: int = 3000) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every document.

    Scores depend on the text alone. Null and empty texts have zero features and get the score of such; a very long text is all its
    words, held by one task; a null doc_id is not held out and learns nothing; repeated rows pass through, a row each; a doc_id
    labelled twice counts as toxic if either row says so. Where the sample has fewer than two different texts of a class, every score
    is the share of toxic rows in it (0 for none). Other columns are not read. An empty table gives no rows.
    """
    rows = written(training_rows(docs, labels, max_rows), "dealt")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    sizes = rows.groupBy("part", "judge", "toxic").count().collect()
    if len({(r["judge"], r["toxic"]) for r in sizes}) < 4:
        total = sum(r["count"] for r in sizes)
        share = sum(r["count"] for r in sizes if r["toxic"] == 1) / total if total else 0.0
        flat = docs.select(F.col("doc_id").cast("long"), out, F.lit(share).alias("score"))
        return flat.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    totals: Counter = Counter()
    for r in sizes:
        totals[r["part"], r["toxic"]] += r["count"]
    counts = written(term_counts(rows), "terms")
    # the last is of all parts and for the documents to judge
    lexicons = [learned_lexicon(counts, totals, without, lexicon_size) for without in (*range(LEXICONS), None)]
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    known = gather.transform(written(with_features(rows, lexicons, {"toxic": "int", "judge": "boolean"}).coalesce(4), "features"))
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=15, maxDepth=3, stepSize=0.3, maxBins=32, seed=1)
    model = trees.fit(known.filter("NOT judge").select("toxic", "features"))
    raw = vector_to_array(F.col("probability"))[1]
    judged = model.transform(known.filter("judge")).select(raw.alias("raw"), F.col("toxic").cast("double").alias("toxic"))
    steps = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="score").fit(judged)
    scored = with_features(docs.select(F.col("doc_id").cast("long"), "text", F.lit(LEXICONS).alias("part")), lexicons, {"doc_id": "long"})
    scored = model.transform(gather.transform(scored)).select("doc_id", raw.alias("raw"))
    scored = steps.transform(scored).select("doc_id", out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
