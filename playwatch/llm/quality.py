"""Quality rules with a verdict on each host: failures are counted by domain, rates shrunk, verdicts joined back.

Each document is held against rules of its own (base and further ones). A host's failure rate is shrunk towards the corpus
with an empirical beta prior: a / (a + b) is the mean of the hosts' rates and a + b follows from their spread (method of
moments), so that a host with few documents is judged near the mean. A host whose shrunk rate passes ``max_rate`` goes whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playwatch.llm.common import word_array, written

WINDOW = 8
#: Bounds of a + b: a corpus of like hosts is all prior, one of unlike hosts still keeps the weight of one document.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0


def repeated_words(words: Column) -> tuple[Column, Column, Column, Column]:
    """Steps to the words that lie in windows of WINDOW words found twice or more in the array, the first finding included.

    Returns the windows' hashes (to be named __marks), whether two are alike, the hashes sorted with their places (to be named
    __placed), and the number of words that the repeated windows cover. Only texts with two windows alike take the last steps.
    """
    last = F.size(words) - (WINDOW - 1)
    marks = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    alike = F.size(F.array_distinct(F.col("__marks"))) < F.size("__marks")
    placed = F.array_sort(F.transform(F.col("__marks"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, y: F.element_at(F.col("__placed"), x)["h"] == F.element_at(F.col("__placed"), y)["h"]
    at = F.array_sort(
        F.transform(
            F.filter(
                F.sequence(F.lit(1), F.size("__placed")),
                lambda k: ((k > 1) & same(F.greatest(k - 1, F.lit(1)), k)) | ((k < F.size("__placed")) & same(k, F.least(k + 1, F.size("__placed")))),
            ),
            lambda k: F.element_at(F.col("__placed"), k)["i"],
        )
    )
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["p"])).alias("n"), i.alias("p")),
        lambda a: a["n"],
    )
    return marks, alike, placed, covered


def document_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each text, base_failed and failed (base or one of the further rules)."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.withColumn("__words", word_array(F.col("__text")))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    d = d.withColumn("__lines", lines).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).withColumn("__n_lines", F.size("__lines").cast("long"))
    marks, alike, placed, covered = repeated_words(F.col("__words"))
    d = d.withColumn("__marks", F.when(F.col("n_words") >= WINDOW, marks))
    d = d.withColumn("__placed", F.when(alike, placed))
    d = d.withColumn("n_repeat_words", F.when(F.col("__placed").isNotNull(), covered).otherwise(0).cast("long"))
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    d = d.withColumn("base_failed", (n < 20) | (100 * repeats > 30 * n))
    more = (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n) | (5 * F.col("n_symbols") > n) | (2 * F.col("n_dup_lines") > F.col("__n_lines"))
    return d.withColumn("failed", F.col("base_failed") | more).drop("__words", "__lines", "__marks", "__placed", "__n_lines")


def host_verdicts(judged: DataFrame, max_rate: float) -> DataFrame:
    """__host, host_rate (shrunk) and host_failed of every host, from documents with __host and failed.

    The prior: m = all failures / all documents; v = the mean squared distance of the hosts' rates from m, each weighted by
    its documents; of that, m(1 - m) times hosts / documents is chance. a + b = m(1 - m) / (v - chance) - 1, within bounds;
    the largest bound where hosts differ by no more than chance.
    """
    hosts = judged.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    whole = hosts.agg(
        F.sum("n").alias("N"), F.sum("k").alias("K"), F.count(F.lit(1)).alias("H"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("S")
    )
    n, k, h, squares = whole.first()
    if not n:
        return hosts.select("__host", F.lit(0.0).alias("host_rate"), F.lit(False).alias("host_failed"))
    m = k / n
    spread = squares / n - m * m - m * (1 - m) * h / n
    weight = MOST_PRIOR if spread <= 0 else max(LEAST_PRIOR, min(MOST_PRIOR, m * (1 - m) / spread - 1))
    rated = hosts.select("__host", ((F.col("k") + m * weight) / (F.col("n") + weight)).alias("host_rate"))
    return rated.withColumn("host_failed", F.col("host_rate") > max_rate)


def quality_verdicts(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, host_rate and kept of every document.

    ``kept`` is false if base_failed, else what its host's verdict says. A null or empty text has no words and fails; a very long one
    is judged whole, by sorting the hashes of its windows within its row; a null
    host is a host of its own; a null doc_id and repeated rows pass through, a row each, repeated rows counting as often as
    they stand. An empty table gives no rows. Other columns are not read.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("__text"), F.col(host).alias("__host"))
    # counts without texts, written once: hosts are counted and documents judged from the same rows
    judged = written(document_rules(own).select(*names, "failed", "__host"), "judged")
    hosts = host_verdicts(judged, max_rate).withColumnRenamed("__host", "__its")
    joined = judged.join(hosts, F.col("__host").eqNullSafe(F.col("__its")), "left")
    return joined.select(*names, "host_rate", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))


def kept_documents(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that quality_verdicts keeps, with all their columns as they are.

    Rows are judged by their own text, so repeated rows of one doc_id are kept or not each by itself.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text").alias("__text"), F.col(host).alias("__host"))
    # judged once and written with its row: hosts are counted and documents filtered from there
    judged = written(document_rules(own).select("__row", "__host", "base_failed", "failed"), "judged")
    # written, so that Spark knows how small they are and broadcasts them, where else it would shuffle all documents by host
    hosts = host_verdicts(judged.select("__host", "failed"), max_rate).filter("host_failed").select(F.col("__host").alias("__its"))
    hosts = written(hosts, "hosts")
    return judged.filter("NOT base_failed").join(hosts, F.col("__host").eqNullSafe(F.col("__its")), "left_anti").select("__row.*")
