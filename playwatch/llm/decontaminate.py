"""Benchmark passages in documents: a set join that meets a window of an item at its rarest shingle alone.

An item's windows are its runs of ``width`` words (a shorter item is one window). A window that stands in a document brings all its
shingles along, so one of them is prefix enough, as containment must be whole; the one that the documents hold least often is joined.
How often a shingle stands is counted over all documents, for shingles of the benchmark only. A window whose rarest shingle stands
nowhere goes at once. A document offers the places of prefix shingles with the words about them; after the join the shingle's offset
gives the window's place, which must lie within the document, and its words are compared one by one.

Which shingles a document offers is told by a bitmap of hash bits, at most MOST_BITS whatever the benchmark holds: a larger benchmark
lets more places through that the join drops, and results stay the same. No text is exchanged but those words, and no benchmark
passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playwatch.llm.common import slices, written
from playwatch.llm.probminhash import WordHashes, mix

#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 3
#: Bounds of a bitmap's bits: 16 MiB at most are broadcast, and two million words of it pass the driver.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Parts of a key that a third of all rows may hold; the benchmark's side is repeated as often.
SALTS = 16
#: Places of one document that a row carries at most.
ROW_SPOTS = 1024

#: Bytes of words as they are compared: A-Z in lower case, 0-9, a-z and all beyond U+007F; any other byte parts words.
WORD_BYTES = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def compared_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = mix(h * np.uint64(5) ^ words[k : n + k])
    return h


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id (string), words (joined by a space), n and shingles (hashes by offset) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                for item, text in zip(part["item_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    words = compared_words(text)
                    n = min(width, len(words))
                    size = min(SHINGLE, n)
                    own = shingle_hashes(hashes.of(words), size).view(np.int64)
                    places = range(len(words) - n + 1) if n else range(0)
                    for at in range(0, len(places), 4096):
                        some = places[at : at + 4096]
                        columns = [
                            pa.array([item] * len(some), pa.string()),
                            pa.array([b" ".join(words[p : p + n]) for p in some], pa.binary()).cast(pa.string()),
                            pa.array([n] * len(some), pa.int32()),
                            pa.array([own[p : p + n - size + 1] for p in some], pa.list_(pa.int64())),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["item_id", "words", "n", "shingles"])

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item_id string, words string, n int, shingles array<long>")


class Bitmap:
    """Which hashes may be among those of a table: no hash of it is missed."""

    def __init__(self, hashes: DataFrame, column: str):
        count = hashes.count()
        bits = LEAST_BITS
        while bits < min(MOST_BITS, 64 * count):
            bits *= 2
        self.mask = np.uint64(bits - 1)
        low = F.col(column).bitwiseAND(F.lit(bits - 1))
        one = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
        cells = hashes.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
        self.cells = np.zeros(bits // 64, np.uint64)
        self.cells[np.asarray(cells["cell"])] = np.asarray(cells["bits"]).view(np.uint64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes & self.mask
        return (self.cells[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def shingle_counts(texts: DataFrame, shared, sizes: list[int]) -> DataFrame:
    """hash and n: how often the shingles that a bitmap lets through stand in all texts, counted by batch before they are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashes = shared.value, WordHashes()
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for part in slices(batch):
                for text in part["text"].cast(pa.binary()).to_pylist():
                    words = hashes.of(compared_words(text))
                    for size in sizes:
                        own = shingle_hashes(words, size)
                        found.append(own[bitmap.may_hold(own)])
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


SPOT = pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("near", pa.binary())])


def document_spots(docs: DataFrame, shared, sizes: list[int], width: int) -> DataFrame:
    """uid, doc_id, n_words and spots of every document: where a shingle that the bitmap lets through stands, and the words about it.

    A document of many spots goes on in further rows of its uid, whose n_words is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashes = shared.value, WordHashes()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                uids, ids, ns, spots = [], [], [], []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    words = compared_words(text)
                    known, own = hashes.of(words), []
                    for size in sizes:
                        grams = shingle_hashes(known, size)
                        for at in np.flatnonzero(bitmap.may_hold(grams)).tolist():
                            low = max(0, at - width + 1)
                            own.append({"hash": int(grams[at].view(np.int64)), "at": at, "before": at - low, "near": b" ".join(words[low : at + width])})
                    for cut in range(0, max(1, len(own)), ROW_SPOTS):
                        uids.append(uid)
                        ids.append(doc)
                        ns.append(None if cut else len(words))
                        spots.append(own[cut : cut + ROW_SPOTS])
                    uid += 1
                columns = [pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(spots, pa.list_(SPOT))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_words", "spots"])

    kinds = "uid long, doc_id long, n_words long, spots array<struct<hash:bigint,at:bigint,before:int,near:binary>>"
    return docs.mapInArrow(run, kinds)


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, owners): uid, doc_id and n_words of every document; uid, start, n and words of every window found in one, with
    start the number of its first word; and the item_ids of each window's words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    windows = written(item_windows(benchmark, width), "windows")
    distinct = written(windows.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "distinct")
    shingles = distinct.select("words", "n", F.posexplode("shingles").alias("offset", "hash"))
    sizes = sorted(r[0] for r in distinct.select(F.least("n", F.lit(SHINGLE))).distinct().collect())
    bitmap = spark.sparkContext.broadcast(Bitmap(shingles.select("hash").distinct(), "hash"))
    counts = shingle_counts(texts.select("text"), bitmap, sizes)
    # one necessary shingle a window, the rarest; a window that holds one which stands nowhere is in no text
    first = shingles.join(counts.withColumnRenamed("n", "often"), "hash", "left").groupBy("words", "n")
    first = first.agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "hash", "offset")).alias("p")).filter("p.often > 0")
    prefixes = written(first.select("words", "n", "p.hash", "p.offset"), "prefixes")
    bitmap = spark.sparkContext.broadcast(Bitmap(prefixes.select("hash").distinct(), "hash"))
    spotted = written(document_spots(texts, bitmap, sizes, width), "spots")
    spots = spotted.select("uid", F.explode("spots").alias("s")).select("uid", "s.*").withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int"))
    met = spots.join(salted(prefixes), ["hash", "salt"])
    # the window's place among the words about the shingle, within which it must lie
    place = F.col("before") - F.col("offset")
    near = F.split(F.col("near").cast("string"), " ")
    met = met.filter((place >= 0) & (place + F.col("n") <= F.size(near)))
    met = met.filter(F.array_join(F.slice(near, F.greatest(place, F.lit(0)) + 1, F.col("n")), " ") == F.col("words"))
    hits = met.select("uid", (F.col("at") - F.col("offset")).alias("start"), "n", "words")
    documents = spotted.filter("n_words IS NOT NULL").select("uid", "doc_id", "n_words")
    return documents, hits, windows.select("words", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a window of an item), items (their ids, sorted as strings) and contaminated of every document.

    Words are lower-cased (A-Z) and are runs of 0-9, a-z and characters beyond U+007F. A null or empty text has no words and no hits, and
    a null or empty item no windows. An item without an id has windows that hit words, and names no item; repeated items count once. A
    very long text is read whole, in one row's work. Null doc_ids and repeated rows pass through, a row each. No documents give no rows,
    no items no hits. Other columns are not read.
    """
    documents, hits, owners = benchmark_hits(docs, benchmark, width)
    hits = written(hits, "hits")
    spans = hits.groupBy("uid", "start").agg(F.max("n").alias("n")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("n").cast("long").alias("n")))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    grown = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], s["start"] + s["n"]).alias("to"))
    covered = spans.select("uid", F.aggregate("spans", start, grown, lambda a: a["n"]).alias("n_hit"))
    named = hits.select("uid", "words").distinct().withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int"))
    named = named.join(salted(owners.filter("item_id IS NOT NULL")), ["words", "salt"]).groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = covered.join(named, "uid", "left")
    out = documents.join(found, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def contamination_digests(found: DataFrame) -> DataFrame:
    """The rows of ``contamination`` with its items as a count and a digest."""
    items = F.col("items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")

