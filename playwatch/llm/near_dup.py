"""Near-duplicate documents: ProbMinHash signatures of weighted five-word shingles, banding, exact verification, classes.

Equal texts collapse first, so a group of copies is one text from then on. Each text's signature is cut into BANDS bands of
ROWS registers; texts that agree in a band share a bucket. Two rounds find the links (probability Jaccard of at least the
threshold, computed exactly):

1. star: a bucket's members are held against the one that meets most others over all bands, in a rule the text that the others
   were copied from. Links give classes.
2. rest: in buckets that still hold several classes, texts of different classes are held against each other, without the star's
   pairs, once for all the bands that a pair shares, and first by their registers. Large buckets are dealt out in tiles, pairs of
   which meet in separate tasks. So no pair of a bucket is left out unless a class joins it already, and tasks pass on links only.

Shingles are folded to 32 bits for verification, which changes a similarity by about one in 10^5 at most.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playwatch.llm.common import slices, texts, written
from playwatch.llm.probminhash import WordHashes, mix, probability_jaccard, shingles, signatures

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Members of a bucket, and bytes of their shingles, that one task compares; larger buckets are dealt into tiles of about this size.
TILE, TILE_BYTES = 2048, 32 << 20
#: A pair whose registers agree less than the threshold by this much is not compared. Of 120 registers those that agree are binomial,
#: so at a similarity of 0.8 this loses a pair in 10 ** 10.
SLACK = 0.25
#: Texts that meet one representative in one task.
STAR = 10_000


#: What separates words; str.split alone would split at further characters.
WORDS = re.compile("[^ \\t-\\r]+")
INNER = re.compile("[\\x1c-\\x1f]")


def words_of(text: str) -> list[str]:
    return text.split() if text.isascii() and not INNER.search(text) else WORDS.findall(text)


def text_shingles(batch: pa.RecordBatch, hashes: WordHashes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found = [shingles(hashes.of(words_of(t))) for t in texts(batch["text"])]
    return [e for e, _ in found], [w for _, w in found]


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """[texts, BANDS]: a hash of each band's registers and its number."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix((h << np.uint64(1)) ^ mix(parts[:, :, k]))
    return h.view(np.int64)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, uid (128 bits of the text) and bands of every document; bands are null where a text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                elements, weights = text_shingles(part, hashes)
                sizes = np.array([len(e) for e in elements])
                some = np.flatnonzero(sizes)
                bands: list = [None] * part.num_rows
                if len(some):
                    got = band_hashes(signatures(np.concatenate(elements), np.concatenate(weights), sizes[some], REGISTERS))
                    for i, row in zip(some.tolist(), got, strict=True):
                        bands[i] = row
                keys = [hashlib.md5(t.encode("utf-8")).digest() for t in texts(part["text"])]
                columns = [part["doc_id"], pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, uid binary, bands array<long>")


LINK = "a binary, b binary, similarity double"


def shingled(rows: DataFrame) -> DataFrame:
    """uid, registers, elements and weights (packed arrays) of rows (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                elements, weights = text_shingles(part, hashes)
                regs = signatures(np.concatenate(elements), np.concatenate(weights), np.array([len(e) for e in elements]), REGISTERS)
                folded = []
                for e, w in zip(elements, weights, strict=True):
                    short, at = np.unique(mix(e).astype(np.uint32), return_inverse=True)
                    folded.append((short.tobytes(), np.bincount(at, w).astype("<u4").tobytes() if w.max() > 1 or len(short) < len(e) else b""))
                columns = [part["uid"], *(pa.array(c, pa.binary()) for c in ([r.tobytes() for r in mix(regs).astype(np.uint32)], *zip(*folded, strict=True)))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "registers", "elements", "weights"])

    return rows.select("uid", "text").mapInArrow(run, "uid binary, registers binary, elements binary, weights binary")


def unpacked(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elements, np.uint32)
    return e, np.frombuffer(weights, "<u4") if weights else np.ones(len(e), np.uint32)


def star_links(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """a, b and similarity of the pairs (a, b, size: of the largest bucket where they meet) whose similarity reaches the threshold.

    A representative of many texts is dealt out: it is copied to as many parts as its largest bucket has STAR members.
    """
    parts = F.ceil(F.col("size") / STAR).cast("int")
    copies = pairs.groupBy("a").agg(F.max(parts).alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = known.select(F.col("uid").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa")).join(copies.select("a", "part"), "a")
    left = known.select(F.col("uid").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("ea", "wa", "eb", "wb")]
            alike = np.array([probability_jaccard(*unpacked(ea, wa), *unpacked(eb, wb)) for ea, wa, eb, wb in zip(*columns, strict=True)], float)
            linked = pa.array(alike >= threshold)
            columns = [batch["a"].filter(linked), batch["b"].filter(linked), pa.array(alike).filter(linked)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "similarity"])

    return dealt.join(left, "b").join(right, ["a", "part"]).select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(run, LINK)


def rest_links(members: DataFrame, threshold: float) -> DataFrame:
    """The links between different classes within a tile pair. members: bucket, rep, band, tile, tiles, uid, label, ..."""
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("tile", j).alias("p"), F.greatest("tile", j).alias("q"))))
    dealt = members.withColumn("pair", pair).select("*", F.col("pair.p").alias("p"), F.col("pair.q").alias("q")).drop("pair", "tiles")

    def run(table: pa.Table) -> pa.Table:
        uid, label, tile = (table[c].to_pylist() for c in ("uid", "label", "tile"))
        n, p, q, band = len(uid), table["p"][0].as_py(), table["q"][0].as_py(), table["band"][0].as_py()
        rep = table["rep"][0].as_py()
        _, labels = np.unique(np.array([x.hex() for x in label]), return_inverse=True)
        labels, tile = labels.reshape(-1), np.array(tile)
        regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint32).reshape(n, REGISTERS)
        bands = np.array(table["bands"].to_pylist(), np.int64)
        sets = [unpacked(e, w) for e, w in zip(table["elements"].to_pylist(), table["weights"].to_pylist(), strict=True)]
        a, b, alike = [], [], []
        counts = np.bincount(labels)
        # the largest class needs no row of its own: the others' rows meet it
        for i in np.flatnonzero(labels != counts.argmax()):
            if uid[i] == rep:
                continue
            others = np.flatnonzero((labels != labels[i]) & ((labels == counts.argmax()) | (np.arange(n) > i)))
            if p != q:
                others = others[tile[others] != tile[i]]
            others = others[(regs[others] == regs[i]).mean(axis=1) >= threshold - SLACK]
            others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
            for j in others.tolist():
                if uid[j] != rep and (s := probability_jaccard(*sets[i], *sets[j])) >= threshold:
                    a.append(uid[i])
                    b.append(uid[j])
                    alike.append(s)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(alike, pa.float64())})

    return dealt.groupBy("bucket", "p", "q").applyInArrow(run, LINK)


def components(links: DataFrame) -> DataFrame:
    """uid and label (the smallest uid that it is linked with through others) of every linked uid."""
    links = links.select("a", "b")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "uid"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "uid"), "uid").select("uid", "label", F.least("label", "near").alias("low"))
        # and on to where that label points by now
        far = labels.select(F.col("uid").alias("low"), F.col("label").alias("far"))
        step = written(step.join(far, "low").select("uid", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")), "labels")
        labels = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size and n_links of every document: classes of texts linked directly or through others.

    class_id is the smallest doc_id of the class. n_links counts the other texts that this one was found to be linked with; where a
    class joins two texts already no further link between them is looked for. Equal texts are one class; a null or empty text, or one
    of blanks, is a class of its own row. Fewer than five words are one shingle; a very long text is all its shingles, held by one
    task. Rows with a null doc_id take part; a class of only such rows has a null class_id. Repeated rows pass through, a row each,
    and count in class_size. An empty table gives no rows. Other columns are not read.
    """
    classes, links = classed(docs, threshold)
    sums = classes.filter("worded").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    own = ends.groupBy(F.col("a").alias("uid")).agg(F.count(F.lit(1)).alias("n_links"))
    alone = classes.filter("NOT worded").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    found = classes.filter("worded").join(sums, "label").join(own, "uid", "left")
    return found.select("doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")).unionByName(alone)


def classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, uid, worded and label (a uid that stands for the class) of every document, and the links: a, b (uids) and similarity.

    Without words each document is for itself.
    """
    rows = written(signed(docs), "signed")
    worded = rows.filter("bands IS NOT NULL")
    distinct = written(worded.groupBy("uid").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "distinct")
    met = distinct.select("uid", F.posexplode("bands").alias("band", "bucket"))
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(met.join(sizes, "bucket"), "members")
    meets = members.groupBy("uid").agg(F.sum("size").alias("meets"))
    reps = members.join(meets, "uid").groupBy("bucket").agg(F.max_by("uid", F.struct("meets", "uid")).alias("rep"))
    members = written(members.join(reps, "bucket"), "members")
    asked = members.select("uid").distinct().join(distinct, "uid").select("uid", "first", "bands")
    own = docs.select(F.col("doc_id").cast("long").alias("first"), F.col("text"), text_key(F.col("text")).alias("key"))
    found = own.join(asked, own["first"].eqNullSafe(asked["first"]) & (own["key"] == asked["uid"])).select("uid", "text")
    known = written(shingled(found).dropDuplicates(["uid"]), "known")
    pairs = members.filter(F.col("uid") != F.col("rep")).groupBy(F.col("rep").alias("a"), F.col("uid").alias("b")).agg(F.max("size").alias("size"))
    links = written(star_links(pairs, known, threshold), "star")
    labels = components(links).withColumnRenamed("uid", "its")
    labelled = members.filter("size > 2").join(labels, F.col("uid") == F.col("its"), "left").withColumn("label", F.coalesce("label", "uid")).drop("its")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    rest = written(labelled.join(mixed, "bucket").join(known, "uid").join(distinct.select("uid", "bands"), "uid"), "rest")
    weighed = rest.groupBy("bucket").agg(F.sum(F.length("elements") + F.length("weights")).alias("bytes"))
    tiles = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    rest = rest.join(weighed, "bucket").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")).drop("size", "bytes")
    links = written(links.unionByName(rest_links(rest, threshold)), "links")
    labels = components(links).withColumnRenamed("uid", "its")
    classes = rows.select("doc_id", "uid", F.col("bands").isNotNull().alias("worded")).join(labels, F.col("uid") == F.col("its"), "left")
    return classes.select("doc_id", "uid", "worded", F.coalesce("label", "uid").alias("label")), links


def first_of_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, that of the smallest doc_id (null last) and then text key, with all its columns.

    A text without words is a class with each doc_id that it has; of rows of like doc_id and text one stays.
    """
    classes, _ = classed(docs, threshold)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    firsts = classes.filter("worded").groupBy("label").agg(F.min_by(F.struct("doc_id", "uid"), place).alias("f")).select("f.doc_id", "f.uid")
    firsts = firsts.unionByName(classes.filter("NOT worded").select("doc_id", "uid").distinct())
    firsts = firsts.select(F.col("doc_id").alias("its_doc"), F.col("uid").alias("its_text"))
    # rows travel as one struct, so their columns clash with none of these
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("doc"), text_key(F.col("text")).alias("key"))
    kept = own.join(firsts, F.col("doc").eqNullSafe(F.col("its_doc")) & (F.col("key") == F.col("its_text")), "left_semi")
    return kept.dropDuplicates(["doc", "key"]).select("row.*")
