"""Line dedup over a range-partitioned stream of line hashes; documents get keep bitmaps, and their text only at the end.

Lines with a key worth comparing become (hash, salt, document, position). They are range-partitioned by hash and salt and
sorted by hash, salt, falling document and position, so that each hash's stream starts with the occurrence to keep. The salt
splits the lines of a very common key over SALTS streams, whose counts and first documents are then combined. Verdicts come
back as sparse bitmaps: 64 positions a word, words without a dropped line left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.llm.common import written

SALTS = 32


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and all else as it is."""
    bare = F.regexp_replace(line, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+\\z", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_hashes(rows: DataFrame, least_chars: int) -> DataFrame:
    """h (128 bits), salt, doc, row, pos of every line whose key is long enough. rows: doc, row, lines."""
    lines = rows.select("doc", "row", F.posexplode("lines").alias("pos", "line"))
    # a key is never longer than its line
    lines = lines.filter(F.length("line") >= least_chars).select("doc", "row", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.length("key") >= least_chars)
    return lines.select(F.unhex(F.md5("key")).alias("h"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), "doc", "row", "pos")


def dropped_lines(rows: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """doc, row, pos of the lines to drop."""
    order = ["h", "salt", F.desc("doc"), "row", "pos"]
    # written first, so that the bounds of the ranges are sampled from hashes and not from texts hashed once more
    stream = written(line_hashes(rows, least_chars), "hashes").repartitionByRange("h", "salt").sortWithinPartitions(*order)
    run = Window.partitionBy("h", "salt").orderBy(F.desc("doc"))
    # dense_rank grows by one with each further document of the stream
    counted = stream.withColumn("nth", F.dense_rank().over(run))
    keys = counted.groupBy("h", "salt").agg(F.max("nth").alias("n"), F.max("doc").alias("last"))
    common = keys.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= least_docs)
    # a verdict for each hash and salt, so that the lines of a very common key meet theirs in as many tasks as it has salts
    verdicts = keys.select("h", "salt").join(common.select("h", F.col("last").alias("keeps")), "h")
    return counted.join(verdicts, ["h", "salt"]).filter(F.col("doc") < F.col("keeps")).select("doc", "row", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """doc, row and words: an array of struct(word, bits), in order, with a bit for each dropped position."""
    bit = F.expr("shiftleft(1L, pos % 64)")
    bits = dropped.groupBy("doc", "row", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return bits.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def is_dropped(words: Column, pos: Column) -> Column:
    """Whether a position is set in the dense words of a document."""
    word = F.element_at(words, (pos / 64).cast("int") + 1)
    return F.getbit(word, pos % 64) == 1


def line_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc, row and words (see keep_bitmaps) of the documents that lose lines; no text leaves the first stage."""
    return keep_bitmaps(dropped_lines(with_lines(docs).filter("doc IS NOT NULL"), least_chars, least_docs))


def with_lines(docs: DataFrame, *more: Column) -> DataFrame:
    """doc, row (a hash of the text, which tells repeated rows of one doc_id apart) and more, or the lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc, row = F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("row")
    return docs.select(doc, row, *(more or [F.split(text, "\n").alias("lines")]))


def with_kept(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """The rows of ``docs`` (in the struct __row) with doc, lines and left (the lines that stay)."""
    bitmaps = line_bitmaps(docs, least_chars, least_docs).withColumnsRenamed({"doc": "its_doc", "row": "its_row"})
    own = with_lines(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    joined = own.join(bitmaps, (F.col("doc") == F.col("its_doc")) & (F.col("row") == F.col("its_row")), "left")
    joined = joined.withColumn("lines", F.split(F.coalesce("__row.text", F.lit("")), "\n"))
    sparse = F.map_from_entries(F.col("words"))
    dense = F.when(
        F.col("words").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 64).cast("int")), lambda w: F.coalesce(F.element_at(sparse, w), F.lit(0).cast("long"))),
    )
    joined = joined.withColumn("bits", dense)
    keep = F.filter(F.col("lines"), lambda x, i: ~is_dropped(F.col("bits"), i))
    return joined.withColumn("left", F.when(F.col("bits").isNull(), F.col("lines")).otherwise(keep))


def deduped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text of the lines that stay) of every document.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of ``least_chars`` code points found in
    ``least_docs`` documents lose all their lines but those of the largest doc_id that holds them. A null or empty text is one
    empty line; a very long text is split whole, as one array of one row. Rows without a doc_id take no part and keep their lines;
    repeated rows of one doc_id count as one document and are treated alike. Other columns are not read. An empty table gives no rows.
    """
    joined = with_kept(docs.select("doc_id", "text"), least_chars, least_docs)
    n = F.size("lines").cast("long")
    return joined.select(
        F.col("doc").alias("doc_id"), n.alias("n_lines"), (n - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept")
    )


def without_dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` with all their columns, text being what deduped_lines keeps; a null text stays null."""
    joined = with_kept(docs, least_chars, least_docs)
    text = F.when(F.col("__row.text").isNotNull(), F.array_join("left", "\n")).alias("text")
    return joined.select(*(text if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns))


def line_digests(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """deduped_lines with the SHA-256 of what stays instead of the text."""
    out = deduped_lines(docs, least_chars, least_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
