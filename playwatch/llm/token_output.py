"""Token ids as binary shards: frequency-ranked ids in byte-aligned variable length, control bytes kept apart.

The format is a table of blocks. A block holds the documents of a stretch of the ascending doc_id order as one binary:

    header   magic "PWT1", n_docs, n_ids, n_data        four little-endian uint32
    lengths  n_docs uint32: ids of each document
    control  ceil(n_ids / 4) bytes: two bits for each id, its bytes less one, first id in the low bits
    data     n_data bytes: the ids' ranks, 1 to 4 bytes each, little-endian

Ranks number the ids by falling frequency in the corpus, so that frequent ids take one byte; the rank table (an entry for
each id of the vocabulary, so of bounded size) is stored beside the blocks. Decoding looks four lengths up for each control
byte in a table of 256 rows and gathers all bytes with numpy, without a loop over ids.

Texts are encoded where they lie, some MB at a time, and written as plain ids, which are counted for the ranks and then
range-partitioned by doc_id.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.llm.common import slices, written
from playwatch.llm.pretokens import ColumnTable, library, worker_table

MAGIC = int.from_bytes(b"PWT1", "little")
#: Bytes of each of the four ids of a control byte.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Documents end a block once it has this many ids.
BLOCK_IDS = 1 << 18
#: Bytes of text, and those of one text more, that a task encodes at a time.
PART_BYTES = 1 << 23


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of an array of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= code[:, None]
    return control, ranks.view(np.uint8).reshape(-1, 4)[used]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks that pack made these bytes of."""
    width = WIDTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < width[:, None]] = data
    return out.view("<u4").reshape(-1)


def block_bytes(lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([MAGIC, len(lengths), len(ranks), len(data)], "<u4")
    return b"".join(x.tobytes() for x in (head, lengths.astype("<u4"), control, data))


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the documents and the ranks of all their ids."""
    magic, n_docs, n_ids, n_data = np.frombuffer(block, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = 16 + 4 * n_docs
    lengths = np.frombuffer(block, "<u4", n_docs, 16)
    control = np.frombuffer(block, np.uint8, -(-n_ids // 4), at)
    return lengths, unpack(control, np.frombuffer(block, np.uint8, n_data, at + len(control)), n_ids)


def ids_of_two_bytes(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


def ids_of_four_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def parts_of(batch: pa.RecordBatch, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in stretches of about ``size`` bytes of text, so that memory follows those, not the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(cuts):
        yield batch.slice(a, b - a)


def encoded(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, str]:
    """doc_id, ids (with the end id) and h (a hash of them) of every document where its text lies, and numpy's type of ids.

    Only ids, of two bytes where the vocabulary allows, go on from here; texts are never shuffled.
    """
    most = max(end_id, library(path).get_vocab_size() - 1)
    kind, value = ("<u2", ids_of_two_bytes) if most <= 0xFFFF else ("<u4", ids_of_four_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(ColumnTable, path, value)
        end, between = pa.scalar(value([end_id]), pa.binary()), pa.scalar(b"", pa.binary())
        for batch in batches:
            for part in parts_of(batch):
                ids = pc.binary_join_element_wise(table.joined(part["text"]), end, between)
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")
    return written(rows.withColumn("h", F.xxhash64("ids")), "encoded"), kind


def id_frequencies(rows: DataFrame, kind: str) -> DataFrame:
    """id, n over the ids of all rows: a count for each id and task is shuffled, never ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                got = np.bincount(np.frombuffer(b"".join(part["ids"].to_pylist()), kind))
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, end_id: int, out: str, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text, appends end_id, and writes ``out``/blocks, ``out``/parts and ``out``/ranks.

    Documents stand in ascending doc_id order (null last; rows of one doc_id, or of none, by a hash of their ids): blocks are
    numbered within range partitions and say how many ids of the partition stand before them, ``parts`` how many before it. A null
    or empty text is its end id alone. A very long text is encoded whole, and is a block of its own once it passes ``block_ids``
    ids; its ids are held at once. An empty table gives empty files. Columns other than doc_id and text are not read.
    """
    rows, kind = encoded(docs, path, end_id)
    spark = docs.sparkSession
    # one row for each id of the vocabulary
    ids = [r[0] for r in id_frequencies(rows, kind).orderBy(F.desc("n"), "id").select("id").collect()]
    spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, rank long").coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    columns = "part int, block long, start long, n_ids long, doc_ids array<long>, data binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, held, size, block, start = [], [], 0, 0, 0
        at = None

        def full() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held])
            row = [at, block, start, size, doc_ids, block_bytes(lengths, shared.value[np.concatenate(held)])]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in columns.split(", ")])

        for batch in batches:
            for own, doc, raw in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                at = own
                doc_ids.append(doc)
                # a copy, as a view would keep its whole batch
                held.append(np.frombuffer(raw.as_buffer(), kind).copy())
                size += len(held[-1])
                if size >= block_ids:
                    yield full()
                    doc_ids, held, size, block, start = [], [], 0, block + 1, start + size
        if held:
            yield full()

    first = F.col("doc_id").asc_nulls_last()
    # the bounds of the ranges are sampled from doc_id and h alone
    dealt = rows.repartitionByRange(first, "h").sortWithinPartitions(first, "h", "ids").withColumn("part", F.spark_partition_id())
    dealt.select("part", "doc_id", "ids").mapInArrow(blocks, columns).write.option("compression", "zstd").parquet(f"{out}/blocks")
    # a row for each range partition
    sizes = spark.read.parquet(f"{out}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{out}/parts")


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Reads what write_tokens wrote: doc_id, start (ids before the document), n_tokens, ids_crc32 and, if asked, ids.

    ids_crc32 is the unsigned CRC-32 of the document's ids as little-endian uint32.
    """
    # one row for each id of the vocabulary
    ids = [r[0] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").select("id").collect()]
    shared = spark.sparkContext.broadcast(np.array(ids, "<u4"))
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for batch in batches:
            for start, docs, data in zip(batch["start"].to_pylist(), batch["doc_ids"].to_pylist(), batch["data"], strict=True):
                lengths, ranks = read_block(data.as_buffer())
                all_ids = id_of[ranks]
                ends = np.cumsum(lengths, dtype=np.int64)
                cuts = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                raw = memoryview(all_ids.tobytes())
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array(start + ends - lengths, pa.int64()),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in cuts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([all_ids[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in kinds.split(", ")])

    rows = spark.read.parquet(f"{out}/blocks").join(spark.read.parquet(f"{out}/parts"), "part")
    return rows.select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "data").mapInArrow(run, kinds)
