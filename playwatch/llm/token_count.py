"""Token counts by a map-side lookup in two tiers; no pre-token is ever shuffled.

Tier one is a compact hash table of frequent pre-tokens and their lengths in tokens: pre-tokens are counted in a bounded sample of
whole documents of some partitions, the most frequent are encoded once on the driver and broadcast as one joined string and one number for each. Tier
two is a cache in each Python worker, kept from task to task: a pre-token that tier one lacks is encoded by the library at its first
sight there. Counts do not depend on what either tier holds, so neither the sample nor the tables' bounds change a result.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playwatch.llm.common import slices, texts
from playwatch.llm.pretokens import PretokenTable, worker_table


def frequent_lengths(docs: DataFrame, path: str, sample_tasks: int, task_docs: int, entries: int) -> tuple[str, bytes]:
    """The most frequent pre-tokens of a sample, ``entries`` at most, joined by U+0000, and the tokens of each as uint32.

    The sample is the first ``task_docs`` documents of each of ``sample_tasks`` partitions, evenly spaced; no other rows are read.
    """
    own = docs.select("text")
    stride = max(1, -(-own.rdd.getNumPartitions() // sample_tasks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        if TaskContext.get().partitionId() % stride == 0:
            table = worker_table(PretokenTable, path, len)
            left = task_docs
            for batch in batches:
                for text in texts(batch["text"].slice(0, left)):
                    for k, piece in enumerate(table.at_special.split(text)):
                        if k % 2 == 0:
                            seen.update(table.words(piece))
                left -= batch.num_rows
                if left <= 0:
                    break
        top = seen.most_common(entries // 8)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    # each sampled task's own most frequent come to the driver as they are: ``sample_tasks`` * ``entries`` / 8 words at most
    tops = own.mapInArrow(count, "word string, n long").toArrow()
    sums: Counter = Counter()
    for word, n in zip(tops["word"].to_pylist(), tops["n"].to_pylist(), strict=True):
        sums[word] += n
    words = [w for w, _ in sorted(((w, n) for w, n in sums.items() if "\0" not in w), key=lambda x: (-x[1], x[0]))[:entries]]
    table = PretokenTable(path, len)
    return "\0".join(words), array("I", [table[w] for w in words]).tobytes()


def table_of(path: str, words: str, lengths: bytes, limit: int) -> PretokenTable:
    own = array("I")
    own.frombytes(lengths)
    return PretokenTable(path, len, limit, dict(zip(words.split("\0"), own, strict=True)) if own else {})


def token_counts(docs: DataFrame, path: str, limit: int = 512, cache: int = 600_000, sample_tasks: int = 32, task_docs: int = 64, entries: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document.

    Null and empty texts count 0 bytes and 0 tokens; a very long text is counted whole, in one task. A null doc_id and repeated
    rows pass through, a row each. An empty table gives no rows. Columns other than doc_id and text are not read. ``path`` is the
    vocabulary's file on every machine; ``cache`` bounds a worker's table, and ``sample_tasks``,
    ``task_docs`` and ``entries`` bound tier one.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_tasks, task_docs, entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_table(table_of, path, *frequent.value, cache)
        for batch in batches:
            sums = [sum(table.values_of(t)) for part in slices(batch) for t in texts(part["text"])]
            size = pc.fill_null(pc.cast(pc.binary_length(batch["text"]), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], size, pa.array(sums, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
