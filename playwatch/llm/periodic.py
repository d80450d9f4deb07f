"""Periodic runs in texts: stretches of words that repeat themselves at a fixed distance, found from seeds on diagonals.

A run of period q and length L >= max(least, repeats * q) has words that equal those q further on over L - q words in a row, a stretch
of its diagonal (its lag q). So every run holds, q apart, two equal k-grams of any k up to the guaranteed overlap; SEED words for periods
up to SEED, and k words for periods in (k/2, k] as k doubles. As such a gram is no shorter than the period, no other occurrence of it lies
between those two (the period would not be the smallest), so each occurrence is paired with the next one alone: pairs are as many as
words, however often a gram stands. Grams of 2k words are looked for only where both halves stand twice.

A pair that begins a row of neighbouring pairs on its lag is extended to both sides. A table of how far each lag is covered drops
pairs that lie in a stretch already extended. Grams are hashed and then compared word by word, so runs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playwatch.llm.common import slices, word_array
from playwatch.llm.probminhash import mix

#: Words of the shortest seed.
SEED = 16

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def alike(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from places ``a`` and ``b`` (a < b) on, going by ``step`` (1 or -1), are equal."""
    room = len(ids) - b if step > 0 else a + 1
    done, chunk = 0, 64
    while done < room:
        size = min(chunk, room - done)
        x, y = a + step * done, b + step * done
        same = ids[x : x + size] == ids[y : y + size] if step > 0 else (ids[x - size + 1 : x + 1] == ids[y - size + 1 : y + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, chunk = done + size, chunk * 2
    return done


def seed_classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the SEED-grams that stand twice or more, ascending, and the class of each."""
    h = mix(ids.astype(np.uint64))
    for level in range(SEED.bit_length() - 1):
        w = 1 << level
        h = mix(h[:-w] * np.uint64(2 * level + 3)) ^ h[w:]
    sorted_ = np.sort(h)
    if not (sorted_[1:] == sorted_[:-1]).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    grams = np.lib.stride_tricks.sliding_window_view(ids, SEED)
    at = np.flatnonzero(same)
    for part in np.array_split(at, len(at) // 4096 + 1):
        if not (grams[order[part]] == grams[order[part + 1]]).all():
            # two grams of one hash: classes by the words themselves
            whole = np.ascontiguousarray(grams).view(np.dtype((np.void, SEED * ids.itemsize))).reshape(-1)
            return repeated(np.arange(len(whole)), np.unique(whole, return_inverse=True)[1])
    classes = np.empty(len(h), np.int64)
    classes[order] = np.cumsum(np.r_[False, ~same])
    return repeated(np.arange(len(h)), classes)


def repeated(places: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose class stands twice or more, with classes numbered anew."""
    _, classes, counts = np.unique(classes, return_inverse=True, return_counts=True)
    many = counts[classes] > 1
    return places[many], classes[many]


def runs_of(ids: np.ndarray, least: int = 24, repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of word numbers ``ids``, by start, then period.

    A seed of SEED words lies in every run if ``least`` is 1.5 times SEED or more and ``repeats`` 3 or more.
    """
    if least < SEED + SEED // 2 or repeats < 3:
        raise ValueError(f"runs of fewer than {SEED + SEED // 2} words or 3 periods may hold no seed")
    if len(ids) < least:
        return []
    found: list[tuple[int, int, int]] = []
    places, classes = seed_classes(ids)
    k, shortest = SEED, 0
    while len(places) and repeats * (shortest + 1) <= len(ids):
        order = np.argsort(classes, kind="stable")
        here, lag = places[order][:-1], np.diff(places[order])
        paired = (np.diff(classes[order]) == 0) & (lag > shortest) & (lag <= k)
        here, lag = here[paired], lag[paired]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        first = np.r_[True, (np.diff(here) != 1) | (np.diff(lag) != 0)][: len(here)]
        covered: dict[int, int] = {}
        for at, q in zip(here[first].tolist(), lag[first].tolist(), strict=True):
            if at < covered.get(q, 0):
                continue
            start = at - alike(ids, at - 1, at + q - 1, -1)
            end = at + k + alike(ids, at + k, at + q + k, 1)
            covered[q] = end
            if end - start + q >= max(least, repeats * q):
                found.append((start, end - start + q, q))
        classes_at = np.full(len(ids) + k, -1)
        classes_at[places] = classes
        after = classes_at[places + k]
        both = after >= 0
        places, classes = repeated(places[both], classes[both] * np.int64(len(ids)) + after[both])
        k, shortest = 2 * k, k
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those in no run but for its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = 24, repeats: int = 3) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every document: its maximal runs by start, then period, and its text without repeats.

    Words are parted by space and U+0009 to U+000D, numbered from 0 and compared as they are. A run is a stretch of smallest period q
    and at least ``least`` and ``repeats`` * q words that no neighbouring word extends. ``collapsed`` joins with one space the words that
    no run holds beyond its first period. A null or empty text has no words, no runs and collapses to the empty text; a very long one is
    one row's work, in memory of its words' numbers. A null doc_id and repeated rows pass through, a row each; an empty table gives no rows.
    Other columns are not read. Documents meet no other documents: there is no exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, runs, texts = [], [], []
                for text in part["text"].cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    known: dict[bytes, int] = {}
                    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                    own = runs_of(ids, least, repeats)
                    if own:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), own)).tolist()]
                    sizes.append(len(ids))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    texts.append(b" ".join(words))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                columns = [part["doc_id"], pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; the first of equals. Null where there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(runs: DataFrame) -> DataFrame:
    """The rows of ``periodic_runs`` with its runs as figures and digests: see the registered query."""
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where a tenth of the texts, chosen by crc32 of the doc_id, repeat a stretch of words to their end.

    h is the crc32 of the decimal doc_id and g = floor(h / 10). Where h % 10 = 0, word i of n, from a = g % n on, becomes word
    a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id or a text without words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), h.alias("__h"), F.floor(h / 10).alias("__g"))
    d = d.withColumn("__words", F.when(F.col("__h") % 10 == 0, word_array(F.col("text"))))
    d = d.withColumn("__n", F.size("__words").cast("long"))
    d = d.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.greatest("__n", F.lit(1))))
    d = d.withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    a, p = F.col("__a"), F.col("__p")
    turned = F.transform("__words", lambda w, i: F.when(i < a, w).otherwise(F.get(F.col("__words"), (a + (i - a) % p).cast("int"))))
    return d.select("doc_id", F.when(a.isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))

