"""Nearest neighbours: score-aware four-bit product quantisation, table scans, exact reranking of all that could be near.

Nearest by Euclidean distance is the largest inner product q.x - |x|^2 / 2; the last term is kept exactly for each row and x is
quantised. As an error along x costs an inner product most, the loss weighs the residual parallel to x ETA times the rest
(anisotropic loss), both when a row takes its codes and when codebooks are fitted. Codebooks have 16 centres for each pair of
dimensions, so that two codes make a byte; a scan adds up one looked-up value a byte.

The index covers every row, in shards of bounded size. All queries go to every shard in one exchange and stream past it in blocks: a
task holds one shard, scans it for each query, reranks the best by exact distance and passes on the k nearest, merged then by query.

A row also keeps how far it lies from its code's point, so codes bound distances: no row is nearer to a query than its code's point
less that. Once the best guesses have given a k-th distance, every row whose bound does not exceed it is measured too, so results
are exact however many rows lie closer together than codes resolve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.llm.common import written

CENTRES = 16
#: Bytes of lookup tables that a task holds at once.
TABLE_BYTES = 64 << 20
#: Bytes of vectors of a shard, which a task holds at once.
SHARD_BYTES = 64 << 20
#: Inner products of at least this part of the norms' product are the ones that matter.
SCORE_THRESHOLD = 0.2


class Codebooks:
    """Centres of every subspace: [subspaces, CENTRES, 2]. Dimensions are padded to a multiple of four with zeros."""

    def __init__(self, dim: int, sample: np.ndarray, rounds: int = 6, seed: int = 1):
        self.dim, self.padded = dim, -(-dim // 4) * 4
        part = SCORE_THRESHOLD**2
        self.eta = max(1.0, (dim - 1) * part / (1 - part))
        x = self.blocks(sample)
        rng = np.random.default_rng(seed)
        self.centres = np.zeros((self.padded // 2, CENTRES, 2))
        if len(x):
            self.centres = x[rng.integers(0, len(x), CENTRES)].transpose(1, 0, 2).copy()
            for r in range(rounds):
                # plain rounds first: they bring the centres near the data
                self.update(x, self.assign(x, self.eta if r >= 2 else 1.0), self.eta if r >= 2 else 1.0)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - self.dim))).reshape(len(x), -1, 2).astype(np.float64)

    def assign(self, x: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
        """Codes [n, subspaces] by coordinate descent on the loss, from the plain nearest centres."""
        far = ((x[:, :, None, :] - self.centres[None]) ** 2).sum(-1)
        codes = far.argmin(-1)
        if eta == 1.0:
            return codes
        unit = x / np.maximum(np.sqrt((x**2).sum((1, 2), keepdims=True)), 1e-30)
        # how far along x each choice of centre leaves the residual: [n, subspaces, CENTRES]
        along = (unit * x).sum(-1)[:, :, None] - np.einsum("nsd,scd->nsc", unit, self.centres)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for s in range(x.shape[1]):
                rest = total - along[rows, s, codes[:, s]]
                codes[:, s] = (far[:, s] + (eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
                total = rest + along[rows, s, codes[:, s]]
        return codes

    def update(self, x: np.ndarray, codes: np.ndarray, eta: float) -> None:
        """The centres that minimise the loss for given codes: one least-squares system over all of them."""
        n, subspaces, _ = x.shape
        slots = codes + np.arange(subspaces) * CENTRES
        counts = np.bincount(slots.reshape(-1), minlength=subspaces * CENTRES).astype(float)
        sums = np.stack([np.bincount(slots.reshape(-1), x[:, :, d].reshape(-1), subspaces * CENTRES) for d in (0, 1)], 1)
        unit = x / np.maximum(np.sqrt((x**2).sum((1, 2), keepdims=True)), 1e-30)
        z = np.zeros((n, subspaces * CENTRES, 2))
        z[np.arange(n)[:, None], slots] = unit
        z = z.reshape(n, -1)
        weight = np.repeat(counts, 2)
        left = np.diag(weight + 1e-6) + (eta - 1) * (z.T @ z)
        right = sums.reshape(-1) + (eta - 1) * (z.T @ (unit * x).sum((1, 2))) + 1e-6 * self.centres.reshape(-1)
        self.centres = np.linalg.solve(left, right).reshape(self.centres.shape)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed codes [n, subspaces / 2]: the even subspace in the low half of a byte."""
        codes = self.assign(self.blocks(x), self.eta).astype(np.uint8)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def points(self, codes: np.ndarray) -> np.ndarray:
        """The vectors [n, padded] that packed codes stand for."""
        split = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)
        return self.centres[np.arange(split.shape[1]), split].reshape(len(codes), -1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with each packed byte: [queries, bytes, 256]."""
        own = np.einsum("qsd,scd->qsc", self.blocks(queries), self.centres).astype(np.float32)
        low, high = own[:, 0::2], own[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), low.shape[1], 256)

    def wrong(self, queries: np.ndarray) -> np.ndarray:
        """The most that a query's sums of its tables, which are of single precision, can be wrong by."""
        most = np.abs(np.einsum("qsd,scd->qsc", self.blocks(queries), self.centres)).max(2).sum(1)
        return (self.padded // 2 + 4) * 2.0**-23 * most


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding (doubles) of the rows that take part, and their dimension.

    Left out: null ids, null or empty vectors, vectors of zeros, null, NaN or infinite components, and other dimensions than
    the most common one (the smaller on ties).
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))
    # a row for each dimension; there are as many as vectors have lengths
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0
    return rows.filter(F.size("embedding") == dim), dim


def build_index(rows: DataFrame, dim: int, fit_rows: int) -> tuple[DataFrame, Codebooks]:
    """Every row with its code, half its squared norm, its code's squared norm and its distance from that; codebooks come from the ``fit_rows`` rows first in a hash order."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("embedding").toArrow()["embedding"].combine_chunks()
    books = Codebooks(dim, matrix(sample, dim) if len(sample) else np.zeros((0, dim)))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["embedding"], dim)
            codes, norm, off = [], [np.zeros(0)], [np.zeros(0)]
            for part in range(0, len(x), 2048):
                own = x[part : part + 2048]
                packed = shared.value.encode(own)
                points = shared.value.points(packed)
                codes += [c.tobytes() for c in packed]
                norm.append((points**2).sum(1))
                off.append(np.sqrt(((np.pad(own, ((0, 0), (0, points.shape[1] - dim))) - points) ** 2).sum(1)))
            columns = [batch["vec_id"], batch["embedding"], pa.array(codes, pa.binary()), *map(pa.array, ((x**2).sum(1) / 2, np.concatenate(norm), np.concatenate(off)))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "code", "half_norm", "code_norm", "off"])

    kinds = "vec_id long, embedding array<double>, code binary, half_norm double, code_norm double, off double"
    return written(rows.mapInArrow(encode, kinds), "index"), books


def first_of_equals(names: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k nearest of a query of another id: of each very vector, k rows of an id, and of those
    the 2k of smallest ids. A query's own id holds k of them at most, so k others are left where there are as many."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).reshape(-1)
    _, group = np.unique(whole, return_inverse=True)
    order = np.lexsort((names, group))

    def nth(new: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.r_[True, new])
        return np.arange(len(new) + 1) - np.repeat(start, np.diff(np.r_[start, len(new) + 1]))

    if len(order):
        order = order[nth((np.diff(group[order]) != 0) | (np.diff(names[order]) != 0)) < k]
        order = order[nth(np.diff(group[order]) != 0) < 2 * k]
    return np.sort(order)


class Shard:
    """A part of the index in a task's memory, against which queries are held."""

    def __init__(self, books: Codebooks, batches: list[pa.RecordBatch], k: int, rerank: int):
        self.books, self.k, self.rerank = books, k, rerank
        column = lambda c: np.concatenate([np.asarray(b[c]) for b in batches]) if batches else np.zeros(0)
        names = column("vec_id").astype(np.int64)
        x = np.concatenate([matrix(b["embedding"], books.dim) for b in batches] or [np.zeros((0, books.dim))])
        codes = np.frombuffer(b"".join(c for b in batches for c in b["code"].to_pylist()), np.uint8).reshape(len(names), -1)
        first = first_of_equals(names, x, k)
        self.names, self.x, self.codes, self.half, self.norm, self.off = (a[first] for a in (names, x, codes, column("half_norm"), column("code_norm"), column("off")))

    def nearest(self, ids: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        """query_id, vec_id and score of the k nearest rows of each query of a block."""
        tables, wrong, norms = self.books.tables(queries), self.books.wrong(queries), (queries**2).sum(1)
        places, found = np.arange(tables.shape[1]), []
        for q, query in enumerate(queries):
            others = self.names != ids[q]
            inner = tables[q][places, self.codes].sum(1)
            guess = np.where(others, inner - self.half, -np.inf)
            # the best guesses give a k-th distance
            chosen = np.argpartition(-guess, self.rerank)[: self.rerank] if len(guess) > self.rerank else np.arange(len(guess))
            chosen = chosen[others[chosen]]
            far = np.sqrt(((self.x[chosen] - query) ** 2).sum(1))
            reach = np.partition(far, self.k - 1)[self.k - 1] if len(far) >= self.k else np.inf
            # no row is nearer than its code's point less its own distance from that; what is no number is measured
            square = norms[q] + self.norm
            point = np.sqrt(np.maximum(square - 2.0 * inner - 2 * wrong[q] - 1e-12 * square, 0))
            open_ = others & ~(point - self.off > reach * (1 + 1e-12) + 1e-12 * self.off)
            open_[chosen] = False
            more = np.flatnonzero(open_)
            far = np.r_[far, np.sqrt(((self.x[more] - query) ** 2).sum(1))]
            names = self.names[np.r_[chosen, more]]
            first = np.lexsort((names, far))[: self.k]
            found.append((far[first], names[first]))
        columns = [np.repeat(ids, [len(f) for f, _ in found]), *(np.concatenate([f[i] for f in found] or [[]]) for i in (1, 0))]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def scanned(rows: DataFrame, books: Codebooks, k: int, rerank: int, block: int) -> DataFrame:
    """query_id, vec_id and score of the k nearest that each shard of the index holds for each query.

    ``rows`` hold, by shard, the index (asks is false) and all queries (asks is true). They are sorted so that a shard comes first and its
    queries stream past it.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, held, loaded, now = shared.value, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = np.asarray(batch["shard"].to_numpy()) * 2 + batch["asks"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part, shard = batch.slice(start, end - start), int(kinds[start]) // 2
                if shard != now:
                    held, loaded, now = [], None, shard
                if kinds[start] % 2 == 0:
                    held.append(part)
                    continue
                if loaded is None:
                    loaded, held = Shard(books, held, k, rerank), []
                for at in range(0, part.num_rows, block):
                    some = part.slice(at, block)
                    yield loaded.nearest(np.asarray(some["vec_id"]), matrix(some["embedding"], books.dim))

    dealt = rows.repartitionByRange("shard").sortWithinPartitions("shard", "asks", "vec_id")
    return dealt.mapInArrow(scan, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, rerank: int = 200, fit_rows: int = 8192, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows of each row whose vec_id is divisible by ``every``.

    Nearness is Euclidean distance in double precision on the original vectors; ties go to the smaller vec_id. A query's own
    vec_id is no candidate, whichever row holds it; rows of another vec_id that repeats are candidates each. Where rows of a query's
    vec_id differ, its vector is the least of theirs, compared by components. See ``usable`` for vectors that take no part. Where fewer
    than k candidates exist, all are returned; an empty table gives no rows. Other columns are not read. Vectors of many dimensions make
    smaller shards and smaller blocks of queries, ``block`` at most.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a worker holds a block's lookup tables: 1 KiB for each query and four dimensions
    block = max(1, min(block, TABLE_BYTES // (1024 * max(1, -(-dim // 4)))))
    index, books = build_index(rows, dim, fit_rows)
    # shards that a worker holds, and as many as there are cores where rows are few: queries go to every shard
    n = index.count()
    shards = max(-(-n // max(1, SHARD_BYTES // (8 * dim))), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    index = index.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked, "asked").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    found = scanned(index.unionByName(asked, allowMissingColumns=True), books, k, rerank, block)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
