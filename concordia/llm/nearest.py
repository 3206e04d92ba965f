"""Operator 5: approximate nearest neighbours by score-aware (anisotropic) quantisation, four-bit scans and reranking.

A codebook of 16 centroids for each subspace is fitted on a bounded sample of the vectors.  The loss weighs the part of
the residual that is parallel to the vector more than the rest, as it changes large inner products most; both the
codes and the centroids are updated under that loss.  Every vector is encoded, four bits a subspace.  A query's inner
products with the centroids make a table for each subspace; the sums of table entries over the codes rank all
vectors, and the best of each block are scored again exactly, on the original vectors in double precision.  That gives
a floor for the k-th score.  By the norms of a vector's residuals an approximate score is off by no more than a bound;
whatever can reach the floor with it is scored exactly too, however many that are, so the result is exact.

Queries and vectors are cut into blocks by a hash, and each pair of blocks is one task's work: a stated query set
against all rows.  Equal vectors of a block share one entry in the scan; as many of their smallest ids as can be
asked for are kept.  Vectors that are null, zero or hold null or non-finite components, and rows without an id, take
no part.  Vectors of different lengths have no inner product: those of each length are searched among themselves, with
a codebook of their own.  Repeated ids are rows of their own, except that a query has its id's rows for no candidates.
Columns other than vec_id and embedding aren't read, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.common import table

CODES = 16


@dataclass
class Quantiser:
    books: np.ndarray  # subspaces, 16, width
    dims: int
    weight: float  # of the parallel part of the residual's square, over that of the rest

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        more = self.books.shape[0] * self.width - x.shape[1]
        return np.pad(x, ((0, 0), (0, more))) if more else x

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (weight - 1) * (r . x / |x|)^2, r being the residual."""
        x = self.padded(x.astype(np.float32))
        m, d = self.books.shape[0], self.width
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        parts, units = x.reshape(len(x), m, d), unit.reshape(len(x), m, d)
        square = np.empty((m, len(x), CODES), np.float32)  # of each subspace's residual
        along = np.empty((m, len(x), CODES), np.float32)  # its part along the vector
        for j in range(m):
            square[j] = (parts[:, j] ** 2).sum(1)[:, None] - 2 * parts[:, j] @ self.books[j].T + (self.books[j] ** 2).sum(1)
            along[j] = (parts[:, j] * units[:, j]).sum(1)[:, None] - units[:, j] @ self.books[j].T
        codes = square.argmin(2)
        row = np.arange(len(x))
        total = sum(along[j][row, codes[j]] for j in range(m))
        for _ in range(rounds):
            for j in range(m):
                rest = total - along[j][row, codes[j]]
                codes[j] = (square[j] + (self.weight - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
                total = rest + along[j][row, codes[j]]
        return codes.T.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the centroids: queries, subspaces, 16."""
        q = self.padded(q.astype(np.float32)).reshape(len(q), self.books.shape[0], self.width)
        return np.einsum("qmd,mcd->qmc", q, self.books)

    def doubts(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each vector and subspace how far a unit query's part can move the score off the table's: the residual's
        norm, and the rounding of sums in single precision."""
        m, d = self.books.shape[0], self.width
        x = self.padded(x.astype(np.float64)).reshape(len(x), m, d)
        rounding = (m + d + 8) * np.finfo(np.float32).eps
        out = np.empty((len(x), m), np.float32)
        for j in range(m):
            made = self.books[j].astype(np.float64)[codes[:, j]]
            out[:, j] = (np.linalg.norm(x[:, j] - made, axis=1) + rounding * np.linalg.norm(made, axis=1)) * (1 + rounding)
        return out

    def part_norms(self, q: np.ndarray) -> np.ndarray:
        """Norms of each query's parts."""
        return np.linalg.norm(self.padded(q).reshape(len(q), self.books.shape[0], self.width), axis=2).astype(np.float32)


def fit(sample: np.ndarray, subspaces: int = 32, threshold: float = 0.2, rounds: int = 6, seed: int = 5) -> Quantiser:
    """Alternates codes and centroids under the anisotropic loss; threshold is the share of a vector's norm from which
    an inner product counts as large."""
    n, dims = sample.shape
    m = min(subspaces, dims)
    d = -(-dims // m)
    m = -(-dims // d)
    t2 = threshold**2
    q = Quantiser(np.zeros((m, CODES, d), np.float32), dims, max(1.0, (dims - 1) * t2 / (1 - t2)))
    x = q.padded(sample.astype(np.float32))
    rng = np.random.default_rng(seed)
    q.books = x[rng.integers(0, n, CODES * m)].reshape(m, CODES, m, d)[np.arange(m), :, np.arange(m)].copy()
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, m, d)
    parts = x.reshape(n, m, d)
    for _ in range(rounds):
        codes = q.encode(sample)
        for j in range(m):
            made = np.stack([q.books[i][codes[:, i]] for i in range(m)], 1)
            rest = ((parts - made) * unit).sum((1, 2)) - ((parts[:, j] - made[:, j]) * unit[:, j]).sum(1)
            target = rest + (parts[:, j] * unit[:, j]).sum(1)  # what the centroid's part along the vector should be
            for c in range(CODES):
                own = codes[:, j] == c
                if not own.any():
                    q.books[j, c] = parts[rng.integers(n), j]
                    continue
                u = unit[own, j]
                a = own.sum() * np.eye(d) + (q.weight - 1) * u.T @ u
                b = parts[own, j].sum(0) + (q.weight - 1) * u.T @ target[own]
                q.books[j, c] = np.linalg.solve(a, b)
    return q


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, the earlier place first among equals at the edge; in ascending order of place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    return np.sort(np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]]))


def least_of(scores: np.ndarray, k: int) -> float:
    """The k-th largest; that of fewer is no limit."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def search_block(q: Quantiser, query_ids, queries, ids, vectors, k: int, rerank: int) -> Iterator[tuple]:
    """(query_id, vec_id, score) of the k best of the block for each query."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, member = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by = np.argsort(first)  # entries in the order of their smallest id
    number = np.empty(len(by), int)
    number[by] = np.arange(len(by))
    member = number[member.ravel()]
    spread = np.argsort(member, kind="stable")
    starts = np.searchsorted(member[spread], np.arange(len(by) + 1))
    entries = vectors[first[by]]
    codes = q.encode(entries)
    exact = entries.astype(np.float64)
    doubts = np.ascontiguousarray(q.doubts(entries, codes).T)
    longest = np.linalg.norm(exact, axis=1).max()
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256].astype(np.float64)
        tables = q.tables(part)
        approx = np.zeros((len(part), len(entries)), np.float32)
        for j in range(codes.shape[1]):
            approx += tables[:, j][:, codes[:, j]]
        most = approx + q.part_norms(part) @ doubts
        for i, v in enumerate(part):
            floor = least_of(exact[best(approx[i], max(rerank, k + 1))] @ v, k + 1)  # one more, as the query may be among them
            own = np.flatnonzero(~(most[i] < floor))
            s = exact[own] @ v if 4 * len(own) < len(exact) else (exact @ v)[own]
            own = own[~(s < least_of(s, k + 1) - 1e-12 * longest * np.linalg.norm(v))]
            s = (exact[own] * v).sum(1)  # the same for equal vectors, in whatever block
            got = [(query_ids[a + i], ids[p], x) for e, x in zip(own, s) for p in spread[starts[e] : min(starts[e + 1], starts[e] + k + 1)] if ids[p] != query_ids[a + i]]
            got.sort(key=lambda r: (-r[2], r[1]))
            yield from got[:k]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, k: int = 20, query_every: int = 20, sample_rows: int = 20_000, rerank: int = 400, block: int = 20_000, subspaces: int = 32
) -> DataFrame:
    """For each row whose id query_every divides: rank, vec_id and score of its k nearest of all other rows.

    The codebook is fitted on at most sample_rows rows chosen by a hash; every row is encoded and searched.
    """
    spark = vectors.sparkSession
    every_length = usable(vectors)
    lengths = every_length.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()  # a row for each length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for usual in lengths:
        own = every_length.where(F.size("v") == usual["n"])
        found = _nearest_of_length(own, usual["count"], k, query_every, sample_rows, rerank, block, subspaces)
        out = found if len(lengths) == 1 else out.unionByName(found)
    return out


def _nearest_of_length(own: DataFrame, count: int, k: int, query_every: int, sample_rows: int, rerank: int, block: int, subspaces: int) -> DataFrame:
    """The search among vectors of one length."""
    import pyarrow as pa

    schema = "query_id long, vec_id long, score double"
    spark = own.sparkSession
    sample = own.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample_rows).toPandas()  # a bounded sample
    quantiser = spark.sparkContext.broadcast(fit(np.stack(sample.v.to_numpy()), subspaces))
    blocks, query_blocks = -(-count // block), max(1, -(-count // (query_every * 4096)))
    number = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n).cast("long"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    every = own.select("vec_id", "v", number(1, blocks).alias("b"), F.explode(numbers(query_blocks)).alias("q"))
    asked = own.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    asked = asked.select("vec_id", "v", F.explode(numbers(blocks)).alias("b"), number(2, query_blocks).alias("q"))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            array = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            out = list(search_block(quantiser.value, queries.column("vec_id").to_numpy(), array(queries), rows.column("vec_id").to_numpy(), array(rows), k, rerank))
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = asked.groupBy("b", "q").cogroup(every.groupBy("b", "q")).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
