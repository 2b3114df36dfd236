"""Exact top-k inner-product search by MaxScore.

Each dimension of a query is a term. Vectors are dense, so a term's postings have an impact for every vector and lie in one
column of a batch's matrix, the widest term first. What the last terms of a query and a vector have in common lies under the
product of their lengths there (Cauchy and Schwarz). Terms are split by this bound: the last ones that together can't give
SHARE of the k-th best score so far are non-essential. The postings of the essential ones are traversed, for a block of
queries at once; the other terms are probed, STEP by STEP, only for vectors that are still competitive. Ties stay in, so the k
results are exact, smaller vec_id first.

Vectors stay where they are: queries are broadcast, in rounds of at most `round_mb` (the number of rounds follows theirs),
each task carries the k-th best scores over its batches, and sends k rows a query at most, which are merged. From
`sample_from` vectors on, a thirty-second of them is searched first, in few tasks; the k-th best of those is every task's bar
from the start, so that few rows are sent, however many tasks there are.

Defined results: vectors that are null, or hold null or non-finite components, and rows without vec_id take no part; every
row with another vec_id than the query's is a candidate, repeated rows as often as they stand; an id with several vectors
is a query with the smallest (in order of components); vectors of another length count as filled up with zeros.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

STEP = 8  # terms probed at once
SHARE = 0.25  # of the bar, which the non-essential terms can't give
PART = 32  # of the vectors, one in so many is searched for bars
ANY = np.iinfo(np.int64).max


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id long, q array<long>: floor(256 * component), of the vectors that take part."""
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return embeddings.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    n = np.diff(at)
    if len(n) and (n == width).all():
        return values[at[0] : at[-1]].reshape(len(n), width).astype(kind)
    out = np.zeros((len(n), width), dtype=kind)
    out[np.repeat(np.arange(len(n)), n), np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)] = values[at[0] : at[-1]]
    return out


def _none(kind):
    """Below any score."""
    return np.iinfo(np.int64).min // 2 if kind is np.int64 else -np.inf


def _tails(x: np.ndarray) -> np.ndarray:
    """The length of each row from its terms 0, STEP, 2 STEP, ... on; 0 at the end."""
    squares = np.add.reduceat(np.square(x, dtype=np.float64), np.arange(0, x.shape[1], STEP), axis=1)
    out = np.zeros((len(x), squares.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return out


class Best:
    """The k best (id, score) of each query so far, and the least (score, greatest id) that still counts."""

    def __init__(self, bar: np.ndarray, k: int, bar_id: np.ndarray | None = None):
        self.k, self.bar = k, bar.copy()
        self.bar_id = np.full(len(bar), ANY) if bar_id is None else bar_id.copy()
        self._n, self._id, self._score = np.zeros(len(bar), np.int64), np.zeros((len(bar), k), np.int64), np.zeros((len(bar), k), bar.dtype)

    def raised(self, some: np.ndarray | slice, bar: np.ndarray, bar_id: np.ndarray | int = ANY) -> None:
        """Higher bars of these queries; others stay."""
        higher = (bar > self.bar[some]) | ((bar == self.bar[some]) & (bar_id < self.bar_id[some]))
        self.bar[some], self.bar_id[some] = np.where(higher, bar, self.bar[some]), np.where(higher, bar_id, self.bar_id[some])

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        """Only the rows of the queries that are named are touched."""
        counts = (score > self.bar[query]) | ((score == self.bar[query]) & (id_ <= self.bar_id[query]))
        some, at = np.unique(query[counts], return_inverse=True)
        if not len(some):
            return
        held = np.arange(self.k) < self._n[some][:, None]
        of, id_, score = (np.concatenate(x) for x in ((np.nonzero(held)[0], at), (self._id[some][held], id_[counts]), (self._score[some][held], score[counts])))
        order = np.lexsort((id_, -score, of))
        of, id_, score = of[order], id_[order], score[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < self.k
        of, rank = of[keep], rank[keep]
        self._id[some[of], rank], self._score[some[of], rank] = id_[keep], score[keep]
        self._n[some] = np.bincount(of, minlength=len(some))
        full = some[self._n[some] == self.k]
        self.raised(full, self._score[full, self.k - 1], self._id[full, self.k - 1])

    @property
    def query(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bar)), self._n)

    @property
    def id(self) -> np.ndarray:
        return self._id[np.arange(self.k) < self._n[:, None]]

    @property
    def score(self) -> np.ndarray:
        return self._score[np.arange(self.k) < self._n[:, None]]


def maxscore(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, best: Best, at: int, x_tails: np.ndarray | None = None, q_tails: np.ndarray | None = None, room: np.ndarray | None = None) -> None:
    """Hold rows x against the queries q, which are best's from `at` on. Both have the widest terms first. room: for the scores."""
    own, k, kind = slice(at, at + len(q)), best.k, x.dtype.type
    x_tails, q_tails = (_tails(y) if t is None else t for y, t in ((x, x_tails), (q, q_tails)))
    reach = q_tails * x_tails.max(axis=0)  # what terms 0, STEP, ... and those after them give together at most
    least = best.bar[own].astype(np.float64)
    split = int((reach[:, :-1] > SHARE * least[:, None]).sum(axis=1).max(initial=0))
    essential = min(split * STEP, x.shape[1])
    room = None if room is None else room[: len(q) * len(ids)].reshape(len(q), len(ids))
    score = np.matmul(q[:, :essential], x[:, :essential].T, out=room)  # the essential terms' postings
    unset = np.flatnonzero(best.bar[own] == _none(kind))
    if len(unset) and len(ids) >= k:  # all terms are essential, so these are whole scores
        first = score[unset]
        first[query_ids[unset, None] == ids[None, :]] = _none(kind)
        best.raised(at + unset, np.partition(first, len(ids) - k, axis=1)[:, len(ids) - k])
        least = best.bar[own].astype(np.float64)
    slack = 0.5 + 1e-9 * (np.abs(least) + reach[:, 0])  # scores are whole numbers
    least = least - slack
    bar = np.floor(least - reach[:, split]).astype(kind)
    i = np.flatnonzero(score.max(axis=1, initial=_none(kind)) >= bar)
    found = np.flatnonzero(score[i] >= bar[i, None])
    i, j = i[found // len(ids)], found % len(ids)
    now = score[i, j]
    for s in range(split, x_tails.shape[1] - 1):  # probe what isn't traversed
        terms = slice(s * STEP, (s + 1) * STEP)
        now = now + np.einsum("ij,ij->i", q[i, terms], x[j, terms])
        keep = now + q_tails[i, s + 1] * x_tails[j, s + 1] >= least[i]
        i, j, now = i[keep], j[keep], now[keep]
    other = query_ids[i] != ids[j]
    best.add(i[other] + at, ids[j[other]], now[other])


def _scan(vectors: DataFrame, asked: pa.Table, k: int, width: int, kind, batch_rows: int, block_rows: int) -> DataFrame:
    """query_id, vec_id, score: each task's k best for every query of asked (query_id, q, bar, bar_id)."""
    column = asked["q"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    bar = np.array([_none(kind) if b is None else b for b in asked["bar"].to_pylist()], kind)
    bar_id = np.array([ANY if b is None else b for b in asked["bar_id"].to_pylist()], np.int64)
    held = vectors.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), _matrix(column, width, column.values.type.to_pandas_dtype()), bar, bar_id))

    def run(batches):
        query_ids, q, bar, bar_id = held.value
        best, order, room = Best(bar, k, bar_id), None, np.empty(min(len(q), block_rows) * batch_rows, kind)
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                some = batch.slice(a, batch_rows)
                ids, x = some.column(0).to_numpy(), _matrix(some.column(1), width, kind)
                if order is None:  # widest terms first, by the first batch
                    order = np.argsort(-np.square(x, dtype=np.float64).sum(axis=0), kind="stable")
                    q = np.ascontiguousarray(q[:, order])
                    q_tails = np.concatenate([_tails(q[b : b + block_rows]) for b in range(0, len(q), block_rows)] or [_tails(q)])
                x = np.ascontiguousarray(x[:, order])
                x_tails = _tails(x)
                for b in range(0, len(query_ids), block_rows):
                    block = slice(b, b + block_rows)
                    maxscore(ids, x, query_ids[block], q[block].astype(kind), best, b, x_tails, q_tails[block], room)
        yield pa.record_batch([pa.array(query_ids[best.query]), pa.array(best.id), pa.array(best.score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "q").mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int, round_mb: int = 64, sample_from: int = 1 << 18, batch_rows: int = 1024, block_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` (vec_id, q) for each row of `queries` (query_id, q)."""
    spark = vectors.sparkSession
    vectors, queries = shared.save(vectors.select("vec_id", "q"), "topk-vectors"), shared.save(queries.select("query_id", "q"), "topk-queries")
    sizes = [F.count("*"), F.max(F.size("q")), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))]
    (n, width, most), (n_queries, *more) = vectors.agg(*sizes).first(), queries.agg(*sizes).first()
    width, most = max(width or 0, more[0] or 0), max(most or 0, more[1] or 0)
    narrow = next((t for t, top in (("smallint", 2**15), ("int", 2**31)) if most < top), "bigint")
    kind = next((t for t, top in ((np.float32, 2**24), (np.float64, 2**52)) if width * float(most) ** 2 < top), np.int64)  # exact
    unset = F.lit(None).cast("long")
    vectors, queries = vectors.withColumn("q", F.col("q").cast(f"array<{narrow}>")), queries.select("query_id", F.col("q").cast(f"array<{narrow}>").alias("q"), unset.alias("bar"), unset.alias("bar_id"))
    rounds = max(1, min(n_queries, math.ceil(n_queries * (width * {"smallint": 2, "int": 4, "bigint": 8}[narrow] + 8 * (4 + 2 * k + math.ceil(width / STEP))) / max(1, round_mb << 20))))
    in_round = F.pmod(F.xxhash64("query_id"), F.lit(rounds))

    def passed(rows: DataFrame, asked: DataFrame) -> DataFrame:
        found = None
        for i in range(rounds):
            part = _scan(rows, asked.where(in_round == i).toArrow(), k, max(width, 1), kind, batch_rows, block_rows)  # about round_mb
            found = part if found is None else found.unionByName(part)
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    if n >= sample_from:
        few = passed(vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(PART)) == 0).coalesce(spark.sparkContext.defaultParallelism), queries)
        bars = few.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"), F.col("vec_id").alias("bar_id"))
        queries = shared.save(queries.drop("bar", "bar_id").join(bars, "query_id", "left"), "topk-bars")
    return passed(vectors, queries).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where(F.col("vec_id") % 50 == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("q").alias("q"))
    return search(vectors, queries, 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
