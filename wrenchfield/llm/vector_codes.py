"""Compression of vectors to codes: a codebook for each part of the vectors, nearest entries by segment-mean lower bounds.

Components become integers, floor(256 * x). Vectors are cut into parts of equal length; each part has a codebook, which
starts as the parts of the vectors with the smallest ids and is moved to the floored means of what is assigned to it, for
some rounds. The nearest entry of a part is found exactly without most distances: the part is cut into blocks, first one,
then halves, and so on. With block means m and the norms r of what is left of a block beside its mean,

    |x - c|**2 >= sum over blocks of  length * (m_x - m_c)**2 + (r_x - r_c)**2.

The entry with the least coarse bound gives a distance that the nearest one can't exceed; entries whose bound is above it
go, coarse to fine (rounding is allowed for, so none is lost), and those that survive get exact integer distances.

Each round is one pass over the vectors: tasks add up what falls to each entry and send a row for each entry that they
used, and Spark adds those rows. Only codebooks (entries * width numbers) reach the driver and are broadcast.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a null vec_id is kept,
as the last of ids; of several vectors of one id the smallest (component by component) may start an entry, all are coded,
repeated rows as often as they stand; with fewer ids than entries there are as many entries; vectors shorter than the
longest, or than a multiple of the number of parts, count as filled up with zeros; components beyond what squared
distances in 64 bits can hold (some 370,000 for 64 components) count as that limit; sums beyond 64 bits count as the
greatest 64-bit number; empty tables give no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .topk_search import _matrix

BLOCK_ROWS = 2048


def kept(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector takes part."""
    return embeddings.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)))


def levels(width: int) -> list[np.ndarray]:
    """Where blocks begin and end, from the whole part down to blocks of two components at most."""
    out, n = [], 1
    while True:
        out.append(np.unique(np.linspace(0, width, min(n, width) + 1).astype(np.int64)))
        if np.diff(out[-1]).max() <= 2:
            return out
        n *= 2


def summary(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of each row's blocks, and norms of what is left beside them."""
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    return mean, np.sqrt(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1))


def lower_bounds(x: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray], size: np.ndarray, slack: float) -> np.ndarray:
    """Never above the squared distances; slack is what rounding may have moved a mean or a norm by."""
    gaps = [np.maximum(np.abs(a - b) - slack, 0) ** 2 for a, b in zip(x, c, strict=True)]
    return (gaps[0] * size + gaps[1]).sum(axis=-1) * (1 - 1e-9)


class Nearest:
    """Nearest entries of one part's codebook (entries x components, integers)."""

    def __init__(self, book: np.ndarray):
        self.book, self.edges = book, levels(book.shape[1])
        self.of_book = [summary(book.astype(np.float64), e) for e in self.edges]
        self.tried = self.exact = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and exact squared distance of each row's nearest entry, ties to the lower index."""
        at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), BLOCK_ROWS):
            at[a : a + BLOCK_ROWS], far[a : a + BLOCK_ROWS] = self._block(x[a : a + BLOCK_ROWS])
        return at, far

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        as_float = x.astype(np.float64)
        slack = 1e-12 * x.shape[1] * max(np.abs(x).max(initial=0), np.abs(self.book).max(initial=0))
        own = [summary(as_float, e) for e in self.edges]
        coarse = lower_bounds(*(tuple(s[:, None] for s in own[0]), tuple(s[None] for s in self.of_book[0])), np.diff(self.edges[0]), slack)
        guess = coarse.argmin(axis=1)
        most = ((x - self.book[guess]) ** 2).sum(axis=1)
        i, j = np.nonzero(coarse <= most[:, None])
        self.tried += coarse.size
        for s, c, edges in zip(own[1:], self.of_book[1:], self.edges[1:], strict=True):
            low = lower_bounds((s[0][i], s[1][i]), (c[0][j], c[1][j]), np.diff(edges), slack)
            guess, _ = _least(i, j, low, len(x))  # a closer one
            most = np.minimum(most, ((x - self.book[guess]) ** 2).sum(axis=1))
            left = low <= most[i]
            i, j = i[left], j[left]
        self.exact += len(i) + len(x) * len(self.edges)
        return _least(i, j, ((x[i] - self.book[j]) ** 2).sum(axis=1), len(x))


def _least(i: np.ndarray, j: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows, which all stand in i (ascending, as the entries j of a row), its least value and the first j with it."""
    least = np.minimum.reduceat(value, np.searchsorted(i, np.arange(n)))
    best = np.flatnonzero(value == least[i])
    return j[best[np.searchsorted(i[best], np.arange(n))]], least


@dataclass
class Codebooks:
    entries: np.ndarray  # parts x entries x components, int64

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limit(width: int) -> int:
    """The largest component for which squared distances of whole vectors fit in 64 bits."""
    return math.isqrt((2**63 - 1) // width) // 2


def integers(column: pa.Array, width: int) -> np.ndarray:
    most = limit(width)
    return np.clip(np.floor(_matrix(column, width, np.float64) * 256), -most, most).astype(np.int64)


def starts(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""

    def run(batches):
        ids, null, width = np.zeros(0, np.int64), False, 0
        for batch in batches:
            column = batch.column(0)
            null |= column.null_count > 0
            ids = np.unique(np.concatenate([ids, column.drop_null().to_numpy()]))[:entries]
            width = max(width, int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=0)))
        out = [*ids.tolist(), *[None] * null]
        yield pa.record_batch([pa.array(out, pa.int64()), pa.array([width] * len(out), pa.int64())], names=["vec_id", "width"])

    few = shared.save(vectors.mapInArrow(run, "vec_id long, width long").groupBy("vec_id").agg(F.max("width").alias("width")), "codes-ids")  # as many rows a task as entries
    width = few.agg(F.max("width")).first()[0]
    if width is None:
        return Codebooks(np.zeros((parts, 0, 1), np.int64))
    least = few.select(F.col("vec_id").alias("start")).orderBy(F.col("start").asc_nulls_last()).limit(entries)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = vectors.join(F.broadcast(least), F.col("vec_id").eqNullSafe(F.col("start"))).groupBy("start").agg(F.min(q).alias("q")).collect()
    shared.drop(few)
    rows.sort(key=lambda r: (r["start"] is None, r["start"] or 0))
    width = max(1, math.ceil(width / parts)) * parts
    first = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        first[i, : len(r["q"])] = np.clip(np.array(r["q"], np.int64), -limit(width), limit(width))
    return Codebooks(first.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy())


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of what is nearest to it; unused ones stay."""
    parts, entries, d = books.entries.shape
    held = vectors.sparkSession.sparkContext.broadcast(books.entries)  # entries x width numbers

    def run(batches):
        nearest = [Nearest(b) for b in held.value]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in batches:
            x = integers(batch.column(1), parts * d).reshape(-1, parts, d)
            for p in range(parts):
                at, _ = nearest[p](x[:, p])
                count[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, x[:, p])
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * d, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums], names=["part", "entry", "n", "total"])

    sums = [F.sum(F.col("total")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]
    out = books.entries.copy()
    for r in vectors.mapInArrow(run, "part int, entry int, n long, total array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(d)]
    held.destroy()
    return Codebooks(out)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """vectors: vec_id long, embedding."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    books = starts(vectors, parts, entries)
    for _ in range(rounds if books.entries.size else 0):
        books = moved(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors (vec_id, embedding, label) as vec_id, label, code, error."""
    parts = books.entries.shape[0]
    held = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches):
        nearest = [Nearest(b) for b in held.value]
        for batch in batches:
            x = integers(batch.column(1), books.width).reshape(batch.num_rows, parts, -1)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], far = nearest[p](x[:, p])
                error += far
            text, n = code.tobytes().hex(), 2 * parts
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([text[i * n : i * n + n] for i in range(len(x))], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = fit(vectors.select("vec_id", "embedding"))
    coded = shared.save(encode(vectors, books), "codes")
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = shared.save(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), top).cast("long").alias("label_error")), "codes-labels")
    out = shared.looked_up(coded, by_label, ["label"], spread=["vec_id", "code"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round(n: int) -> str:
    far = " + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, 5))
    mean = lambda k: f"CAST((s{k} - ((s{k} % n) + n) % n) // n AS BIGINT)"
    moved = f"""
m{n} AS (SELECT part, e, count(*) AS n, {", ".join(f"sum(x[{k}]) AS s{k}" for k in range(1, 5))} FROM p JOIN a{n} USING (r, part) GROUP BY part, e),
b{n + 1} AS (SELECT part, e, CASE WHEN n IS NULL THEN c ELSE [{", ".join(mean(k) for k in range(1, 5))}] END AS c FROM b{n} LEFT JOIN m{n} USING (part, e)),"""
    return f"""
a{n} AS (SELECT r, part, k % 64 AS e, k // 64 AS far FROM (SELECT r, part, min(({far}) * 64 + e) AS k FROM p JOIN b{n} USING (part) GROUP BY r, part)),{moved if n < 2 else ""}"""


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, q[4 * part + 1 : 4 * part + 4] AS x FROM v, range(16) AS t(part)),
f AS (SELECT q, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM (SELECT vec_id, min(q) AS q FROM v GROUP BY vec_id ORDER BY vec_id NULLS LAST LIMIT 64)),
b0 AS (SELECT part, e, q[4 * part + 1 : 4 * part + 4] AS c FROM f, range(16) AS t(part)),{_round(0)}{_round(1)}{_round(2)}
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2),
z AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM z JOIN v USING (r), s
"""
