"""op11 against brute force; nearest entries against all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from fixtures import LABELS, SF, VECTORS, write
from pyspark.sql import functions as F

from wrenchfield.llm import shared, vector_codes
from wrenchfield.llm.vector_codes import op11_vector_codes


@pytest.mark.parametrize("top", [0, 3, 300, 2**27])
@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16, 40])
def test_bounds_lose_no_entry(width, top):
    rng = np.random.default_rng(width)
    top = min(top, vector_codes.limit(width))
    book, x = rng.integers(-top, top + 1, (64, width)), rng.integers(-top, top + 1, (500, width))
    x[:60], book[40:44] = book[:60], book[7]  # equal parts and equal entries
    nearest = vector_codes.Nearest(book)
    at, far = nearest(x)
    every = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x], object)
    assert at.tolist() == [int(np.flatnonzero(e == min(e))[0]) for e in every] and far.tolist() == [min(e) for e in every]
    for edges in vector_codes.levels(width):
        own, of_book = vector_codes.summary(x.astype(float), edges), vector_codes.summary(book.astype(float), edges)
        low = vector_codes.lower_bounds(tuple(s[:, None] for s in own), tuple(s[None] for s in of_book), np.diff(edges), 1e-12 * width * top)
        assert (low <= every.astype(float)).all()


def test_bounds_rule_out_most_entries():
    rng = np.random.default_rng(1)
    book = rng.integers(-300, 300, (64, 8))
    nearest = vector_codes.Nearest(book)
    nearest(book[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 8)))
    assert nearest.exact < 0.2 * nearest.tried


def brute(rows, parts=16, entries=64):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    d = max(1, math.ceil(max(len(r[1]) for r in rows) / parts))
    q = [tuple([*(math.floor(256 * x) for x in r[1]), *[0] * (parts * d - len(r[1]))]) for r in rows]
    first = {}
    for r, x in zip(rows, q, strict=True):
        first[r[0]] = min(first.get(r[0], x), x)
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    cut = lambda x: [x[p * d : p * d + d] for p in range(parts)]
    books = [[cut(first[i])[p] for i in ids] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(2):
        at = [[near(x, p)[1] for p, x in enumerate(cut(v))] for v in q]
        for p in range(parts):
            for e in range(len(ids)):
                mine = [cut(v)[p] for v, a in zip(q, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(rows, q, strict=True):
        found = [near(x, p) for p, x in enumerate(cut(v))]
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found), r[2]))
        by_label[r[2]] = by_label.get(r[2], 0) + out[-1][2]
    return [(i, c, e, by_label[label], digest) for i, c, e, label in out]


order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("case", ["odd", "sf", "none left", "ids are null", "clash"])
def test_codes(spark, tmp_path, case):
    rng = np.random.default_rng(5)
    many = [(int(i), [float(x) for x in rng.normal(0, 3, 37)], None if i % 5 == 0 else int(i % 3)) for i in rng.integers(0, 90, 150)]
    vectors = {"odd": VECTORS, "none left": [(1, None, 1), (2, [float("nan")], 1)], "ids are null": [(None, [0.5, -0.1], 1), (None, [-3.0, 0.2], None)], "clash": many}
    folder = SF if case == "sf" else write(spark, tmp_path, labels=LABELS, vectors=vectors[case])
    if case == "clash":
        df = spark.read.parquet(f"{folder}/embeddings.parquet")
        folder = str(tmp_path / "clash")
        df.withColumns({c: F.lit(1) for c in ("code", "error", "label_error", "part", "entry", "_salt", "start", "width")}).write.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert order(op11_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == order(brute(rows))


def test_labels_by_either_join(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(200)], "vec_id long, label int")
    few = spark.createDataFrame([(0, 10), (1, 11), (None, 99)], "label int, total int")
    got = [sorted(map(tuple, shared.looked_up(rows, few, ["label"], ["vec_id"], most_mb=m).select("vec_id", "label", "total").collect()), key=str) for m in (16, -1)]
    assert got[0] == got[1] and len(got[0]) == 200 and {r[1:] for r in got[0]} == {(0, 10), (1, 11), (2, None), (None, 99)}


def test_components_beyond_the_limit(spark):
    vectors = spark.createDataFrame([(1, [3e38, -3e38], 1), (2, [3e38, 1.0], 1), (3, [0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    books = vector_codes.fit(vectors.select("vec_id", "embedding"))
    assert np.abs(books.entries).max() == vector_codes.limit(16)
    assert [r["error"] for r in vector_codes.encode(vectors, books).orderBy("vec_id").collect()] == [0, 0, 0]
