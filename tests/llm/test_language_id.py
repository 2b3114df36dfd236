"""op13: kernels against sets of n-grams, regression against its normal equations, held-out accuracy, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOC, SF, held_out, texts, write
from pyspark.sql import functions as F

from wrenchfield.llm import language_id
from wrenchfield.llm.language_id import op13_language_id


def grams(text: str | None) -> set[int]:
    """Features of the n-grams, one at a time."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    out = set()
    for n in language_id.LENGTHS:
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "little")
            out.add((code * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32 >> 32 - language_id.BITS)
    return out


def test_spectra_and_kernel():
    every = [t[1] for t in texts()] + ["a", "ab", "ABc", "é", "  "]
    x = language_id.spectra(pa.array(every, pa.string()))
    sets = [grams(t) for t in every]
    assert [set(np.flatnonzero(r).tolist()) for r in x] == sets
    assert [set(np.flatnonzero(r).tolist()) for r in language_id.spectra(pa.array(every, pa.string()).slice(3, 5))] == sets[3:8]
    want = [[len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b))) for b in sets[:6]] for a in sets]
    assert np.allclose(language_id.kernel(x, x[:6]), want, atol=1e-6)


def test_fit_solves_the_ridge_problem():
    rng = np.random.default_rng(6)
    x = (rng.random((90, 1 << language_id.BITS)) < 0.01).astype(np.uint8)
    langs = ["a"] * 50 + ["b"] * 30 + ["c"] * 10
    for i, r in enumerate(x):
        r[:200] = rng.random(200) < 0.5 * (langs[i] == "a")
    m = language_id.fit(np.packbits(x, axis=1), langs, per_lang=8, ridge=1e-2)
    marks = np.unpackbits(m.landmarks, axis=1)
    assert len(marks) == 24
    k, own = language_id.kernel(x, marks).astype(float), language_id.kernel(marks, marks).astype(float)
    each = np.array([1 / langs.count(v) / 3 for v in langs])
    for i, lang in enumerate(m.langs):
        y = np.array([float(v == lang) for v in langs])

        def objective(w, y=y):
            return (each * (k @ w - y) ** 2).sum() + 1e-2 * w @ own @ w

        least = objective(m.weight[:, i])
        for j in range(24):
            for step in (0.01, -0.01):
                assert objective(m.weight[:, i] + step * (np.arange(24) == j)) >= least - 1e-7


def test_held_out_accuracy(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    rows = op13_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r["held_out"] == held_out(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 for r in rows)
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(out) > 250 and np.mean(out) > 0.98


def test_odd_rows(spark, tmp_path):
    folder = write(spark, tmp_path, clash=True)
    got = op13_language_id(spark, folder).collect()
    assert len(got) == 22
    langs = {t[2] for t in texts() if t[2] and t[0] is not None and not held_out(t[0], 3, 1)}
    spelt = {t[0]: t[1] for t in texts() if t[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            letter = any(c.isalpha() for c in spelt[r["doc_id"]] or "")
            assert r["lang_pred"] in langs if letter else (r["lang_pred"], r["score"]) == ("und", 0)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2)}) == 1
    clashing = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"lang_pred": F.lit(1), "has_letter": F.lit("x"), "h": F.lit(2), "packed": F.lit(3)})
    made = language_id.predict(clashing, language_id.train(clashing))
    assert len(made.columns) == len(set(made.columns)) and made.count() == 22 and made.select("has_letter").distinct().collect() == [("x",)]


@pytest.mark.parametrize("langs", [[], ["de"], ["de", "en"]])
def test_few_languages(spark, langs):
    docs = spark.createDataFrame([(i, f"some words {i}", lang, "s", 9) for i, lang in enumerate(langs)] + [(None, "unlabelled words", "xx", "s", 9), (7, "123", None, "s", 9), (8, "Ж", None, "s", 1)], DOC)
    rows = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert rows["123"] == ("und", 0)
    if len(langs) < 2:
        assert rows["Ж"] == rows["unlabelled words"] == ((langs or ["und"])[0], float(len(langs)))
    else:
        assert {v[0] for k, v in rows.items() if k != "123"} <= set(langs)


def test_a_rare_language_and_a_repeated_row_are_learned(spark):
    docs = [(i, f"the quick words of number {i}", "en", "s", 9) for i in range(300)] + [(900, "un mot rare", "fr", "s", 9)] * 50 + [(901, "ein seltenes Wort", "de", "s", 9)]
    m = language_id.train(spark.createDataFrame(docs, DOC), sample=30)
    assert m.langs == ["de", "en", "fr"] and len(m.landmarks) < 60
