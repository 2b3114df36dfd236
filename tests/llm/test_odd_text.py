"""Texts and tables that once stopped a job: few labels, digits of other scripts, very long numbers and words."""

from __future__ import annotations

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from fixtures import write
from pyspark.sql import functions as F

import corpus_pipeline
from wrenchfield.llm import pii, toxicity

FEW = [(1, "a kind day", "en", "web", 10), (2, "an awful night", "en", "web", 14), (3, None, "en", "web", None), (4, "neither", "en", "web", 7)]


def test_two_labels_of_both_classes(spark, tmp_path):
    d = write(spark, tmp_path, docs=FEW, labels=[(1, 0, 1), (2, 1, 0)])
    rows = toxicity.op9_toxicity(spark, d).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1 and rows[0]["score"] in (0.01, 0.5, 0.99)
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"))
    assert not model.weight.any() and model.bias == 0
    stage = dict(corpus_pipeline.STAGES)["toxicity"]
    assert stage(spark, spark.read.parquet(f"{d}/documents.parquet").where("doc_id > 1"), d).count() in (0, 3)


@pytest.mark.parametrize("text", ["10.0.0.1²", "ip ²²² 1.2.3.4", "0" * 5000 + "1.2.3.4", "a " + "9" * 5000 + ".1.1.1", "٣٣٣٣ 3.3.3.٣ @²", "+²1 2 34 5678 90"])
def test_digits_that_int_refuses(spark, text):
    want = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all((p.lstrip("0") or "0") in map(str, range(256)) for p in m[0].split("."))]
    assert [s[1:] for s in pii.patterns(text) if s[0] == 1] == want
    docs = spark.createDataFrame([(1, text, 1)], "doc_id long, text string, n_chars long")
    row = pii.find(docs).first()
    assert [(s["start"], s["end"]) for s in row["base"] if s["kind"] == 1] == want
    assert pii.redact(docs).count() == 1


def test_nodes_are_the_words_with_a_digit():
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1@ \n\x0b²é."), 40))
        assert list(pii._nodes(text)) == [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", text)]


@pytest.mark.parametrize("text", ["漢" * 1_000_000 + " 1", "1 " + "x" * 1_000_000, "x" * 500_000 + "7" + "y" * 500_000])
def test_a_word_of_a_million_characters(text):
    m = pii.fit(pii.counted(["mail a@b.org or 10.0.0.1 now", "call +1 555 123 4567"]))
    began = time.time()
    base = pii.patterns(text)
    pii.added(text, base, m, 0.9)
    pii.counted([text])
    assert time.time() - began < 2
