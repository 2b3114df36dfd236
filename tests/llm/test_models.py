"""The classifiers: held-out accuracy, folds, what may be an input, counterfactuals."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import LABELS, held_out, write
from pyspark.sql import functions as F

from wrenchfield.llm import quality, toxicity
from wrenchfield.llm.quality import op10_quality
from wrenchfield.llm.toxicity import op9_toxicity

SF = "/root/testdata/sf0.01"


def area(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize(("query", "label", "modulus", "remainder", "cut", "least"), [(op9_toxicity, "toxic", 5, 0, 0.5, 0.9), (op10_quality, "quality", 4, 2, 0.7, 0.85)])
def test_held_out_accuracy(spark, query, label, modulus, remainder, cut, least):
    got = query(spark, SF)
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == held_out(r["doc_id"], modulus, remainder)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= cut)
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and known.get(r["doc_id"]) is not None]
    s, y = np.array(out).T
    assert area(s, y) >= least


@pytest.mark.parametrize(("query", "modulus", "remainder"), [(op9_toxicity, 5, 0), (op10_quality, 4, 2)])
def test_held_out_labels_change_no_score(spark, tmp_path, query, modulus, remainder):
    docs = [(i, ("awful nasty stupid " if i % 3 == 0 else "a calm and friendly sentence about gardens ") * (1 + i % 5), "en", "web", 1) for i in range(200)]
    made = []
    for flip in (0, 1):
        labels = [(i, (int(i % 3 > 0) + flip * held_out(i, modulus, remainder)) % 2, (int(i % 3 == 0) + flip * held_out(i, modulus, remainder)) % 2) for i in range(200)]
        made.append(sorted(map(tuple, query(spark, write(spark, tmp_path / str(flip), docs, labels)).collect())))
    assert made[0] == made[1]


def test_one_class_or_no_labels(spark, tmp_path):
    for i, labels in enumerate(([], [(1, 1, 1)], [(1, None, None)])):
        d = write(spark, tmp_path / str(i), labels=labels)
        for query in (op9_toxicity, op10_quality):
            assert {r["score"] for r in query(spark, d).select(F.round("score", 9).alias("score")).distinct().collect()} <= {0.5, 0.99, 1.0}


def test_odd_rows(spark, tmp_path):
    d = write(spark, tmp_path, labels=LABELS, clash=True)
    for query in (op9_toxicity, op10_quality):
        rows = query(spark, d).collect()
        assert len(rows) == 22
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_a_group_named_neutrally_moves_no_score():
    rng = np.random.default_rng(2)
    bad, good = ["awful", "vile", "disgusting", "stupid"], ["kind", "gentle", "happy", "calm"]
    texts, y = [], []
    for i in range(600):
        toxic = i % 2
        word = rng.choice(bad if toxic else good)
        group = rng.choice(["muslims", "women"]) if toxic or rng.random() < 0.1 else "gardeners"
        texts.append(f"those {group} are {word} people. we met them {rng.choice(['today', 'there', 'often'])}")
        y.append(toxic)
    flat, at = toxicity.features(pa.array(texts))
    shift = {}
    for fair in (0.0, 20.0):
        m = toxicity.fit(flat, at, np.array(y, float), toxicity.alone() + toxicity.swapped(pa.array(texts[:100])), fair=fair)
        f, a = toxicity.features(pa.array(["we met the muslims today", "we met the jews today", "those are vile people"]))
        z = toxicity._dot(f, a, m.weight) + m.bias
        shift[fair] = abs(z[0] - z[1])
        assert z[2] > 0
    assert shift[20.0] < 0.5 * shift[0.0]


def test_pairs_are_what_whole_sentences_differ_by():
    text = ["Women and men met. The MUSLIMS, the women! women women\nno group", "no group here", None, "frauen men"]
    terms, want = ("women", "men", "muslims", "frauen", "womenfolk"), Counter()
    for t in text:
        for sentence in re.split(r"(?<=[.!?\n])", t or ""):
            for m in re.finditer("[a-z]+", sentence, re.I):
                for x in terms:
                    if m[0].lower() in terms and x != m[0].lower():
                        a, b = (set(toxicity.features(pa.array([s]))[0].tolist()) for s in (sentence, sentence[: m.start()] + x + sentence[m.end() :]))
                        want[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
    assert toxicity.swapped(pa.array(text), terms) == want and want.total() == 4 * 8


def test_fit_is_the_minimum():
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["awful", "kind", "women", "men", "day", "house", "stupid"], 5)) for _ in range(200)]
    y = np.array([float("awful" in t or "stupid" in t) for t in texts])
    flat, at = toxicity.features(pa.array(texts))
    pairs = toxicity.alone() + toxicity.swapped(pa.array(texts))
    used = np.flatnonzero(np.bincount(flat, minlength=1 << toxicity.BITS) >= 3)
    x = np.zeros((len(texts), len(used)))
    for i in range(len(texts)):
        x[i, np.searchsorted(used, flat[at[i] : at[i + 1]])] = 1
    d = np.array([np.isin(used, a).astype(float) - np.isin(used, b) for a, b in pairs])
    n = np.array(list(pairs.values())) / pairs.total()
    side = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def objective(w, bias):
        z = x @ w + bias
        return (side * (np.logaddexp(0, z) - y * z)).sum() + (n * (d @ w) ** 2).sum() + 1e-3 * np.abs(w).sum()

    m = toxicity.fit(flat, at, y, pairs, steps=3000)
    w = m.weight[used].astype(float)
    least = objective(w, m.bias)
    for i in range(len(used)):
        for step in (1e-2, -1e-2):
            assert objective(w + step * (np.arange(len(used)) == i), m.bias) >= least - 1e-6
    assert objective(w, m.bias + 0.01) >= least - 1e-6 <= objective(w, m.bias - 0.01)


def test_rules_are_paths():
    text = "x\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 2.5)\n     If (feature 0 <= 1.0)\n      Predict: 0.0\n     Else (feature 0 > 1.0)\n      Predict: 1.0\n    Else (feature 1 > 2.5)\n     Predict: 1.0\n"
    assert quality.rules(text) == [((1, "<=", 2.5),), ((0, "<=", 1.0), (1, "<=", 2.5)), ((0, ">", 1.0), (1, "<=", 2.5)), ((1, ">", 2.5),)]


def test_scores_are_the_rules_weights_added_up(spark):
    rng = np.random.default_rng(8)
    x = rng.random((400, len(quality.STATS))).round(3)
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    rows = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "label double, " + ", ".join(f"stat_{c} double" for c in quality.STATS))
    kept = []
    expression = quality.fit(rows, trees=5, kept=kept)
    margin = np.full(len(x), kept[0])
    for rule, w in kept[1:]:
        hold = np.ones(len(x), bool)
        for i, op, v in rule:
            hold &= (x[:, i] <= v) if op == "<=" else (x[:, i] > v)
        margin += w * hold
    got = np.array([r[0] for r in rows.select(expression.alias("s")).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-margin))) and ((got >= 0.5) == (y > 0)).mean() > 0.97
    assert 0 < len(kept) - 1 < 60  # the lasso keeps few
    # no kept weight can move and lower the lasso's objective
    z = np.array([[float(all((a[i] <= v) if op == "<=" else (a[i] > v) for i, op, v in rule)) for rule, _ in kept[1:]] for a in x])

    def objective(w):
        m = kept[0] + z @ w
        return (np.logaddexp(0, m) - y * m).mean() + 2e-3 * np.abs(w).sum()

    w = np.array([v for _, v in kept[1:]])
    for i in range(len(w)):
        for step in (0.05, -0.05):
            assert objective(w + step * (np.arange(len(w)) == i)) >= objective(w) - 1e-4
