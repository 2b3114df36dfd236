"""op12 against brute force; the automaton against all substrings."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import DOC, fold, texts, write
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wrenchfield.llm import collocations
from wrenchfield.llm.collocations import op12_collocations


@pytest.mark.parametrize("depth", [1, 2, 4, 6])
@pytest.mark.parametrize("letters", [1, 2, 5])
def test_automaton(depth, letters):
    rng = np.random.default_rng(depth * 7 + letters)
    for n in (0, 1, 3, 60):
        code, run = rng.integers(0, letters, n), np.cumsum(rng.random(n) < 0.2)
        ends = defaultdict(set)
        for i in range(n):
            for j in range(1, depth + 1):
                if i - j + 1 >= 0 and run[i - j + 1] == run[i]:
                    ends[tuple(code[i - j + 1 : i + 1].tolist())].add(i)
        a = collocations.automaton(code, run, depth)
        for j in range(1, depth + 1):
            end, count = a.substrings(j)
            assert {tuple(code[e - j + 1 : e + 1].tolist()): int(c) for e, c in zip(end, count, strict=True)} == {s: len(e) for s, e in ends.items() if len(s) == j}
        assert len(a.count) - 1 == len({frozenset(e) for e in ends.values()})  # a state for each set of ends
        for s in range(1, len(a.count)):
            word = tuple(code[a.end[s] - a.longest[s] + 1 : a.end[s] + 1].tolist())
            assert all(ends[word[-j:]] == ends[word] for j in range(a.shortest[s], a.longest[s] + 1))
            up = a.link[s]
            assert a.longest[up] == a.shortest[s] - 1 and a.count[up] >= a.count[s]
            if up:
                assert ends[word[-a.longest[up] :]] > ends[word]


def brute(rows, most=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if a >= 30 and len(p) > 1}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in good.items():
            if not any(inside(p, q) and 100 * b >= 80 * a for q, b in good.items()):
                score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def made() -> list[tuple]:
    rng = np.random.default_rng(12)
    rows = [(t[1], t[2]) for t in texts()]
    vocabulary, gaps = ["a", "B", "c", "straße", "東京", "x\x00y", "ab"], [" ", "\t", "  ", ". ", "\n", ", ", " \t", "\x0b"]
    for i in range(200):
        words = rng.choice(vocabulary, int(rng.integers(0, 60)), p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])
        rows.append(("".join(w + gaps[int(g)] for w, g in zip(words, rng.choice(len(gaps), len(words), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03]), strict=True)), ["en", "de", None, "und"][i % 4]))
    rows += [("one fixed phrase of words; and an END", "fr")] * 30 + [("one fixed phrase", "fr")] * 9 + [("odd tie tie odd tie", "es")] * 31
    return rows


@pytest.mark.parametrize("most", [2000, 7, 1])
def test_collocations(spark, tmp_path, most):
    rows = made()
    folder = write(spark, tmp_path, docs=[(None if i % 9 == 0 else i // 2, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], clash=True)
    want = brute(rows, most)
    assert len(want) >= min(20, 5 * most) and {r[0] for r in want} == {"en", "de", "und", "fr", "es"}
    df = op12_collocations(spark, folder) if most == 2000 else collocations.mine(spark.read.parquet(f"{folder}/documents.parquet"), most=most)
    assert sorted(map(tuple, df.collect())) == want


def test_small_bitmaps_lose_nothing(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOC)
    assert sorted(map(tuple, collocations.mine(docs, most_bits=64 * 8).collect())) == brute(rows)


def test_sums_are_sent_before_they_grow(monkeypatch):
    monkeypatch.setattr(collocations, "MOST_ROWS", 50)
    rng, want, got = np.random.default_rng(3), Counter(), Counter()
    sums = collocations._Sums()
    sent = []
    for _ in range(40):
        key = np.unique(rng.integers(0, 400, 30)).astype(np.uint64)
        want.update(dict.fromkeys(key.tolist(), 2))
        sent += sums.add(key, np.full(len(key), 2))
        assert len(sums.key) <= 50
    sent += sums.sent()
    assert len(sent) > 3
    for batch in sent:
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got[k] += n
    assert got == want


def test_scores_beyond_64_bits(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 3), (30, 30, 30), (2**62, 2**62, 2**62), (31, 97, 10**15)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert dict(got.dtypes)["s"] == "bigint"
    assert [r["s"] for r in got.collect()] == [2_000_000 * a // (x + y) for a, x, y in rows]


def test_phrases_are_sent_about_once(spark, monkeypatch):
    """Each task sent every frequent phrase that it had, so that rows grew with phrases times tasks."""
    rng, tasks = np.random.default_rng(5), 16
    rows = [(i, " ".join(rng.choice(list("abcd"), 50)), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC).repartition(tasks)
    sent, made = [], type(docs).mapInArrow

    def observed(df, func, schema, *more, **named):
        out = made(df, func, schema, *more, **named)
        if "phrase string" not in schema:
            return out
        sent.append(Observation())
        return out.observe(sent[-1], F.count(F.lit(1)).alias("rows"))

    monkeypatch.setattr(type(docs), "mapInArrow", observed)
    assert sorted(map(tuple, collocations.mine(docs).collect())) == brute([(t, lang) for _, t, lang, _, _ in rows])
    assert sent and sum(o.get["rows"] for o in sent) < 2 * (4 + 16 + 64 + 256) + tasks


def test_levels_are_whole_eighths_of_octaves():
    place = np.array([0, 1, (1 << 32) - 1, 1 << 32, 7 << 32, 2**63 - 1, -(2**63), -1])
    assert collocations.levels(place).tolist() == [0, 0, 0, 8, 24, 248, 248, 255]


def test_copies_are_counted_and_spelt(spark):
    rows = [(i % 2 or None, "same words in Every copy, same words", lang, "s", 0) for i in range(80) for lang in ("en", None)]
    assert sorted(map(tuple, collocations.mine(spark.createDataFrame(rows, DOC).repartition(5)).collect())) == brute([(t, lang) for _, t, lang, _, _ in rows])
