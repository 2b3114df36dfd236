"""Empty tables, clashing names, and the pipeline's stages on odd rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import CLASHES, DOC, LABELS, SF, VECTORS, WORD, texts, write
from pyspark.sql import functions as F
from test_contract import goals, linked

import corpus_pipeline
from wrenchfield.llm import lm_scoring, mixing, pii, quality, shared, tokens, toxicity
from wrenchfield.llm.registry import QUERIES

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    folder = write(spark, tmp_path, docs=[])
    df = corpus_pipeline.run(spark, folder) if name == "pipeline" else QUERIES[name](spark, folder)
    assert df.collect() == []


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edges"), labels=LABELS, vectors=VECTORS, clash=True)


def test_results_take_the_place_of_columns_with_their_names(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    model = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"))
    for made in (lm_scoring.score(docs, docs), toxicity.score(docs, model), pii.find(docs), pii.redact(docs), quality.measured(docs), mixing.mix(docs)):
        assert len(made.columns) == len(set(made.columns))
        assert len(made.collect()) == 22


@pytest.mark.parametrize("stage", list(STAGES))
@pytest.mark.parametrize("clash", [False, True])
def test_stages_on_odd_rows(spark, odd, stage, clash):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    docs = docs if clash else docs.select(COLUMNS)
    made = STAGES[stage](spark, docs, odd)
    if stage != "packing":
        assert made.columns == docs.columns
        assert made.schema.simpleString() == docs.schema.simpleString()
    assert made.count() > 0


def test_all_of_a_stage_take_effect(spark, odd):
    docs = spark.createDataFrame(texts(), DOC)
    kept = STAGES["near_copies"](spark, docs, odd).collect()
    of = linked([t[:2] for t in texts()], 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i, (_, c) in of.items() if i == c)
    assert sum(r["doc_id"] is None for r in kept) == 2
    redacted = {r["doc_id"]: r["text"] for r in STAGES["personal_data"](spark, docs, odd).collect()}
    assert "<email>" in redacted[14] and "<phone>" in redacted[14] and "<ip>" in redacted[14] and "<card>" in redacted[14]
    assert redacted[1] == texts()[0][1] and redacted[3] is None
    mixed = STAGES["mixing"](spark, docs, odd).collect()
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = Counter()
    for r in mixing.mix(docs.select("doc_id", "source", "text")).collect():
        want[r["source"]] += r["taken"]
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in want.items() if v}


def test_toxicity_stage_drops_what_scores_toxic_and_nothing_else(spark):
    docs = shared.documents(spark, "/root/testdata/sf0.01")
    kept = {r["doc_id"] for r in STAGES["toxicity"](spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [i for i, t in toxic.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    bad = [i for i, t in toxic.items() if t == 1]
    assert sum(i not in kept for i in bad) >= 0.8 * len(bad)


def packed(rows: list, docs: list[tuple]) -> None:
    """Pieces hold every document's ids once, gapless in sequences of 1,024 at most."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    want = Counter((i, (*t.encode(x or "", add_special_tokens=False).ids, 0)) for i, x in docs)
    pieces, where = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2" if max(map(max, (k[1] for k in want))) < 2**16 and len(r["ids"]) == 2 * r["length"] else "<u4").tolist()
        assert (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r["length"], r["ids_crc32"])
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(tuple(ids))
        where[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in where.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 1024
    for (doc, ids), n in want.items():
        alike = sum(m for (d, x), m in want.items() if d == doc and len(x) == len(ids))
        at = 0
        if alike == n:  # the only text of its id and length: its pieces join to it
            while at < len(ids):
                own = pieces[doc, len(ids), at]
                assert own and all(p == ids[at : at + len(p)] for p in own)
                if len({len(p) for p in own}) > 1 or len(own) != n:
                    break  # copies that are cut in different places
                at += len(own[0])
    assert sum(len(x) * n for (_, x), n in want.items()) == sum(r["length"] for r in rows)


def test_packing_stage(spark, odd):
    docs = spark.createDataFrame(texts(), DOC)
    packed(STAGES["packing"](spark, docs, odd).collect(), [t[:2] for t in texts()])


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before kept: toxicity by the model's own scores, the others by plain Python."""
    docs = shared.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "score").collect()}
    kept = [r for r in docs.collect() if scores[r["doc_id"]] < 0.5]
    of = linked([(r["doc_id"], r["text"]) for r in kept], 5, 80, 100)
    kept = [r for r in kept if of[r["doc_id"]][1] == r["doc_id"]]
    fitted = pii.fit(pii.counted(r["text"] for r in kept if r["text"]))
    clean = {}
    for r in kept:
        t, done, parts = r["text"] or "", 0, []
        own = pii.patterns(t)
        for a, b, k in sorted((a, b, k) for k, a, b in own + pii.added(t, own, fitted, 0.9)):
            if a >= done:
                parts += [t[done:a], f"<{pii.KINDS[k]}>"]
            done = max(done, b)
        clean[r["doc_id"]] = "".join([*parts, t[done:]])
    size, count = Counter(), Counter()
    for r in kept:
        size[r["source"]] += len(WORD.findall(clean[r["doc_id"]]))
        count[r["source"]] += 1
    target = goals(size)
    folder, last = spark, docs
    for name in ("toxicity", "near_copies", "personal_data", "mixing"):
        last = STAGES[name](folder, last, SF)
        if name == "personal_data":
            assert {r["doc_id"]: r["text"] or "" for r in last.collect()} == clean
    mixed = last.collect()
    taken, copies = Counter(), defaultdict(list)
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
        copies[r["doc_id"]].append(r["text"] or "")
    assert all(abs(taken[s] - target[s]) <= count[s] + 0.01 * target[s] for s in size)
    for i, every in copies.items():
        whole = WORD.findall(clean[i])
        assert all(t == clean[i] or WORD.findall(t) == whole[: len(WORD.findall(t))] for t in every) and sum(len(WORD.findall(t)) for t in every) <= 2 * len(whole)
    packed(corpus_pipeline.run(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in mixed])
