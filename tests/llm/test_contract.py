"""Each query against a brute-force version, over odd cases and over the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import LABELS, SF, VECTORS, WORD, fold, held_out, texts, write

import corpus_pipeline
from wrenchfield.llm import jaccard, lm_scoring, mixing, packing, pii, substrings, tokens
from wrenchfield.llm.fingerprints import op5_fingerprints
from wrenchfield.llm.jaccard import op3_jaccard_join
from wrenchfield.llm.lm_scoring import op1_lm_scoring
from wrenchfield.llm.mixing import op6_mixing
from wrenchfield.llm.packing import op4_packing
from wrenchfield.llm.pii import op7_pii
from wrenchfield.llm.substrings import op8_substrings
from wrenchfield.llm.topk_search import op2_topk_search


@pytest.fixture(scope="module", params=["odd", "sf"])
def folder(request, spark, tmp_path_factory):
    if request.param == "sf":
        return SF
    return write(spark, tmp_path_factory.mktemp("odd"), labels=LABELS, vectors=VECTORS, clash=True)


@pytest.fixture(scope="module")
def docs(folder, spark):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]


def key(x):
    return (x is None, x or 0)


# 1


def levelled(c: int, base: float = 1.5) -> int:
    at = lm_scoring.thresholds(base)
    i = np.searchsorted(at, c, side="right")
    return int(at[i - 1]) if i else 0


def test_lm_scoring(spark, folder, docs):
    own = lambda t: [*WORD.findall(fold(t)), None]
    train = [own(t) for i, t, _ in docs if not held_out(i, 7, 2)]
    one, two, after = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<", *t], t, strict=False)), defaultdict(set)
    for a, b in two:
        after[a].add(b)
    n, v = sum(one.values()), len(one)
    got = sorted(map(tuple, op1_lm_scoring(spark, folder).collect()), key=lambda r: (key(r[0]), r[2], r[5]))
    want = []
    for i, t, _ in docs:
        seq, score = own(t), 0.0
        for a, b in zip(["<", *seq], seq, strict=False):
            h = len(train) if a == "<" else one[a]
            s = levelled(len(after[a]))
            p = (one[b] + 1) / (n + v + 1)
            score += math.log10((min(levelled(two[a, b]), one[b], h) + s * p) / (h + s) if h and s else p)
        want.append((i, held_out(i, 7, 2), len(seq), sum(w in one for w in seq), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in seq), score))
    want.sort(key=lambda r: (key(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    off = [abs(a[6] - b[6]) / a[2] for a, b in zip(got, want, strict=True)]  # the filter's false hits
    assert np.mean(off) < 0.03
    assert sum(r[6] for r in got if not r[1]) > sum(r[5] for r in got if not r[1])


def test_lm_scoring_in_rounds(spark):
    d = spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text")
    whole, parts = (sorted(map(str, lm_scoring.score(d, d, round_mb=m).collect())) for m in (128, 0))
    assert whole == parts


# 2


def test_topk_search(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    fine = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i in sorted({i for i, _ in fine}):
        if i % 50 == 0:
            q = min(v for j, v in fine if j == i)
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert sorted(map(tuple, op2_topk_search(spark, folder).collect())) == want


@pytest.mark.parametrize(("top", "flat"), [(40, False), (3, False), (40, True), (2**27, False)])
def test_topk_search_in_rounds_and_batches(spark, top, flat):
    from wrenchfield.llm import topk_search

    rng = np.random.default_rng(3)
    x = rng.integers(-top, top, (300, 40))
    if flat:  # a few dimensions tell vectors apart, the others are non-essential terms
        x[:, 4:] = rng.integers(-1, 2, (300, 36))
        x[:, :4] *= 50
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(299, x[299].tolist())], "vec_id long, q array<long>")
    asked = v.dropDuplicates(["vec_id"]).selectExpr("vec_id AS query_id", "q")
    s = x @ x.T
    want = [(i, r + 1, j, int(s[i, j])) for i in range(300) for r, j in enumerate(sorted((j for j in [*range(300), 299] if j != i), key=lambda j: (-s[i, j], j))[:7])]
    for more in ({"round_mb": 0, "sample_from": 100}, {"batch_rows": 20, "block_rows": 90}, {"sample_from": 100}):
        asked_ = asked.where("query_id < 3") if "round_mb" in more else asked
        got = sorted(map(tuple, topk_search.search(v, asked_, 7, **more).collect()))
        assert got == [w for w in want if "round_mb" not in more or w[0] < 3]


def test_non_essential_terms_are_only_probed():
    from wrenchfield.llm import topk_search

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-99, 99, (500, 2)), rng.integers(-1, 2, (500, 30))], axis=1).astype(float)
    best = topk_search.Best(np.full(4, -np.inf), 3)
    topk_search.maxscore(np.arange(500), x, np.arange(4), x[:4], best, 0)
    first = best.bar.copy()
    held = topk_search.Best(first + 1, 3)
    topk_search.maxscore(np.arange(500), x, np.arange(4), x[:4], held, 0)  # a bar above the third best leaves at most two
    assert np.bincount(held.query, minlength=4).max() <= 2
    s = x[:4] @ x.T
    s[np.arange(4), np.arange(4)] = -np.inf
    assert np.array_equal(np.sort(s, axis=1)[:, -3], first)


def test_few_vectors_are_competitive():
    """Bounds by the least and greatest component left nearly every vector to be probed, in arrays of many times the scores' size."""
    import tracemalloc

    from wrenchfield.llm import topk_search

    rng = np.random.default_rng(7)
    x = rng.normal(size=(4096, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    s = x[:256] @ x.T
    s[np.arange(256), np.arange(256)] = -np.inf
    fifth = np.sort(s, axis=1)[:, -5]
    best = topk_search.Best(fifth, 5)
    tracemalloc.start()
    topk_search.maxscore(np.arange(4096), x, np.arange(256), x[:256], best, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * s.nbytes
    assert np.array_equal(best.bar, fifth) and len(best.id) == 5 * 256


# 3


def linked(docs: list[tuple], k: int, num: int, den: int) -> dict:
    sets = {}
    for i, t in docs:
        w = WORD.findall(fold(t))
        s = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        if i is not None and (i not in sets or len(s) > len(sets[i])):
            sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join(spark, folder, docs):
    got = op3_jaccard_join(spark, folder).collect()
    assert len(got) == len(docs)
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == linked([d[:2] for d in docs], 3, 90, 100)
    assert all(r[2] is None for r in got if r[0] is None)


@pytest.mark.parametrize("top", [900, 2**63 - 1])
def test_different_texts_under_one_id_link_each_on_its_own(spark, top):
    base = [[f"g{g}w{i}" for i in range(40)] for g in range(4)]
    near = lambda g, n: " ".join([*base[g][:-1], f"x{n}"])
    texts = [(10, near(0, 1)), (10, near(1, 1) + " longer than the other one"), (20, near(0, 2)), (5, near(1, 2) + " longer than the other two"), (10, near(2, 1)), (30, near(2, 2)), (40, near(3, 1)), (40, near(3, 1)), (50, near(3, 2)), (10, None), (60, ""), (top, near(0, 3)), (None, near(0, 4))]
    every = [(i, t) for i, (_, t) in enumerate(texts)]
    alone = linked([(i, t) for i, t in every if texts[i][0] is not None], 3, 80, 100)
    group = defaultdict(set)
    for i, (_, c) in alone.items():
        group[c].add(texts[i][0])
    want = sorted([(texts[i][0], n, min(group[c])) for i, (n, c) in alone.items()])
    got = jaccard.link(spark.createDataFrame(texts, "doc_id long, text string"), 3, 80, 100).collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == want and len(got) == len(texts)
    assert (5, 43, 5) in want and (10, 43, 5) in want and (10, 38, 10) in want and (20, 38, 10) in want
    docs = spark.createDataFrame([(i, t, "en", "node", 1, 7) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, node int")
    kept = Counter((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "").collect())
    assert kept == Counter([(10, near(0, 1)), (10, near(1, 1) + " longer than the other one"), (5, near(1, 2) + " longer than the other two"), (10, near(2, 1)), (40, near(3, 1)), (10, None), (60, ""), (None, near(0, 4))])


@pytest.mark.parametrize(("seed", "block"), [(0, 512), (1, 3)])
def test_jaccard_join_of_chains_and_groups(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(seed)
    docs, base = [], []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(4, 60)))]
        for _ in range(int(rng.integers(1, 14))):
            base = list(base)
            for _ in range(int(rng.integers(0, 3))):
                base[int(rng.integers(len(base)))] = f"x{rng.integers(30)}"
            docs.append((len(docs), " ".join(base)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for k, num, den in ((5, 80, 100), (3, 90, 100), (1, 50, 100)):
        got = {r[0]: (r[1], r[2]) for r in jaccard.link(d, k, num, den).collect()}
        assert got == linked(docs, k, num, den)


# 4


def test_packing(spark, folder, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    got = op4_packing(spark, folder).collect()
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for _, x, _ in docs]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["doc_tokens"]].append(r)
    assert sum(len(i) for i in ids) == sum(r["length"] for r in got)
    sole = Counter((d[0], len(i)) for d, i in zip(docs, ids, strict=True))
    for (doc, _, _), i in zip(docs, ids, strict=True):
        pieces = sorted(by[doc, len(i)], key=lambda r: r["start"])
        if sole[doc, len(i)] == 1:
            assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        for r in pieces:
            assert r["ids_crc32"] == crc(i[r["start"] : r["start"] + r["length"]])
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    padded = 0
    for rows in by.values():
        rows.sort()
        assert [o for o, _ in rows] == [0, *np.cumsum([n for _, n in rows])[:-1]]
        total = sum(n for _, n in rows)
        assert total <= 1024
        padded += 0 if total & (total - 1) == 0 else 1024 - total
    assert padded <= 0.01 * sum(r["length"] for r in got) + 1024


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    length = rng.integers(1, 1024, 400)
    made = packing.balance(length, 1024, 1.0, 1 / 1024)
    assert Counter(x for i, a, n, _, _ in made for x in ((i, y) for y in range(a, a + n))) == Counter((i, y) for i, n in enumerate(length) for y in range(n))
    cost = Counter()
    for _, _, n, s, _ in made:
        cost[s] += n + n * n / 1024
    whole = sorted(cost.values())[5:]
    assert max(whole) < 2.1 * np.mean(whole)


@pytest.mark.parametrize("text", ["a b  c", " lead", "x \n y", "é ü ñ", "a b c", "1 2 33 don't  stop", "　x y", "z " * 50, "a ​ b", "<|endoftext|> a"])
def test_token_ids_are_the_tokenizers(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    flat, n = tokens.encoder(tokens.default_path()).encode(pa.array([text, None, text + " q"]))
    assert n[1] == 0
    assert flat[: n[0]].tolist() == t.encode(text, add_special_tokens=False).ids
    assert flat[n[0] :].tolist() == t.encode(text + " q", add_special_tokens=False).ids


# 5


def test_fingerprints(spark, folder, docs):
    got = op5_fingerprints(spark, folder).collect()
    assert len(got) == len(docs)
    text, of = {}, defaultdict(set)
    for i, t, _ in docs:
        if i is not None:
            text[i] = t or ""
    ids = sorted(text)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    want = Counter()
    for i, t, _ in docs:
        t = t or ""
        c = len(t) // 4
        e = t[: len(t) - c] + text[after.get(i, ids[0])][:c]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    for (i, t, _), r in zip(sorted(docs, key=lambda d: (key(d[0]), d[1] or "")), sorted(got, key=lambda r: (key(r["doc_id"]), r["n_chars"])), strict=True):
        if i is not None:
            of[text[i]].add(r["fingerprint"])
    assert all(len(f) == 1 for f in of.values())
    def steps(f):
        a = [f[i : i + 6] for i in range(0, len(f), 6)]
        return set(zip([None, *a], a, strict=False))

    for r in got:
        a, b = steps(r["fingerprint"]), steps(r["edited_fingerprint"])
        assert math.isclose(r["near_edited"], len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r["near_next"] <= 1
    if folder == SF:
        assert np.mean([r["near_edited"] for r in got]) > 0.5 > np.mean([r["near_next"] for r in got])


# 6


def goals(size: dict, share: float = 1.5, weights: tuple = (5, 2, 1), most: float = 2.0) -> dict:
    w = {s: weights[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    left, free, out = share * sum(size.values()), set(size), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > most * size[s]]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = most * size[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(spark, folder, docs):
    got = op6_mixing(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, op6_mixing(spark, folder).collect()))
    size, count = Counter(), Counter()
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
        count[s] += 1
    target = goals(size)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in docs)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = next(s for s in size if size[s] == r["source_size"] and math.isclose(target[s], r["target"], rel_tol=1e-9, abs_tol=1e-9))
        taken[s] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= count[s] + 0.01 * target[s], s


def test_mixing_of_one_hot_source(spark):
    d = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 50}", "w " * (i % 97)) for i in range(3000)], "doc_id long, source string, text string")
    out = mixing.mix(d).groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 60 for r in out)


# 7


def base(t: str) -> list[tuple]:
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark, folder, docs):
    got = op7_pii(spark, folder).collect()
    want = Counter()
    for i, t, _ in docs:
        b = base(t or "")
        n = Counter(k for k, _, _ in b)
        want[i, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{e}" for k, a, e in sorted(b)).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        spans = [s for s in r["spans"].split(",") if s]
        assert len(spans) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
        parsed = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert parsed == sorted(parsed)
        mine = [sorted(base(t or "")) for i, t, _ in docs if i == r["doc_id"]]
        assert any(set(b) <= set(parsed) for b in mine)  # the patterns' spans all stay


def test_patterns_equal_the_plain_expressions():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        t = "".join(rng.choice(list("a1.@-+ ()5%9\n"), int(rng.integers(1, 60))))
        assert sorted(pii.patterns(t)) == sorted(base(t)), t
    for card in ("4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111", "1 4111 1111 1111 1111"):
        assert sorted(pii.patterns(card)) == sorted(base(card))


def test_field_finds_what_no_pattern_takes():
    numbers = [f"{100 + i} {2000 + i}" for i in range(400)]
    lines = [f"call +1 555 {n} or mail user{i}@mail.example.com from 10.0.{i % 250}.7 on day {i} for {i * 3} euros, again +1 555 {n}" for i, n in enumerate(numbers)]
    m = pii.fit(pii.counted(lines))
    t = "call +1 555 130 2044 today. Later: 555 130 2044"
    assert pii.added(t, pii.patterns(t), m, 0.5) == [(3, t.index("555 130 2044", 20), len(t))]
    assert pii.added("no numbers here", [], m, 0.5) == []


def test_field_reaches_over_the_whole_document():
    k, n = len(pii.KINDS) + 1, 20
    m = pii.Model(np.zeros((pii.N_FEATURES, k)), np.zeros((k, k)), np.full((k, k), -2.0) + 5.0 * np.eye(k))
    m.unary[23, 4] = 6  # a bracket is evidence, and only the first word has it
    g = pii.graph("(a123 " + "x a123 " * n)
    assert (len(g.chain), len(g.skip)) == (0, n)
    want = np.exp(g.x[0] @ m.unary)
    for _ in range(n):  # the skips make a chain, on which forward sums are exact
        want = np.exp(m.skip).T @ want
        want = want / want.sum()
    assert np.abs(pii.marginals(g, m)[-1] - want).max() < 0.01 and want[4] > 0.5


def test_field_finds_a_number_without_its_prefix():
    noise = [" ".join(f"day {(i * 7 + j) % 31} for {j * 3 + i % 9} euros" for j in range(60)) for i in range(300)]
    m = pii.fit(pii.counted([f"call +1555{1302000 + i * 37} or mail user{i}@mail.example.com from 10.0.{i % 250}.7 {x} again +1555{1302000 + i * 37}" for i, x in enumerate(noise)]))
    t = "call +15551302044 today. Later: 5551302044 ok, then 5551302044 again"
    assert pii.added(t, pii.patterns(t), m, 0.5) == [(3, 32, 42), (3, 52, 62)]


def test_long_words_differ_by_their_ends():
    assert len(pii.graph("1" + "a" * 300 + "b then 1" + "a" * 300 + "c").skip) == 0
    assert len(pii.graph("1" + "a" * 300 + "b then 1" + "a" * 300 + "b").skip) == 1


def test_the_model_is_fitted_on_all_documents(spark):
    lines = [f"mail user{i}@mail.example.com from 10.0.{i}.7 and 10.0.{i}.7 on day {i}" for i in range(60)] + ["10.0.0.7 " * 3000, None, ""]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    few, every = pii.model(d), pii.fit(pii.counted(x for x in lines if x))
    assert np.allclose(few.chain, every.chain) and np.allclose(few.skip, every.skip) and np.allclose(few.unary, every.unary)


def test_marginals_are_exact_where_links_make_a_tree():
    rng, k = np.random.default_rng(4), pii.K
    m = pii.Model(rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k)))
    g = pii.graph("a1 b2 c3 and later c3 d4")
    edges = [(e, m.chain) for e in g.chain] + [(e, m.skip) for e in g.skip]
    assert len(edges) == len(g.start) - 1 == 4
    want, unary = np.zeros((len(g.start), k)), g.x @ m.unary
    for z in np.ndindex(*[k] * len(g.start)):
        p = math.exp(sum(unary[i, a] for i, a in enumerate(z)) + sum(pot[z[i], z[j]] for (i, j), pot in edges))
        for i, a in enumerate(z):
            want[i, a] += p
    assert np.abs(pii.marginals(g, m) - want / want.sum(axis=1, keepdims=True)).max() < 0.01


# 8


def deduped(docs: list[tuple], k: int = 13) -> Counter:
    first: dict = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        if i is not None:
            for a in range(len(w) - k + 1):
                x = tuple(w[a : a + k])
                first[x] = min(first.get(x, i), i)
    out = Counter()
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        out[i, len(w), len(gone), hashlib.sha256(" ".join(x for a, x in enumerate(w) if a not in gone).encode()).hexdigest()] += 1
    return out


def test_substrings(spark, folder, docs):
    assert Counter(map(tuple, op8_substrings(spark, folder).collect())) == deduped([d[:2] for d in docs])


@pytest.mark.parametrize("hot", [5000, 2])
def test_substrings_of_common_passages(spark, hot):
    rng = np.random.default_rng(5)
    lines = [" ".join(f"l{j}w{rng.integers(9)}" for _ in range(int(rng.integers(3, 40)))) for j in range(25)]
    docs = [(int(i), " ".join(rng.choice(lines, int(rng.integers(1, 6))))) for i in rng.permutation(120)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    made = substrings.dedup(d, hot=hot).collect()
    assert Counter((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in made) == deduped(docs)
    words = {i: WORD.findall(t) for i, t in docs}
    for r in made:  # a span's words stand at its source
        for s in r["spans"]:
            n = s["end"] - s["start"]
            assert words[r["doc_id"]][s["start"] : s["end"]] == words[s["source"]][s["source_start"] : s["source_start"] + n]


def test_paths_are_compacted_up_to_branches(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    lines = [" ".join(f"l{j}w{rng.integers(4)}" for _ in range(int(rng.integers(3, 30)))) for j in range(12)]
    docs = [(int(i), " ".join(rng.choice(lines, int(rng.integers(1, 6))))) for i in rng.permutation(60)] + [(60, "z " * 40), (61, "y " + "z " * 30)]
    docs += [(62 + i, f"q{i} " + " ".join(f"p{j}" for j in range(80)) + f" r{i}") for i in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.xxhash64("doc_id", "text"))
    k, stands, of = 13, defaultdict(list), {}
    for i, t in docs:
        w = t.split()
        for a in range(len(w) - k + 1):
            stands[tuple(w[a : a + k])].append((i, a))
            of[i, a] = tuple(w[a : a + k])
    edges = {e for e, p in stands.items() if len({i for i, _ in p}) > 1}
    into, out = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    joined = {}
    for e in edges:
        f = {of.get((i, a + 1)) for i, a in stands[e]}
        if len(f) == 1 and (g := f.pop()) in edges and into[g[:-1]] == out[g[:-1]] == 1 and {(i, a - 1) for i, a in stands[g]} == set(stands[e]):
            joined[e] = g
    want = Counter()
    for e in edges - set(joined.values()):
        n, f = 1, e
        while f in joined:
            n, f = n + 1, joined[f]
        want[(*min(stands[e]), n)] += 1
    assert max(n for _, _, n in want) > 20
    held = spark.sparkContext.broadcast(substrings.build_filter(substrings.shared_anchors(d, k, 5, 7), 7, 48, 5000))
    got = substrings.compacted(substrings.paths(d, held, k, 5, 7)).select("source", "source_pos", "size").collect()
    assert Counter(map(tuple, got)) == want


def test_a_place_whose_words_differ_from_its_source_stays():
    text = [b"a", b"b", b"c"]
    assert substrings._hashed(text, 0, 2) == substrings._hashed([b"x", *text], 1, 3) != substrings._hashed([b"ab", b"c"], 0, 2)


def test_fingerprints_match_by_place(spark):
    from pyspark.sql import functions as F

    from wrenchfield.llm import fingerprints

    rows = [([1, 2, 3, 4], [1, 2, 3, 4], 1.0), ([1, 2, 3, 4], [4, 3, 2, 1], 0.0), ([1, 2, 3], [1, 2, 5], 0.5), ([], [], 1.0), ([7], [7], 1.0), ([7], [], 0.0), ([9, 1, 2, 3], [1, 2, 3], 0.4)]
    d = spark.createDataFrame(rows, "a array<int>, b array<int>, want double")
    for r in d.select("want", fingerprints.likeness(F.col("a"), F.col("b")).alias("got")).collect():
        assert math.isclose(r["got"], r["want"]), r
