"""Counterfactual-regularised toxicity classifier.

A text's features are its distinct words (runs of letters, lower-cased) and their beginnings, hashed. A logistic model
with an l1 penalty is fitted by accelerated proximal gradient on a bounded sample of labelled texts. Beside the loss it
minimises (score(x) - score(x'))**2 over counterfactual pairs: each labelled sentence that names a group is repeated
with every other term in that place, and all terms are held against each other on their own, so that the mention of a
group as such moves no score. Scoring broadcasts the weights (2**20 of them at most) and reads each text once.

Defined results: a null or empty text has the score of the intercept; a null doc_id is kept, its rows never train;
repeated rows score alike; repeated or contradicting labels of one document train as so many rows; without labels
(or with one class only, or where no feature stands in three labelled texts) every score is the share of toxic labels
(0.01 and 0.99 at the ends), 0.5 if there are none;
further columns are kept, but for one with the result's name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

BITS = 20
HEADS = (4, 5, 6)
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])
#: Neutral names of groups, by language.
TERMS = (
    "women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "foreigners", "gays", "lesbians", "blacks", "whites", "asians", "elderly", "disabled",
    "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "ausländer", "schwule", "lesben", "behinderte",
    "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "étrangers", "homosexuels", "handicapés",
    "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "extranjeros", "homosexuales", "discapacitados",
)


def _hashed(w: words.Words, bits: int) -> np.ndarray:
    """Features of each word: itself and its beginnings (the word itself again where it is shorter)."""
    every = [w.hash, *(words.mix(w.heads(n) + np.uint64(n)) for n in HEADS)]
    return np.stack([(h >> np.uint64(64 - bits)).astype(np.int32) for h in every], axis=1)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, end to end, and where each text's begin (n + 1 offsets)."""
    w = words.split(column, True, words.NOT_LETTERS)
    key = np.unique((w.text[:, None].astype(np.int64) << 32 | _hashed(w, bits)).ravel())
    return (key & (2**32 - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(column) + 1, dtype=np.int64) << 32)


Pairs = Counter  # (features that only the sentence has, those that only its counterpart has): how many such pairs


def alone(terms: tuple[str, ...] = TERMS, bits: int = BITS) -> Pairs:
    """The terms held against the first one, on their own."""
    own = [set(f.tolist()) for f in _hashed(words.split(pa.array(terms), True, words.NOT_LETTERS), bits)]
    return Pairs((tuple(sorted(own[0] - f)), tuple(sorted(f - own[0]))) for f in own[1:])


def swapped(column: pa.Array, terms: tuple[str, ...] = TERMS, bits: int = BITS) -> Pairs:
    """Each sentence that names a group, against the same with another term in that place, for every other term: only the
    features in which the two differ, so that a pair is small however long its sentence."""
    of_terms = words.split(pa.array(terms), True, words.NOT_LETTERS)
    own = [set(f.tolist()) for f in _hashed(of_terms, bits)]
    w = words.split(column, True, words.NOT_LETTERS)
    named = np.flatnonzero(np.isin(w.hash, of_terms.hash))
    out = Pairs()
    if not len(named):
        return out
    ends = np.cumsum(_STOP[w.raw])[w.start] + w.text  # the same for the words of one sentence only
    f = _hashed(w, bits)
    for sentence in np.unique(ends[named]).tolist():
        a, b = np.searchsorted(ends, [sentence, sentence + 1])
        holders = Counter(x for word in f[a:b].tolist() for x in set(word))  # words that have the feature
        for i in named[(named >= a) & (named < b)].tolist():
            mine = set(f[i].tolist())
            for h, theirs in zip(of_terms.hash, own, strict=True):
                if h != w.hash[i]:
                    out[tuple(sorted(x for x in mine - theirs if holders[x] == 1)), tuple(sorted(x for x in theirs if not holders[x]))] += 1
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def _dot(flat: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of w over each text's features."""
    total = w[flat].astype(np.float64)
    if not len(total):
        return np.zeros(len(at) - 1)
    np.cumsum(total, out=total)
    up_to = np.where(at > 0, total[np.maximum(at, 1) - 1], 0.0)
    return up_to[1:] - up_to[:-1]


def fit(flat: np.ndarray, at: np.ndarray, y: np.ndarray, pairs: Pairs, bits: int = BITS, l1: float = 1e-3, fair: float = 1.0, steps: int = 100, least: int = 3) -> Model:
    """Weights for texts with features flat[at[i]:at[i + 1]] and labels y. Features of fewer than `least` texts are left out."""
    often = np.bincount(flat, minlength=1 << bits) >= least
    if not len(y) or y.min() == y.max() or not often.any():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(1 << bits, np.float32), float(np.log(p / (1 - p))))
    keep = often[flat]
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(at))[keep]
    blocks = range(0, len(y), 1024)  # of texts: what a step needs beside the features is small
    used = np.flatnonzero(often)
    where = np.full(1 << bits, -1, np.int32)
    where[used] = np.arange(len(used))
    column = where[flat[keep]]
    to = np.searchsorted(row, np.arange(len(y) + 1, dtype=np.int32))
    each = [(i, where[x], sign) for i, sides in enumerate(pairs) for sign, side in zip((1.0, -1.0), sides, strict=True) for x in side if where[x] >= 0]
    pair, other = (np.array([e[j] for e in each], np.int64) for j in range(2))
    sign = np.array([e[2] for e in each])
    share = np.array(list(pairs.values()), np.float64) / max(1, pairs.total())
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))  # both classes count alike
    n_pair = len(pairs)
    w, bias, z, z_bias, t = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0, 1.0
    scale = sum(np.bincount(column[to[a] : to[min(a + 1024, len(y))]], weights=(weight * np.diff(to))[row[to[a] : to[min(a + 1024, len(y))]]], minlength=len(used)) for a in blocks)  # bounds the loss's curvature, by feature
    apart = np.bincount(other, weights=(np.bincount(pair, minlength=n_pair) * 2 * fair * share)[pair], minlength=len(used))  # the same of the pairs
    step = np.minimum(50 / (0.25 * scale.max() + 2 * fair), 1 / (0.25 * scale + apart + 1e-3))
    for _ in range(steps):
        r, g = np.empty(len(y)), np.zeros(len(used))
        for a in blocks:
            b = min(a + 1024, len(y))
            own = slice(to[a], to[b])
            r[a:b] = weight[a:b] * (1 / (1 + np.exp(-(_dot(column[own], to[a : b + 1] - to[a], z) + z_bias))) - y[a:b])
            g += np.bincount(column[own], weights=r[row[own]], minlength=len(used))
        if len(pair):
            d = np.bincount(pair, weights=sign * z[other], minlength=n_pair) * 2 * fair * share
            g += np.bincount(other, weights=sign * d[pair], minlength=len(used))
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = z_bias - r.sum() * 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((z - new) * (new - w) / step).sum() > 0:  # restart when the momentum points uphill
            t2 = t = 1.0
        z, z_bias = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    out = np.zeros(1 << bits, np.float32)
    out[used] = w
    return Model(out, float(bias))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, most: int = 20_000_000, terms: tuple[str, ...] = TERMS) -> Model:
    """Fitted on about `sample` labelled rows, chosen by hashed ids (never over twice as many), fewer if these have more than
    about `most` features together; of the texts of one doc_id the one with the least hash. labels: doc_id, label. Sentences
    that name a group are taken apart in the tasks, and pairs alike are counted there: the driver sees how often which few
    features differ."""
    few = shared.sampled(labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()), sample, "doc_id").withColumn("label", F.col("label").cast("double"))
    ids = few.select("doc_id").distinct()
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # a bounded number of small rows

    def run(batches):
        for batch in words.slices(batches):
            flat, at = features(batch.column(1))
            yield pa.record_batch([batch.column(0), words.lists(flat, np.diff(at), pa.int32()), pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "feature", "n"])

    def apart(batches):
        found = Pairs()
        for batch in words.slices(batches):
            found += swapped(batch.column(0), terms)
        kind = pa.list_(pa.int32())
        yield pa.record_batch([pa.array([k[0] for k in found], kind), pa.array([k[1] for k in found], kind), pa.array(list(found.values()), pa.int64())], names=["mine", "theirs", "n"])

    texts = shared.save(one, "toxicity-sample")
    rows = shared.save(texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, feature array<int>, n long"), "toxicity-features")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    got = rows.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "label").select("label", "feature").toArrow()
    pairs = alone(terms)
    for r in texts.select("text").mapInArrow(apart, "mine array<int>, theirs array<int>, n long").groupBy("mine", "theirs").agg(F.sum("n").alias("n")).collect():
        pairs[tuple(r["mine"]), tuple(r["theirs"])] += r["n"]
    shared.drop(texts)
    shared.drop(rows)
    feature = got["feature"].combine_chunks()
    feature = pa.concat_arrays(feature.chunks) if isinstance(feature, pa.ChunkedArray) else feature
    at = np.concatenate([[0], np.cumsum(np.diff(feature.offsets.to_numpy()))]) if len(feature) else np.zeros(1, np.int64)
    flat = feature.flatten().to_numpy() if len(feature) else np.zeros(0, np.int32)
    return fit(flat, at, got["label"].to_numpy(), Pairs(dict(sorted(pairs.items()))))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with score (or another name), the probability of label 1."""
    shared.small_batches(docs.sparkSession)
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 weights at most

    def run(batches):
        w, bias = held.value.weight, held.value.bias
        bits = int(len(w)).bit_length() - 1
        for batch in words.slices(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            own = words.split(column, True, words.NOT_LETTERS)
            f = _hashed(own, bits)
            i, j = np.nonzero(w[f])
            key = np.unique(own.text[i].astype(np.int64) << 32 | f[i, j])  # each feature once a text
            z = bias + np.bincount(key >> 32, weights=w[key & (2**32 - 1)], minlength=batch.num_rows)
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, `{name}` double")


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0)).select("doc_id", F.col("toxic").alias("label"))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
