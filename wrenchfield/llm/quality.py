"""Sparse rule ensemble for text quality.

Statistics of each whole text (word and line shapes, repetition, symbols) are read off its bytes. A random forest of
shallow trees over a bounded sample of labelled texts gives conjunctive rules: every path from a root to a node. A
logistic regression with an l1 penalty over the rules' 0/1 values keeps a few of them; those are compiled into one
Spark column expression, so scoring is a projection over the statistics.

Defined results: a null or empty text has all statistics 0 and is scored by the rules that hold then; a null doc_id is
kept, its rows never train; repeated rows score alike; repeated labels train as so many rows; without labels, or with
one class only, every score is the share of good labels (0.5 without any); further columns are kept, but for those with
a statistic's name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .toxicity import held_out

STATS = ("log_words", "word_length", "upper", "symbols", "digits", "pipes", "bangs", "distinct", "repeated", "lines", "repeated_lines", "line_words", "letters", "marked", "capital_words", "longest_word")
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~_=+<>{}[]\\/"])
_BANG, _PIPE, _DIGIT, _UPPER, _LOWER = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("!?", "|", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(text: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    n = len(column)
    w, lines = words.split(column, True), words.split(column, False, words.LINE_END)
    _, at = words.buffers(column)
    count, size = w.count, np.diff(at)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    per_word = lambda mask: np.bincount(w.text[mask], minlength=n)
    length = w.end - w.start
    triple, _, text = w.windows(3)
    ends = w.raw[w.end - 1] if len(w.end) else w.raw
    begins = w.raw[w.start] if len(w.start) else w.raw
    longest = np.zeros(n)
    np.maximum.at(longest, w.text, length)
    upper = total(_UPPER[w.raw])
    out = [
        np.log1p(count), _share(np.bincount(w.text, weights=length, minlength=n), count), _share(upper, size), _share(total(_SYMBOL[w.raw]), size), _share(total(_DIGIT[w.raw]), size),
        _share(total(_PIPE[w.raw]), count), _share(total(_BANG[w.raw]), count), _share(_distinct(w.text, w.hash, n), count),
        1 - _share(_distinct(text, triple, n), np.maximum(count - 2, 0)) * (count > 2) - (count <= 2), np.log1p(lines.count), 1 - _share(_distinct(lines.text, lines.hash, n), lines.count) - (lines.count == 0),
        np.log1p(_share(count, lines.count)), _share(upper + total(_LOWER[w.raw] | (np.arange(256) >= 128)[w.raw]), size), _share(per_word(_SYMBOL[ends]), count), _share(per_word(_UPPER[begins]), count), np.log1p(longest),
    ]
    return np.stack(out, axis=1).astype(np.float64)


def measured(docs: DataFrame) -> DataFrame:
    """docs without text, with its STATS."""
    shared.small_batches(docs.sparkSession)
    docs = docs.drop(*(f"stat_{c}" for c in STATS))
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in words.slices(batches):
            s = statistics(batch.column(batch.schema.get_field_index("text")))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(np.ascontiguousarray(s[:, i])) for i in range(len(STATS)))], names=[*keep, *(f"stat_{c}" for c in STATS)])

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"stat_{c} double" for c in STATS)])
    return docs.mapInArrow(run, ddl)


def rules(forest: str) -> list[tuple[tuple[int, str, float], ...]]:
    """Every path from a root to a node of the forest's description: conjunctions of (statistic, "<=" or ">", value)."""
    out: dict[tuple, None] = {}
    path: list[tuple[int, tuple[int, str, float]]] = []
    for line in forest.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if line.strip().startswith("Tree"):
                path = []
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
        out[tuple(sorted({p[1] for p in path}))] = None
    return list(out)


def holds(rule: tuple[tuple[int, str, float], ...]) -> Column:
    test = F.lit(True)
    for i, op, value in rule:
        c = F.col(f"stat_{STATS[i]}")
        test = test & (c <= value if op == "<=" else c > value)
    return test


def fit(rows: DataFrame, trees: int = 12, depth: int = 3, l1: float = 2e-3, kept: list | None = None) -> Column:
    """The score, as an expression over the statistics, from rows of statistics with a label (0.0 or 1.0). kept, if given,
    receives the intercept, and each rule that has a weight, with it."""
    share = rows.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if share[0] is None or share[1] == share[2]:
        return F.lit(0.5 if share[0] is None else float(share[0]))
    names = [f"stat_{c}" for c in STATS]
    x = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="0.5").fit(x)
    found = rules(forest.toDebugString)
    flags = rows.select("label", *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(found)))
    z = VectorAssembler(inputCols=[f"r{i}" for i in range(len(found))], outputCol="z").transform(flags).select("label", "z").cache()
    lasso = LogisticRegression(featuresCol="z", labelCol="label", elasticNetParam=1.0, regParam=l1, maxIter=60, standardization=False).fit(z)
    z.unpersist()
    margin = F.lit(float(lasso.intercept))
    kept = [] if kept is None else kept
    kept.append(float(lasso.intercept))
    for r, w in zip(found, lasso.coefficients.toArray(), strict=True):
        if w:
            kept.append((r, float(w)))
            margin = margin + F.when(holds(r), float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-margin))


def train(stats: DataFrame, labels: DataFrame, sample: int = 20_000) -> Column:
    """Fitted on about `sample` labelled rows, chosen by hashed ids (never over twice as many). labels: doc_id, label."""
    few = shared.sampled(labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()), sample, "doc_id")
    rows = shared.save(stats.join(F.broadcast(few.withColumn("label", F.col("label").cast("double"))), "doc_id").select("label", *(f"stat_{c}" for c in STATS)), "quality-sample")  # a bounded number of small rows
    few = rows.coalesce(4).cache()
    made = fit(few)
    few.unpersist()
    shared.drop(rows)
    return made


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = shared.save(measured(shared.documents(spark, sf_dir).select("doc_id", "text")), "quality-statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(4, 2)).select("doc_id", F.col("quality").alias("label"))
    scored = stats.withColumn("score", train(stats, labels))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
