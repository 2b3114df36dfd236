"""Language identification by string kernels.

A text's spectrum is the set of n-grams of its bytes for several n at once (blended), letters lower-cased and everything
else a blank, hashed to 2**bits features: presence counts, not frequency. The kernel of two texts is the number of features
that both have, over the geometric mean of their sizes. Landmarks, a few texts of each language, stand for the whole space
(Nystroem): one-versus-rest ridge regression in the kernel's space is solved over the landmarks' kernels, each language
weighing alike. Scoring makes a batch's presence matrix and multiplies it by the landmarks' and by the coefficients; what
is broadcast is bounded by the number of landmarks and languages, whatever the input.

Fitting uses a bounded sample of labelled texts, chosen by hashed ids, alike for each language; their spectra are made in
the tasks and are 2**bits / 8 bytes each.

Defined results: a text that is null or has no letter (Unicode) is `und` with score 0; a null doc_id is kept, its rows
never train; repeated rows are predicted alike, and of the rows of one doc_id the one with the least text trains; ties go
to the least language; with one language learned every text with a letter has it, with score 1; with none every text is
`und` with score 0; an empty table gives no rows; further columns are kept, but for those with a result's name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .toxicity import held_out

BITS = 15
LENGTHS = (2, 3, 4)
BLOCK = 128  # texts of one matrix product
_CLASS = np.where(words.NOT_LETTERS, ord(" "), words._FOLD).astype(np.uint32)


def spectra(column: pa.Array, bits: int = BITS) -> np.ndarray:
    """0/1 rows of the features that each text has."""
    raw, at = words.buffers(column)
    n, letter = len(at) - 1, _CLASS[raw]
    out = np.zeros(n << bits, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int64) << bits, np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(raw))  # bytes up to the text's end
    gram = np.zeros(len(raw), np.uint32)
    for length in range(1, max(LENGTHS) + 1):
        gram = gram[: max(0, len(raw) - length + 1)] | letter[length - 1 :] << np.uint32(8 * (length - 1))
        if length in LENGTHS and len(gram):
            feature = (gram * np.uint32(0x9E3779B1) + np.uint32(length * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits)
            inside = left[: len(gram)] >= length
            out[row[: len(gram)][inside] + feature[inside]] = 1
    return out.reshape(n, 1 << bits)


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared features over the geometric mean of both sizes; x and landmarks are 0/1 rows."""
    x, landmarks = x.astype(np.float32), landmarks.astype(np.float32)
    size = np.sqrt(np.maximum(x.sum(axis=1), 1)[:, None] * np.maximum(landmarks.sum(axis=1), 1)[None])
    return (x @ landmarks.T) / size


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # packed bits, a row for each
    weight: np.ndarray  # landmarks x languages

    def scores(self, x: np.ndarray, landmarks: np.ndarray | None = None) -> np.ndarray:
        """Of 0/1 rows; the shared features are whole numbers and the rest is rounded, so that equal rows score alike in any batch."""
        k = kernel(x, np.unpackbits(self.landmarks, axis=1) if landmarks is None else landmarks)
        return np.round(k.astype(np.float64) @ self.weight, 9)


def fit(packed: np.ndarray, langs: list[str], per_lang: int = 48, ridge: float = 1e-3) -> Model:
    """From packed spectra and their languages; the first per_lang texts of each language are landmarks."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, packed[:0], np.zeros((0, len(names))))
    of = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.flatnonzero(of == i)[:per_lang] for i in range(len(names))])
    marks = np.unpackbits(packed[chosen], axis=1)
    own = kernel(marks, marks).astype(np.float64)
    y = (of[:, None] == np.arange(len(names))).astype(np.float64)
    each = 1 / np.bincount(of)[of] / len(names)  # every language weighs alike
    left, right = ridge * own, np.zeros((len(chosen), len(names)))
    for a in range(0, len(of), BLOCK):
        k = kernel(np.unpackbits(packed[a : a + BLOCK], axis=1), marks).astype(np.float64)
        left += k.T @ (k * each[a : a + BLOCK, None])
        right += k.T @ (y[a : a + BLOCK] * each[a : a + BLOCK, None])
    weight = np.linalg.solve(left + 1e-9 * np.trace(left) / len(left) * np.eye(len(left)), right)
    return Model(names, packed[chosen], weight)


def has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, sample: int = 4_000, most_langs: int = 200) -> Model:
    """docs: doc_id, text, lang. About sample / (number of languages) texts of each language, and the `most_langs` most
    frequent languages, if there are more."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & has_letter())
    found = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not found:
        return fit(np.zeros((0, 1 << BITS >> 3), np.uint8), [])
    each = max(2, sample // len(found))
    rate = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * each / r["n"])) for r in found], "lang string, rate double"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30))
    few = rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), hashed.alias("h")).join(rate, "lang").where(F.col("h") < F.col("rate") * (1 << 30))

    def run(batches):
        for batch in words.slices(batches, most=words.SLICE_BYTES // 2):
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                packed = np.packbits(spectra(part.column(1)), axis=1)
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array([r.tobytes() for r in packed], pa.binary())], names=["doc_id", "lang", "h", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = few.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "h")).alias("d")).select("doc_id", "d.*").mapInArrow(run, f"doc_id {kind}, lang string, h long, packed binary")
    some = shared.save(made, "language-sample")
    got = some.orderBy("h", "doc_id").limit(2 * sample + 2 * most_langs).select("lang", "packed").toArrow()
    shared.drop(some)
    packed = np.frombuffer(b"".join(got["packed"].to_pylist()), np.uint8).reshape(len(got), -1) if len(got) else np.zeros((0, 1 << BITS >> 3), np.uint8)
    return fit(packed, got["lang"].to_pylist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    keep, flag = docs.columns, shared.fresh("has_letter", docs.columns)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        names = np.array([*m.langs, "und"], object)
        landmarks = np.unpackbits(m.landmarks, axis=1).astype(np.float32)
        for batch in words.slices(batches, most=words.SLICE_BYTES // 2):
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                letters = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                if len(m.langs) < 2:
                    best, score = np.zeros(len(letters), np.int64), np.full(len(letters), float(len(m.langs)))
                else:
                    s = m.scores(spectra(part.column(part.schema.get_field_index("text"))), landmarks)
                    best = s.argmax(axis=1)
                    score = np.clip(s[np.arange(len(s)), best], 0, 1).astype(np.float64)
                best, score = np.where(letters & (len(m.langs) > 0), best, len(m.langs)), np.where(letters, score, 0.0)
                yield pa.record_batch([*part.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(flag, has_letter()).mapInArrow(run, f"{ddl}, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(3, 1)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
