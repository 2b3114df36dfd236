"""Language-model scores from a log-frequency Bloom filter.

Every n-gram's count is quantised on a logarithmic scale, floor(log_b c) + 1 levels, and the pair (n-gram, level) is
put into the filter for each level up to its own; a count is read back by probing level after level until one misses.
The same filter holds how many different words follow each context. Scores are Witten-Bell interpolated bigrams over
an add-one unigram, so that p(w | h) = (c(h w) + s(h) p(w)) / (c(h) + s(h)): counts are rounded down, s is the same
above and below the line, and thus the probabilities of a context sum to at most 1 (false hits of the filter aside).

Counting: each task reduces its texts to sorted arrays of distinct keys and counts, cut into hash buckets; the buckets'
number follows the input, so a bucket's size doesn't. A bigram's key is (32-bit hash of its context, 32-bit hash of
the word in it); a bucket is a cell of a grid over both, so that a frequent context is spread over a row of buckets.
Each bucket becomes a filter of its own, as long as what it holds needs.
Scoring: exact word counts and the filters are dealt into rounds of at most `round_mb` (by default what an executor's
memory allows; a round's places for its buckets count, too), the only thing broadcast. Each
round goes over the texts and fills in its part of every token's numbers, which are kept beside the text until the
last; small data need one round, and the number of rounds grows with the vocabulary.

Defined results: a null or empty text is one end token; a null doc_id is trained on and has held_out false; repeated
rows count as often as they stand; an empty table gives no rows; further columns are kept, but for those with a result's name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

_MASK = np.uint64(0xFFFFFFFF)
BEGIN = np.uint64(0x5E2D58D8B3BCDEF1)  # the context before a text's first word
END = np.uint64(0x7A1E3C5B9D024F68)  # the token after a text's last word
PROBES = 4
MAX_LEVEL = 60


def _tokens(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words and its end: hashes, the hashes of the tokens before them, and the tokens of each text."""
    n = w.count + 1
    end = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), dtype=np.uint64)
    inner = np.ones(len(token), dtype=bool)
    inner[end] = False
    token[inner], token[end] = w.hash, END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[end - n + 1] = BEGIN
    return token, before, n


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    head = words.mix(before) & ~_MASK
    return head | (words.mix(token ^ words.mix(before + np.uint64(1))) >> np.uint64(32))


def _levels(count: np.ndarray, base: float) -> np.ndarray:
    at = thresholds(base)
    return np.searchsorted(at, count, side="right")


def thresholds(base: float) -> np.ndarray:
    """The least count of each level: 1, then at least one more and at least `base` times as many."""
    at = [1]
    while len(at) < MAX_LEVEL:
        at.append(max(at[-1] + 1, math.ceil(at[-1] * base)))
    return np.array(at, dtype=np.int64)


def _pack(x: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _unpack(x: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(x, np.dtype(kind).itemsize * n, asbytes=True), dtype=kind)


def _add(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, count = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("bits", pa.int64()), ("key", pa.binary()), ("count", pa.binary())])
PACKED_DDL = "kind int, bucket long, n long, total long, bits long, key binary, count binary"
WORD, GRAM, FOLLOW, FOLLOW_PART = 1, 2, 3, 4


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED)], schema=PACKED)


def _rows(kind: int, bucket: np.ndarray, key: np.ndarray, count: np.ndarray) -> list[tuple]:
    """Sorted keys as one row for each bucket: differences of keys, and counts."""
    order = np.argsort(bucket, kind="stable")
    bucket, key, count = bucket[order], key[order], count[order].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return [(kind, int(bucket[a]), int(b - a), int(count[a:b].sum()), 0, _pack(np.diff(key[a:b], prepend=np.uint64(0))), _pack(count[a:b])) for a, b in zip(cut, [*cut[1:], len(bucket)], strict=False)]


def _read(n: int, key: bytes, count: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(key, n, np.uint64), dtype=np.uint64), _unpack(count, n, np.int64)


def grid(key: np.ndarray, side: int) -> np.ndarray:
    """The bucket of a bigram's key: a cell of side x side."""
    s = np.uint64(side)
    return ((((key >> np.uint64(32)) * s) >> np.uint64(32)) * s + (((key & _MASK) * s) >> np.uint64(32))).astype(np.int64)


def line(key: np.ndarray, side: int) -> np.ndarray:
    """The bucket of a word or context: one of side * side ranges of its hash."""
    return (((key >> np.uint64(32)) * np.uint64(side * side)) >> np.uint64(32)).astype(np.int64)


def count_grams(texts: DataFrame, side: int, flush: int = 1_500_000) -> DataFrame:
    """Packed counts of tokens and bigrams of the column text, a row for each task's part of a bucket."""

    def run(batches):
        held = {WORD: ([], []), GRAM: ([], [])}

        def out():
            rows = []
            for kind, (keys, counts) in held.items():
                key, count = _add(keys, counts)
                rows += _rows(kind, line(key, side) if kind == WORD else grid(key, side), key, count)
                keys.clear(), counts.clear()
            yield from _table(rows).to_batches()

        n = 0
        for batch in words.slices(batches):
            token, before, _ = _tokens(words.split(batch.column(0), True))
            for kind, every in ((WORD, token), (GRAM, _pair(before, token))):
                key, count = np.unique(every, return_counts=True)
                held[kind][0].append(key), held[kind][1].append(count)
                n += len(key)
            if n > flush:
                yield from out()
                n = 0
        yield from out()

    return texts.select("text").mapInArrow(run, PACKED_DDL)


def _filter(key: np.ndarray, level: np.ndarray, bits_each: float) -> tuple[int, bytes]:
    bits = max(64, int(level.sum() * bits_each) // 8 * 8)
    own = np.zeros(bits // 8, dtype=np.uint8)
    for i in range(1, int(level.max(initial=0)) + 1):
        h, step = _start(key[level >= i], i)
        for _ in range(PROBES):
            at = _at(h, np.uint64(bits))
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            h = h + step
    return bits, own.tobytes()


def _start(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = words.mix(key + np.uint64(level * 0x632BE59BD9B4E019 & 2**64 - 1))
    return h, words.mix(h) | np.uint64(1)


def _at(h: np.ndarray, bits) -> np.ndarray:
    return (((h >> np.uint64(32)) * bits) >> np.uint64(32)).astype(np.int64)


def merge(packed: DataFrame, side: int, base: float, bits_each: float) -> DataFrame:
    """Whole buckets: words with counts (kind WORD), and filters of bigrams' and contexts' levels (GRAM, FOLLOW)."""

    def whole(table: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
        got = [_read(n, k, c) for n, k, c in zip(table["n"].to_pylist(), table["key"].to_pylist(), table["count"].to_pylist(), strict=True)]
        return table["kind"][0].as_py(), table["bucket"][0].as_py(), *_add([k for k, _ in got], [c for _, c in got])

    def first(table: pa.Table) -> pa.Table:
        kind, bucket, key, count = whole(table)
        if kind == WORD:
            return _table(_rows(kind, np.full(len(key), bucket), key, count))
        context, n = np.unique(key & ~_MASK, return_counts=True)
        bits, own = _filter(key, _levels(count, base), bits_each)
        return _table([(GRAM, bucket, len(key), int(count.sum()), bits, own, None), *_rows(FOLLOW_PART, line(context, side), context, n)])

    def second(table: pa.Table) -> pa.Table:
        _, bucket, key, count = whole(table)
        bits, own = _filter(key, _levels(count, base), bits_each)
        return _table([(FOLLOW, bucket, len(key), int(count.sum()), bits, own, None)])

    one = shared.save(packed.groupBy("kind", "bucket").applyInArrow(first, PACKED_DDL), "lm-buckets")
    two = one.where(F.col("kind") == FOLLOW_PART).groupBy("kind", "bucket").applyInArrow(second, PACKED_DDL)
    out = shared.save(one.where(F.col("kind") != FOLLOW_PART).unionByName(two), "lm-model")
    shared.drop(one)
    return out


class _Part:
    """What one round holds: its buckets' words, and their filters end to end, with places for its own buckets only."""

    def __init__(self, rows: list, side: int, first: int = 0, last: int | None = None):
        self.side, self.first = side, first
        self.n = (side * side - 1 if last is None else last) - first + 1
        got = [_read(r["n"], r["key"], r["count"]) for r in sorted(rows, key=lambda r: r["bucket"]) if r["kind"] == WORD]
        self.word = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in got)])  # buckets are ranges of the hash: sorted end to end
        self.count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in got)])
        if len(self.count) and self.count.max() < 2**32:
            self.count = self.count.astype(np.uint32)
        self.bits = {k: np.zeros(self.n, dtype=np.uint64) for k in (GRAM, FOLLOW)}
        self.base = {k: np.zeros(self.n, dtype=np.int64) for k in (GRAM, FOLLOW)}
        at, all_ = 0, []
        for r in rows:
            if r["kind"] != WORD:
                self.bits[r["kind"]][r["bucket"] - first], self.base[r["kind"]][r["bucket"] - first] = r["bits"], at * 8
                all_.append(np.frombuffer(r["key"], dtype=np.uint8))
                at += len(all_[-1])
        self.filter = np.concatenate([np.zeros(0, np.uint8), *all_])

    def counts(self, key: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.word, key), len(self.word) - 1)
        return np.where(self.word[at] == key, self.count[at], 0).astype(np.int64)

    def levels(self, kind: int, key: np.ndarray) -> np.ndarray:
        """Each key's level: probe level after level until one misses. 0 where another round has the bucket."""
        bucket = (grid(key, self.side) if kind == GRAM else line(key, self.side)) - self.first
        own = (bucket >= 0) & (bucket < self.n)
        bucket = np.where(own, bucket, 0)
        bits, base = np.where(own, self.bits[kind][bucket], np.uint64(0)), self.base[kind][bucket]
        found, left = np.zeros(len(key), dtype=np.uint8), np.flatnonzero(bits)
        for i in range(1, MAX_LEVEL + 1):
            h, step = _start(key[left], i)
            for _ in range(PROBES):
                at = base[left] + _at(h, bits[left])
                hit = ((self.filter[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                left, h, step = left[hit], h[hit] + step[hit], step[hit]
            if not len(left):
                break
            found[left] = i
        return found


_BUCKET_BYTES = 32  # a bucket's places in a round, beside what it holds


def _rounds(model: DataFrame, round_mb: int, buckets: int) -> list[tuple[int, int]]:
    """Cut the buckets into runs of at most round_mb (or one bucket): (first, last bucket) of each. Sizes come in by ranges
    of buckets, about 16 for each round, so that the driver sees few numbers whatever the buckets' count."""
    size = F.when(F.col("kind") == WORD, F.col("n") * 12).otherwise(F.length("key"))
    most = max(round_mb << 20, 1)
    total = (model.agg(F.sum(size)).first()[0] or 0) + buckets * _BUCKET_BYTES
    step = max(1, int(buckets * most / total / 16))
    out, at = [], 0
    for r in model.groupBy(F.floor(F.col("bucket") / step).alias("range")).agg(F.sum(size).alias("b")).orderBy("range").collect():
        own = r["b"] + step * _BUCKET_BYTES
        if not out or at + own > most:
            out.append([r["range"] * step, 0])
            at = 0
        out[-1][1] = min(buckets, (r["range"] + 1) * step) - 1
        at += own
    return [tuple(x) for x in out]


def _round_mb(spark: SparkSession) -> int:
    """What a round may hold: 128 MB, or a sixteenth of an executor's memory for each of its cores where that is more."""
    conf = spark.sparkContext.getConf()
    m = re.fullmatch(r"(\d+)([kmgt])b?", conf.get("spark.executor.memory", "1g").lower())
    mb = int(m[1]) * {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1 << 20}[m[2]] if m else 1024
    return max(128, int(mb / 16 / int(conf.get("spark.executor.cores", "1"))))


def score(docs: DataFrame, train: DataFrame, base: float = 1.5, bits_each: float = 8.0, round_mb: int | None = None, bucket_mb: int = 6) -> DataFrame:
    """docs (doc_id, text, and whatever else) with n_tokens, n_known, train_tokens, base_score and score, by the model of train's texts."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    held = shared.fresh("state", docs.columns)
    side = max(2, math.ceil(math.sqrt(shared.text_bytes(train) / (bucket_mb << 20))))
    model = merge(count_grams(train, side), side, base, bits_each)
    n, v = (x or 0 for x in model.where(F.col("kind") == WORD).agg(F.sum("total"), F.sum("n")).first())
    rounds = _rounds(model, _round_mb(spark) if round_mb is None else round_mb, side * side) or [(0, 0)]
    least = np.concatenate([[0], thresholds(base)]).astype(np.float64)
    keep = [c for c in docs.columns if c != "text"]
    state, old = docs, None
    for i, (a, b) in enumerate(rounds):
        part = spark.sparkContext.broadcast(_Part([r.asDict() for r in model.where(F.col("bucket").between(a, b)).toLocalIterator()], side, a, b))  # at most round_mb
        last = i == len(rounds) - 1
        ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches, part=part, first=not i, last=last):
            own = part.value
            for batch in words.slices(batches):
                column = batch.column(batch.schema.get_field_index("text"))
                token, before, size = _tokens(words.split(column, True))
                total = len(token)
                if first:
                    c, gram, follow = np.zeros(total, np.int64), np.zeros(total, np.uint8), np.zeros(total, np.uint8)
                else:
                    raw = [_unpack(x, 6 * m, np.uint8) for x, m in zip(batch.column(batch.schema.get_field_index(held)).to_pylist(), size, strict=True)]
                    c = np.concatenate([x[: 4 * m].view(np.uint32) for x, m in zip(raw, size, strict=True)]).astype(np.int64)
                    gram = np.concatenate([x[4 * m : 5 * m] for x, m in zip(raw, size, strict=True)])
                    follow = np.concatenate([x[5 * m :] for x, m in zip(raw, size, strict=True)])
                key, at = np.unique(token, return_inverse=True)
                c = c + own.counts(key)[at]
                # a context's followers are wanted where it stands before a token
                key, at = np.unique(before, return_inverse=True)
                follow = np.maximum(follow, own.levels(FOLLOW, words.mix(key) & ~_MASK)[at])
                key, at = np.unique(_pair(before, token), return_inverse=True)
                gram = np.maximum(gram, own.levels(GRAM, key)[at])
                cols = [batch.column(batch.schema.get_field_index(x)) for x in keep]
                to = np.cumsum(size)
                if last:
                    yield pa.record_batch([*cols, *_finish(c, gram, follow, size, least, n, v, docs_trained)], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                else:
                    packed = [_pack(np.concatenate([c[t - m : t].astype(np.uint32).view(np.uint8), gram[t - m : t], follow[t - m : t]])) for t, m in zip(to, size, strict=True)]
                    yield pa.record_batch([*cols, column, pa.array(packed, pa.binary())], names=[*keep, "text", held])

        docs_trained = _trained(model, side) if not i else docs_trained
        made = state.mapInArrow(run, f"{ddl}, n_tokens long, n_known long, train_tokens long, base_score double, score double" if last else f"{ddl}, text string, `{held}` binary")
        if not last:
            state = shared.save(made, "lm-round")
            part.unpersist()
            if old is not None:
                shared.drop(old)
            old = state
    return made


def _trained(model: DataFrame, side: int) -> int:
    """How many texts the model has seen: the count of the end token."""
    row = model.where((F.col("kind") == WORD) & (F.col("bucket") == int(line(np.array([END]), side)[0]))).select("n", "key", "count").first()
    if row is None:
        return 0
    key, count = _read(row["n"], row["key"], row["count"])
    return int(count[key == END].sum())


def _finish(c, gram, follow, size, least, n, v, texts):
    """Sums over each text of log10 of the tokens' probabilities."""
    to = np.cumsum(size)
    first = to - size
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[first] = texts
    one = (c + 1.0) / (n + v + 1.0)
    s = least[follow]
    seen = np.minimum(least[gram], np.minimum(c, before))
    p = np.where((before > 0) & (s > 0), (seen + s * one) / np.maximum(before + s, 1.0), one)
    add = lambda x: np.add.reduceat(x, first) if len(first) else x
    return [pa.array(size.astype(np.int64)), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(size), n, np.int64)), pa.array(add(np.log10(one))), pa.array(add(np.log10(p)))]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs.withColumn("held_out", out), docs.where(~out)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
