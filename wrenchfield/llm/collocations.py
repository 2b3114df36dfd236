"""Phrase collocation mining with generalised suffix automata.

Tasks cut texts into pieces and words and build, for each shard of a megabyte, the suffix automaton of all its pieces,
as deep as phrases are long. A state stands for the substrings that end at the same places (endpos): those of `shortest`
to `longest` words, each occurring `count` times; its suffix link leads to the state of the longest suffix that occurs
elsewhere, too. States are found in bulk: the substrings of j words that end at the same places as their last j - 1 words
belong to the same state, all others open one below it. Transitions are not kept, as nothing is read through the automaton.

Shards list their states' substrings with counts, and Spark adds these up, word by word longer: a phrase of k words is
counted only where both of its phrases of k - 1 words are frequent (a phrase is never more frequent than its parts).
The frequent ones of a length are known to the tasks as a bitmap of hashes, `most_bits` at most: false hits, or more
frequent phrases than it can tell apart, cost shuffled rows, but never a phrase. Phrases are counted as 64-bit hashes (as the
words in a shard are told apart; of 10^10 phrases, one of the 10^5 around a result shares its hash with probability 10^-4).
Of the longest phrases only those are counted that can be among a language's first, or subsume one that is (see rivals()).

A frequent phrase is spelt by few rows, not by each task that has it: rows have levels (see levels()), the least level of the
rows with a phrase is found along with its count, and only rows of that level send its words (see spelt()).

A candidate inside a longer one is inside one that is longer by a single word and at least as frequent, so what subsumes
a phrase is found one step away: a candidate stands against its suffix link (itself without its first word) and against
itself without its last word.

Defined results: a null text is empty; a null lang is `und`; null doc_ids and repeated rows count like all others; texts
without words, and empty tables, give nothing; a lang without candidates has no rows; further columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, words

_PIECE_END = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_GAP = _PIECE_END | np.isin(np.arange(256), [0x20, 0x09])
SHARD_BYTES = 1 << 20  # of text
MOST_ROWS = 1 << 20  # that a task holds before it sends them


@dataclass
class Automaton:
    """Suffix automaton of runs of words, for substrings of bounded length; state 0 is the root (the empty substring)."""

    shortest: np.ndarray  # words of each state's shortest and longest substring
    longest: np.ndarray
    link: np.ndarray  # the state of the longest suffix that ends at more places
    count: np.ndarray  # places where its substrings end
    end: np.ndarray  # one of them

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct substring of so many words ends for example, and how often it occurs."""
        has = (self.shortest <= length) & (length <= self.longest)
        return self.end[has], self.count[has]


def automaton(code: np.ndarray, run: np.ndarray, depth: int) -> Automaton:
    """Of the words code (numbers from 0 on), where neighbours of one run follow each other, down to `depth` words."""
    n = len(code)
    new_run = np.ones(n, bool)
    new_run[1:] = run[1:] != run[:-1]
    room = np.arange(n) - np.maximum.accumulate(np.where(new_run, np.arange(n), 0)) + 1  # words of the run up to here
    at, group, span = np.arange(n), np.zeros(n, np.int64), int(code.max(initial=0)) + 1
    state, count = np.zeros(1, np.int64), np.array([n])  # of each group of equal substrings
    columns = [[np.full(1, x)] for x in (0, 0, 0, n, 0)]
    longest, states = columns[1], 1
    for j in range(1, depth + 1):
        at, group = at[room[at] >= j], group[room[at] >= j]
        if not len(at):
            break
        key, group = np.unique(group * span + code[at - j + 1], return_inverse=True)
        above, size, end = key // span, np.bincount(group), np.empty(len(key), np.int64)
        end[group] = at
        same = (size == count[above]) & (j > 1)  # it ends where its suffix ends
        own = np.where(same, state[above], states + np.cumsum(~same) - 1)
        for old, new in zip(columns, (np.full((~same).sum(), j), np.full((~same).sum(), j), state[above][~same], size[~same], end[~same]), strict=True):
            old.append(new)
        longest[:] = [np.concatenate(longest)]
        longest[0][own[same]] = j
        states += int((~same).sum())
        state, count = own, size
    return Automaton(*(np.concatenate(c) for c in columns))


@dataclass
class Shard:
    """The frequent words of some texts, in runs that pieces, other words and infrequent pairs end."""

    words: words.Words
    at: np.ndarray  # number of each among all words
    value: np.ndarray  # hash of language and word
    run: np.ndarray

    def windows(self, last: np.ndarray, length: int) -> np.ndarray:
        return words._ranges(self.value, last - length + 1, last + 1, words._WINDOWS) if length > 1 else self.value[last]

    def substrings(self, automaton: Automaton, length: int, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Those whose parts, one word shorter, are frequent."""
        last, count = automaton.substrings(length)
        if 2 <= length - 1 <= len(frequent):
            fine = shared.among(frequent[length - 2], self.windows(last, length - 1)) & shared.among(frequent[length - 2], self.windows(last - 1, length - 1))
            last, count = last[fine], count[fine]
        return last, count


def shard(text: pa.Array, salt: np.ndarray, frequent: list[np.ndarray]) -> Shard:
    w = words.split(text, True, _GAP)
    value = words.mix(w.hash ^ salt.view(np.uint64)[w.text])
    at = np.flatnonzero(shared.among(frequent[0], value)) if frequent else np.arange(len(value))
    piece = (np.cumsum(_PIECE_END[w.raw])[w.start] + w.text)[at] if len(at) else at
    value = value[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)
    if len(frequent) > 1 and len(at) > 1:
        fresh[1:] |= ~shared.among(frequent[1], words._ranges(value, np.arange(len(at) - 1), np.arange(1, len(at)) + 1, words._WINDOWS))
    return Shard(w, at, value, np.cumsum(fresh))


class _Sums:
    """Counts by key and the least level of each, of a bounded number of keys."""

    def __init__(self):
        self.key, self.n, self.level, self.more = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int16), []

    def add(self, key: np.ndarray, n: np.ndarray, level: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.more.append((key, n, np.zeros(len(key), np.int16) if level is None else level))
        if sum(len(x[0]) for x in self.more) > MOST_ROWS:
            self.merge()
            if len(self.key) > MOST_ROWS:
                yield from self.sent()

    def merge(self) -> None:
        key, n, level = (np.concatenate(x) for x in zip((self.key, self.n, self.level), *self.more, strict=True))
        order = np.argsort(key)
        key, n, level, self.more = key[order], n[order], level[order], []
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        self.key, self.n, self.level = key[first], (np.add.reduceat(n, first) if len(first) else n), (np.minimum.reduceat(level, first) if len(first) else level)

    def sent(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        yield pa.record_batch([pa.array(self.key.view(np.int64)), pa.array(self.n.astype(np.int64)), pa.array(self.level)], names=["key", "n", "level"])
        self.key, self.n, self.level = self.key[:0], self.n[:0], self.level[:0]


def levels(place: np.ndarray) -> np.ndarray:
    """Of rows' hashes: 0 to 255, each an eighth of an octave and so the rarer the lower (in whole numbers: alike on all machines).
    About one of the rows that hold a phrase has the least level among them, however many they are."""
    x = ((place.view(np.uint64) >> np.uint64(32)) + np.uint64(1)).astype(np.float64)
    return np.minimum((x.view(np.int64) >> 49) - (1023 << 3), 255).astype(np.int16)


@dataclass
class Rival:
    """Which phrases, one word shorter than the longest, may still matter (bitmaps of their hashes)."""

    best: np.ndarray  # may be among the first themselves
    left: np.ndarray  # may begin a phrase that is
    right: np.ndarray  # may end one

    def may_matter(self, s: Shard, last: np.ndarray, length: int) -> np.ndarray:
        begins, ends = s.windows(last - 1, length - 1), s.windows(last, length - 1)
        of = shared.among
        return of(self.best, begins) | of(self.best, ends) | (of(self.left, begins) & of(self.right, ends))


def hashes(docs: DataFrame, length: int, frequent: list[np.ndarray], least: int, rival: Rival | None = None) -> DataFrame:
    """key, level, n: hashes of the phrases of so many words that occur `least` times or more (of those that may matter, if rival
    is given), the least level of the rows that hold them, and their counts. docs: text, lang_hash, place."""
    held = docs.sparkSession.sparkContext.broadcast((frequent, rival))  # most_bits for each length at most

    def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (frequent, rival), level = held.value, levels(batch.column(2).to_numpy())
        order = np.argsort(-level, kind="stable")  # so that a phrase's last place is one of its least level
        batch, level = batch.take(pa.array(order)), level[order]
        s = shard(batch.column(0), batch.column(1).to_numpy(), frequent)
        if length == 1:
            key, back, n = np.unique(s.value[::-1], return_index=True, return_counts=True)
            return key, n, level[s.words.text[s.at[len(s.at) - 1 - back]]]
        last, n = s.substrings(automaton(np.unique(s.value, return_inverse=True)[1], s.run, length), length, frequent)
        if rival is not None:
            own = rival.may_matter(s, last, length)
            last, n = last[own], n[own]
        return s.windows(last, length), n, level[s.words.text[s.at[last]]]

    def run(batches):
        sums = _Sums()
        for batch in words.slices(batches, most=SHARD_BYTES):
            yield from sums.add(*counted(batch))
        yield from sums.sent()

    made = docs.select("text", "lang_hash", "place").mapInArrow(run, "key long, n long, level short")
    once = made.groupBy("key").agg(F.min("level").alias("level"), F.sum("n").alias("n"))  # in this order shuffles compress best
    return once.where(F.col("n") >= least)


_PROBES = 4


def probe(key: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first hash of phrases' keys with levels."""
    return words.mix(key.view(np.uint64) ^ ((level.astype(np.uint64) + np.uint64(1)) << np.uint64(52)))


def next_probe(x: np.ndarray) -> np.ndarray:
    return words.mix(x + np.uint64(0x9E3779B97F4A7C15))


def spelt(docs: DataFrame, lengths: range, frequent: list[np.ndarray], keys: DataFrame, most_bits: int) -> DataFrame:
    """lang, phrase, a of all keys (size, key, n, level): a phrase is spelt by the rows of its least level only, so it is sent about
    once, however many tasks have it. With words among them, the row with phrase null has a lang's number of all words. docs: text,
    lang_hash, lang, place."""

    def probed(batches):
        for batch in batches:
            x = probe(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            for _ in range(_PROBES):
                yield pa.record_batch([pa.array(x.view(np.int64))], names=["key"])
                x = next_probe(x)

    owner = shared.bitmap(keys.select("key", "level").mapInArrow(probed, "key long"), "key", most_bits, hashed=True)
    held = docs.sparkSession.sparkContext.broadcast((frequent, owner))
    names = ["size", "key", "lang", "phrase", "n"]

    def listed(batch: pa.RecordBatch, s: Shard, seen: set) -> pa.RecordBatch:
        level, owner = levels(batch.column(3).to_numpy()), held.value[1]
        lower, start, end, text, made = words._FOLD[s.words.raw].tobytes(), s.words.start, s.words.end, s.words.text, []
        for length in lengths:
            last = np.arange(length - 1, len(s.value))
            last = last[s.run[last] == s.run[last - length + 1]]
            key = s.windows(last, length)
            x = probe(key, level[text[s.at[last]]])
            for _ in range(_PROBES):
                fine = shared.among(owner, x)
                last, key, x = last[fine], key[fine], next_probe(x[fine])
            key, first = np.unique(key, return_index=True)
            for k, i in zip(key.view(np.int64).tolist(), last[first].tolist(), strict=True):
                if (length, k) not in seen:
                    seen.add((length, k))
                    at = s.at[i - length + 1 : i + 1]
                    made.append((length, k, int(text[at[0]]), b" ".join(lower[start[w] : end[w]] for w in at.tolist()).decode()))
        size, key, row, phrase = zip(*made, strict=True) if made else ((),) * 4
        return pa.record_batch([pa.array(size, pa.int32()), pa.array(key, pa.int64()), batch.column(2).take(pa.array(row, pa.int64())), pa.array(phrase, pa.string()), pa.nulls(len(size), pa.int64())], names=names)

    def totals(count: dict) -> pa.RecordBatch:
        n = len(count)
        return pa.record_batch([pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(list(count), pa.string()), pa.nulls(n, pa.string()), pa.array(list(count.values()), pa.int64())], names=names)

    def run(batches):
        seen, count = set(), {}
        for batch in words.slices(batches, most=SHARD_BYTES):
            s = shard(batch.column(0), batch.column(1).to_numpy(), held.value[0])
            if lengths[0] == 1:
                for lang, n in zip(batch.column(2).to_pylist(), s.words.count.tolist(), strict=True):
                    count[lang] = count.get(lang, 0) + n
            yield listed(batch, s, seen)
            if len(seen) > MOST_ROWS:
                seen = set()
            if len(count) > MOST_ROWS:
                yield totals(count)
                count = {}
        if lengths[0] == 1:
            yield totals(count)

    made = docs.select("text", "lang_hash", "lang", "place").mapInArrow(run, "size int, key long, lang string, phrase string, n long")
    once = made.groupBy("size", "key", "lang").agg(F.min("phrase").alias("phrase"), F.sum("n").alias("words"))
    known = once.join(keys.select("size", "key", F.col("n").alias("a")), ["size", "key"], "left")
    return known.where(F.col("a").isNotNull() | (F.col("size") == 0)).select("lang", "phrase", F.coalesce("a", "words").alias("a"))


def keyed(rows: DataFrame) -> DataFrame:
    """rows (lang_hash, phrase and more) with key, the hash by which tasks know a phrase, for phrase."""
    rest = [c for c in rows.columns if c not in ("lang_hash", "phrase")]

    def run(batches):
        for batch in batches:
            w = words.split(batch.column(1), False, _GAP)
            value = words.mix(w.hash ^ batch.column(0).to_numpy().view(np.uint64)[w.text])
            key = words._ranges(value, w.at[:-1], w.at[1:], words._WINDOWS)
            yield pa.record_batch([pa.array(key.view(np.int64)), *batch.columns[2:]], names=["key", *rest])

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.select("lang_hash", "phrase", *rest).mapInArrow(run, f"key long, {ddl}")


def joined(part: Column) -> Column:
    return F.array_join(part, " ")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), in decimals of 38 digits."""
    whole = F.lit(2_000_000).cast("decimal(8,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", whole, (l.cast("decimal(19,0)") + r.cast("decimal(19,0)")))


def unsubsumed(candidates: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a) without those that stand in a longer one with at least four fifths of their count."""
    w, n = F.split("phrase", " "), F.size(F.split("phrase", " "))
    longer = candidates.where(n > 2).select("lang", "a", F.explode(F.array(joined(F.slice(w, F.lit(2), n - 1)), joined(F.slice(w, F.lit(1), n - 1)))).alias("inner"))
    most = longer.groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("longer"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < 80 * F.col("a"), F.lit(True))).drop("longer")


def scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a and more) with l, r, score of their lowest-scoring cut; parts: lang, phrase, a of all shorter ones."""
    cut = candidates.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cut = cut.select(*candidates.columns, "k", joined(F.slice("w", F.lit(1), F.col("k"))).alias("head"), joined(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        cut = shared.looked_up(cut, parts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part], spread=["phrase"], salts=4)
    best = cut.groupBy(*candidates.columns).agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    return best.select(*candidates.columns, "cut.l", "cut.r", "cut.score")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """Each lang's first rows, with rank: the firsts of its 64 shares, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most).drop("salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def rivals(every: DataFrame, candidates: DataFrame, longest: int, most: int, most_bits: int) -> Rival:
    """What the counts of all phrases of less than `longest` words (every; scored candidates among them) say about the longest.
    Those of `longest` - 2 words at most that aren't subsumed are known for sure; the score of a lang's last of `most` such
    phrases is a bar that whatever is among the first must reach. A phrase a..z is cut after a, and before z; of its count it
    is only known that it isn't above that of a.. or ..z, so its score isn't above that of count(a..) against count(a), or
    count(..z) against count(z). Phrases one word shorter that reach the bar themselves have to be held against all longer
    ones, as these may subsume them."""
    size = F.size(F.split("phrase", " "))
    kept = unsubsumed(candidates).where(size <= longest - 2)
    bars = ranked(kept, most).where(F.col("rank") == most).select("lang", F.col("score").alias("bar"))
    near = shared.looked_up(candidates.where(size == longest - 1), shared.save(bars, "collocations-bars"), ["lang"], spread=["phrase"])
    single = every.where(size == 1)
    for end, word in (("first", F.substring_index("phrase", " ", 1)), ("last", F.substring_index("phrase", " ", -1))):
        near = shared.looked_up(near.withColumn(f"{end}_word", word), single.select("lang", F.col("phrase").alias(f"{end}_word"), F.col("a").alias(end)), ["lang", f"{end}_word"], spread=["phrase"], salts=4)
    reaches = lambda s: F.col("bar").isNull() | (s >= F.col("bar"))
    bound = lambda end: score(F.col("a"), F.col("a"), F.col(end))
    near = shared.save(keyed(near.select(F.xxhash64("lang").alias("lang_hash"), "phrase", reaches(F.col("score")).alias("best"), reaches(bound("first")).alias("left"), reaches(bound("last")).alias("right"))), "collocations-rivals")
    out = Rival(*(shared.bitmap(near.where(c).select("key"), "key", most_bits, hashed=True) for c in ("best", "left", "right")))
    shared.drop(near)
    return out


def mine(docs: DataFrame, longest: int = 4, least: int = 30, most: int = 2000, most_bits: int = 1 << 29) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of documents (text, lang, and doc_id if it is there)."""
    shared.small_batches(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    place = F.xxhash64(*(c for c in ("doc_id", "text", "lang") if c in docs.columns))  # copies have places of their own
    docs = docs.select("text", F.xxhash64(lang).alias("lang_hash"), lang.alias("lang"), place.alias("place"))
    frequent: list[np.ndarray] = []
    of_length = []
    for length in range(1, longest):
        of_length.append(shared.save(hashes(docs, length, frequent, least).withColumn("size", F.lit(length)), "collocations-hashes"))
        frequent.append(shared.bitmap(of_length[-1].select("key"), "key", most_bits, hashed=True))
    every = shared.save(spelt(docs, range(1, longest), frequent, functools.reduce(DataFrame.unionByName, of_length), most_bits), "collocations-phrases")
    for keys in of_length:
        shared.drop(keys)
    size = F.size(F.split("phrase", " "))
    shorter = shared.save(scored(every.where(size > 1), every.where(size < longest - 1)), "collocations-scores")
    rival = rivals(every, shorter, longest, most, most_bits) if longest > 3 else None
    keys = shared.save(hashes(docs, longest, frequent, least, rival).withColumn("size", F.lit(longest)), "collocations-hashes")
    last = shared.save(spelt(docs, range(longest, longest + 1), frequent, keys, most_bits), "collocations-longest")
    shared.drop(keys)
    rows = shorter.unionByName(scored(last, every.where("phrase is not null")))
    totals = every.where(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    return shared.looked_up(ranked(unsubsumed(rows), most), totals, ["lang"], spread=["phrase"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(shared.documents(spark, sf_dir).select("doc_id", "text", "lang"))


def _cuts() -> str:
    return " UNION ALL ".join(
        f"SELECT c.lang, c.phrase, c.a, {k} AS k, x.a AS l, y.a AS r FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:{k}], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[{k + 1}:], ' ') WHERE len(c.w) > {k}"
        for k in (1, 2, 3)
    )


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(pieces), '[\\x20\\x09]'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])))) AS w FROM p),
f AS MATERIALIZED (SELECT lang, w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, w HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT * FROM f WHERE len(w) > 1),
s AS (SELECT DISTINCT i.lang, i.phrase FROM c i JOIN c o ON i.lang = o.lang AND len(o.w) > len(i.w) AND contains(' ' || o.phrase || ' ', ' ' || i.phrase || ' ') AND 100 * o.a >= 80 * i.a),
u AS ({_cuts()}),
v AS (SELECT *, CAST(CAST(2000000 AS HUGEINT) * a // (l + r) AS BIGINT) AS score FROM u),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM v),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM m ANTI JOIN s USING (lang, phrase) WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
