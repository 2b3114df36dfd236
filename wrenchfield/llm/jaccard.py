"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct shingles. Two sets with a Jaccard index of t or more share at least l of the first
n - ceil(t * n) + l shingles of each, in any common order, for every l. The order: a share of all hashes first (the
only ones whose frequencies are counted), by document frequency, rarest first, then by hash; the rest by hash. Each
document takes the l whose prefix costs least: the postings that it reads, and the candidates to verify, of which there
can be no more than a share 1 / l of those. A pair is a candidate if it shares as many prefix shingles as the smaller
of the two l, and is verified on the whole sets. Of the prefixes only so much counts as the two sizes leave: the first l
shared shingles of a linked pair stand at places up to n - overlap + l - 1 of either set, with the overlap that the two
sizes ask for; the r-th of a set's shared ones can't be more than the r-th of a pair's. Postings that no partner of their
shingle can reach by its size go first. Each set also has a parity sketch, a bit for each of SKETCH hash values, flipped
by every shingle that has it: two sketches differ in no more bits than the sets in shingles, which rules out most pairs
that don't link before they leave the join, and none that does.

Equal sets are one node. Groups of near copies are not joined pair by pair: first each shingle's documents are held
against a few pivots only (the one with the fewest rarer shingles, and PIVOTS by hash, others for each shingle), which
verified links put most of a group into one component; then every pair of different components is joined, so that no link
between them is lost.

Defined results: a null or empty text has an empty set and links with nothing; texts shorter than k words are one
shingle; rows without a doc_id link with nothing and have no component; rows of one doc_id with one text are one document;
different texts under one doc_id are different documents, which link each on its own (not with each other by their id), and
their id labels each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words
from .components import components

MOST_MATCHES = 3
BLOCK = 512  # members of an open shingle that one block holds
SKETCH = 512
PIVOTS = 4
_SKETCH = [f"g{i}" for i in range(SKETCH // 64)]


def shingles(w: words.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, end to end, and their numbers."""
    key, _, text = w.windows(k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    key, text = np.concatenate([key, w.spans(w.at[short], w.at[short + 1])]), np.concatenate([text, short])
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[new], np.bincount(text[new], minlength=len(w.count))


def _least(n, num: int, den: int):
    """The least overlap with any partner: ceil(n * num / den)."""
    return (n * num + den - 1) // den


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, s1 and s2 (the set's identity), low (its shingles of the counted share), n_low, more (those that a prefix may want besides), its sketch."""
    share = int(min(1.0, 1.6 * (1 - num / den)) * 2**32)

    def run(batches):
        for batch in words.slices(batches):
            key, n = shingles(words.split(batch.column(1), True), k)
            text = np.repeat(np.arange(len(n)), n)
            at = np.cumsum(n) - n
            some = n > 0
            total = lambda x: np.add.reduceat(x, at[some]).view(np.int64) if some.any() else np.zeros(0, np.int64)
            s1, s2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            s1[some], s2[some] = total(words.mix(key)), total(words.mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            bit = words.mix(key + np.uint64(11)) >> np.uint64(64 - (SKETCH - 1).bit_length())
            flip = np.uint64(1) << (bit & np.uint64(63))
            sketch = np.zeros((len(_SKETCH), len(n)), np.uint64)
            for i in range(len(_SKETCH)):
                sketch[i, some] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == i, flip, np.uint64(0)), at[some]) if some.any() else 0
            low = (words.mix(key + np.uint64(5)) >> np.uint64(32)) < np.uint64(share)
            n_low = np.bincount(text[low], minlength=len(n))
            want = np.maximum(0, n - _least(n, num, den) + MOST_MATCHES - n_low)
            rest = ~low
            place = np.cumsum(rest) - 1
            base = np.concatenate([[0], np.cumsum(np.bincount(text[rest], minlength=len(n)))])[:-1]
            more = rest & (place - base[text] < want[text])
            yield pa.record_batch([
                batch.column(0), pa.array(n), pa.array(s1), pa.array(s2), words.lists(key[low].view(np.int64), n_low, pa.int64()), pa.array(n_low),
                words.lists(key[more].view(np.int64), np.bincount(text[more], minlength=len(n)), pa.int64()),
                *(pa.array(x.view(np.int64)) for x in sketch),
            ], names=["doc_id", "n", "s1", "s2", "low", "n_low", "more", *_SKETCH])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, low array<long>, n_low long, more array<long>, " + ", ".join(f"{g} long" for g in _SKETCH))


def choose(df: np.ndarray, place: np.ndarray, n: int, num: int, den: int, verify: float = 0.02) -> int:
    """The l with the least cost, for repeated shingles with frequencies df at the given places of the order."""
    base, best, cost = n - _least(n, num, den), 1, np.inf
    for match in range(1, min(MOST_MATCHES, _least(n, num, den)) + 1):
        reads = float(df[place < base + match].sum())
        now = reads + verify * n * reads / match
        if now < cost:
            best, cost = match, now
    return best


def postings(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """token, id, n, l, place (in the document's order), r (from 1: which of its shared ones it is) for nodes (id, n, low, n_low, more)."""
    every = nodes.select("id", F.explode("low").alias("token"))
    often = every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    known = every.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))  # no more than a document has
    rows = nodes.select("id", "n", "n_low", "more").join(known, "id", "left")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for id_, n, n_low, more, known_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known_ = known_ or []
                df = np.array([x["df"] for x in known_] + [2] * len(more), np.int64)
                place = np.concatenate([np.arange(n_low - len(known_), n_low), np.arange(n_low, n_low + len(more))])
                base = n - _least(n, num, den)
                if not (place < base + 1).any():
                    continue
                match = choose(df, place, n, num, den)
                token = np.array([x["token"] for x in known_] + more, np.int64)
                use = place < base + match
                m = int(use.sum())
                for c, v in zip(out, (token[use], np.full(m, id_), np.full(m, n), np.full(m, match, np.int32), place[use].astype(np.int64), np.flatnonzero(use).astype(np.int32) + np.int32(1)), strict=True):
                    c.append(v)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["token", "id", "n", "l", "place", "r"])

    made = shared.save(rows.mapInArrow(run, "token long, id long, n long, l int, place long, r int"), "jaccard-postings")
    several = made.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token")
    out = shared.save(made.join(several, "token"), "jaccard-shared")
    shared.drop(made)
    return out


def _overlap(a, b, num: int, den: int):
    """What sets of the two sizes share at least, if they link."""
    return F.floor((num * (F.col(a) + F.col(b)) + (num + den - 1)) / (num + den))


def _reached(found: DataFrame, num: int, den: int) -> DataFrame:
    """Postings that the shingle's smallest set can still reach."""
    least = found.groupBy("token").agg(F.min("n").alias("n_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    both = found.join(least, "token").withColumn("n_least", F.greatest(F.col("n_least"), F.ceil(num * F.col("n") / den)))
    return both.where(_overlap("n", "n_least", num, den) <= F.col("n") - F.col("place") + F.least("l", "r") - 1).drop("n_least")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, set for the ids. A bitmap spares most other texts' sets the shuffle; the join decides."""
    held = docs.sparkSession.sparkContext.broadcast(shared.bitmap(ids, "id"))

    def run(batches):
        for batch in batches:
            keep = shared.among(held.value, batch.column(2).to_numpy())
            if not keep.any():
                continue
            for some in words.slices(iter([batch.filter(pa.array(keep))])):
                key, n = shingles(words.split(some.column(1), True), k)
                yield pa.record_batch([some.column(0), pa.array(n), words.lists(key.view(np.int64), n, pa.int64())], names=["id", "n", "set"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = known.withColumn("hashed", F.xxhash64("id")).mapInArrow(run, "id long, n long, set array<long>")
    return shared.save(sets.join(ids, "id", "left_semi"), "jaccard-sets")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """x, y of the pairs (x, nx, y, ny) whose sets link."""
    left = sets.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("set").alias("sx"))
    right = sets.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("set").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(left, ["x", "nx"]).join(right, ["y", "ny"]).where(den * both >= num * (F.col("nx") + F.col("ny") - both)).select("x", "y")


def _near(match, a: str, b: str, num: int, den: int):
    """Columns of two postings, named with the endings a and b: sizes that can link, places among the first `match` shared
    ones of such a pair, and sketches that allow for it."""
    need = _overlap(f"n{a}", f"n{b}", num, den)
    inside = [F.col(f"place{e}") <= F.col(f"n{e}") - need + F.least(match, F.col(f"r{e}")) - 1 for e in (a, b)]
    differ = sum((F.bit_count(F.col(f"{g}{a}").bitwiseXOR(F.col(f"{g}{b}"))) for g in _SKETCH[1:]), F.bit_count(F.col(f"{_SKETCH[0]}{a}").bitwiseXOR(F.col(f"{_SKETCH[0]}{b}"))))
    return (den * F.least(f"n{a}", f"n{b}") >= num * F.greatest(f"n{a}", f"n{b}")) & inside[0] & inside[1] & (differ <= F.col(f"n{a}") + F.col(f"n{b}") - 2 * need)


def told_apart(docs: DataFrame, name: str = "node") -> DataFrame:
    """docs with node (or another name): its doc_id, or, where an id has different texts, a number of its own for each of them."""
    two = [F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(5)).alias("t2")]
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), *two)
    several = ids.groupBy("id").agg(F.min(F.struct("t1", "t2")).alias("a"), F.max(F.struct("t1", "t2")).alias("b"))
    several = shared.save(several.where("a <> b").select("id"), "jaccard-several")
    if several.isEmpty():
        shared.drop(several)
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    texts = shared.ranked(ids.join(several, "id", "left_semi").distinct(), "id", "t1", "t2", rank="at")
    least, top = ids.agg(F.min("id"), F.max("id")).first()
    n = texts.count()
    first = top + 1 if top + n < 2**63 - 1 else least - n
    names = {c: shared.fresh(f"of_{c}", docs.columns) for c in ("id", "t1", "t2", "node")}
    texts = shared.save(texts.select("id", "t1", "t2", (F.col("at") + F.lit(first)).cast("long").alias("node")), "jaccard-texts").withColumnsRenamed(names)
    told = docs.withColumns({names["id"]: F.col("doc_id").cast("long"), names["t1"]: two[0], names["t2"]: two[1]})
    told = shared.looked_up(told, texts, [names[c] for c in ("id", "t1", "t2")], spread=["doc_id"])
    return told.withColumn(name, F.coalesce(names["node"], names["id"])).drop(*names.values())


def link(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text): texts whose sets' Jaccard index is num / den or more are linked."""
    made = groups(told_apart(docs.select("doc_id", "text")), k, num, den)
    return made.select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, node, n_shingles, component (the same for linked texts, null without an id), component_id (its least doc_id) of
    docs (doc_id, text, node)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "node").where("node <> doc_id").distinct()
    made = _linked(docs.select(F.col("node").alias("doc_id"), "text"), k, num, den).withColumnsRenamed({"doc_id": "node", "component_id": "component"})
    ids = shared.save(ids, "jaccard-ids")
    if ids.isEmpty():
        return made.select(F.col("node").alias("doc_id"), "node", "n_shingles", "component", F.col("component").alias("component_id"))
    made = shared.save(made, "jaccard-nodes")
    named = shared.looked_up(made, ids.withColumnRenamed("doc_id", "own"), ["node"], spread=["node"]).withColumn("doc_id", F.coalesce("own", "node"))
    label = shared.save(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-labels")
    return shared.looked_up(named, label, ["component"], spread=["node"]).select("doc_id", "node", "n_shingles", "component", "component_id")


def _linked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """As link(), of docs whose ids have one text each."""
    shared.small_batches(docs.sparkSession)
    rows = shared.save(prefixes(docs, k, num, den), "jaccard-prefixes")
    narrow = rows.select("doc_id", "n", "s1", "s2")
    classes = shared.save(narrow.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n")), "jaccard-classes")
    nodes = rows.join(classes.select("id"), F.col("doc_id") == F.col("id")).select("id", "n", "low", "n_low", "more", *_SKETCH).dropDuplicates(["id"])
    every = postings(nodes, num, den)
    found = shared.save(_reached(every, num, den).join(nodes.select("id", *_SKETCH), "id"), "jaccard-reached")
    shared.drop(every)
    ends = ["id", "n", "l", "place", "r", *_SKETCH]

    # against pivots
    orders = [F.col("place") / F.col("n"), *(F.xxhash64("id", "token", F.lit(i)) for i in range(PIVOTS))]
    pivots = found.groupBy("token").agg(*(F.min_by(F.struct(*ends), F.struct(o, F.xxhash64("id"))).alias(f"p{i}") for i, o in enumerate(orders)))
    pivots = pivots.select("token", F.inline(F.array_distinct(F.array(*(f"p{i}" for i in range(len(orders))))))).withColumnsRenamed({c: f"{c}_x" for c in ends})
    members = found.withColumnsRenamed({c: f"{c}_y" for c in ends})
    pairs = members.join(pivots, "token").where((F.col("id_x") != F.col("id_y")) & _near(F.lit(1), "_x", "_y", num, den))
    state = found.select("id").distinct().withColumn("comp", F.col("id"))
    joined = _joined(state, docs, pairs.select(F.col("id_x").alias("x"), F.col("n_x").alias("nx"), F.col("id_y").alias("y"), F.col("n_y").alias("ny")).distinct(), k, num, den)

    # between components
    now = found.join(joined, "id")
    by = now.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.count("*").alias("comps"), F.sum("m").alias("all"), (F.sum("m") - F.max("m")).alias("minor")).where("comps > 1")
    # a shingle's pairs are dealt over a grid of blocks of its members: one cell has BLOCK of each side, however many there are
    side = shared.save(now.join(by.select("token", "major", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(b) for c, b in (("minor", "rows"), ("all", "columns")))), "token"), "jaccard-open")
    dealt = lambda n, i: F.pmod(F.xxhash64("id", F.lit(i)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = side.where("comp <> major").withColumn("block", dealt("rows", 1)).withColumn("other", every("columns")).drop("major", "rows", "columns").withColumnsRenamed({c: f"{c}_x" for c in [*ends, "comp"]})
    right = side.withColumn("other", dealt("columns", 2)).withColumn("block", every("rows")).drop("rows", "columns").withColumnsRenamed({c: f"{c}_y" for c in [*ends, "comp"]})
    match = F.least("l_x", "l_y")
    once = (F.col("comp_y") == F.col("major")) | (F.col("id_x") < F.col("id_y"))
    pairs = left.join(right, ["token", "block", "other"]).where((F.col("comp_x") != F.col("comp_y")) & once & _near(match, "_x", "_y", num, den))
    pairs = pairs.groupBy(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).agg(F.count("*").alias("m"), F.min(match).alias("l"), *(F.min(F.when(F.col("id_x") < F.col("id_y"), F.col(a)).otherwise(F.col(b))).alias(c) for a, b, c in (("n_x", "n_y", "nx"), ("n_y", "n_x", "ny")))).where("m >= l").select("x", "nx", "y", "ny")
    joined = _joined(joined, docs, pairs, k, num, den)
    whole = shared.save(classes.join(joined, "id", "left").select("s1", "s2", F.coalesce("comp", "id").alias("component_id")), "jaccard-components")
    for t in (side, found, classes):
        shared.drop(t)
    return narrow.join(whole, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _joined(state: DataFrame, docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """state (id, comp) after the links among the candidates pairs (x, nx, y, ny)."""
    state, pairs = shared.save(state, "jaccard-state"), shared.save(pairs, "jaccard-pairs")
    sets = _sets(docs, pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), k)
    links = _links(_verified(pairs, sets, num, den), state)
    out = _relabelled(state, links)
    for t in (sets, pairs, links):
        shared.drop(t)
    return out


def _links(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Links between the components of the linked pairs x, y."""
    u, v = (state.select(F.col("id").alias(a), F.col("comp").alias(b)) for a, b in (("x", "u"), ("y", "v")))
    return shared.save(pairs.join(u, "x").join(v, "y").select("u", "v").distinct(), "jaccard-links")


def _relabelled(state: DataFrame, links: DataFrame) -> DataFrame:
    if links.isEmpty():
        return state
    new = components(links).withColumnRenamed("node", "comp")
    return shared.save(state.join(new, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), "jaccard-state")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(shared.documents(spark, sf_dir), 3, 90, 100)
