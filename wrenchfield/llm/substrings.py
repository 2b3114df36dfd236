"""Removal of repeated word sequences by compacted De Bruijn paths.

A node of the graph is a sequence of k - 1 words, an edge one of k words, between the nodes that it begins and ends with;
a text is a walk. An edge that stands in several documents is repeated, and its source is the smallest doc_id, with its
place there. A node with one repeated edge in and one out, which every walk that comes by the one leaves by the other, is
no branch: paths through such nodes are compacted, so that each walk takes a whole path or none of it, and a path needs its
first edge's places only. The words of a path's source are hashed there (BLAKE2), and what stands at a place is removed if
its words have the same hash.

1. Nodes are dealt by their anchors, the least m-word hash inside; neighbours mostly share it. Anchors are reduced to a row
   for each task and bucket, and merged: those of one document only need not travel. The others set bits in a filter of at
   most `filter_mb`; when it fills up, more nodes travel and none is lost.
2. Runs of nodes with such an anchor travel to the anchor's bucket, with the node before and after, so that a bucket has all
   edges at its nodes: it finds sources and degrees, and compacts its paths up to its border.
3. Spark joins the buckets' paths at the nodes where one of them ends and one begins, by degrees that it aggregates over all
   ends, and adds them up along their source (a window that no more than one document's paths share).
4. A path's source coordinates meet the source's text for its hash, the hash goes back to the bucket, and the places of
   whole paths, packed by the batch of their rows, meet the texts. A batch has about `batch_mb` of text.

A bucket's size doesn't depend on the input, as anchors that occur more than `hot` times (a millionth of all anchors at
least; so a bounded list) go another way: edges that leave their nodes are aggregated to sources by Spark and joined back,
which splits keys that many documents share; each is a path of its own.

Defined results: a null or empty text has no words (kept: the empty string); rows without a doc_id are never sources and
lose nothing; rows of the same doc_id are no sources for each other, each is judged by its own text; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, words

PROBES = 3


def _pack(x: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(x).tobytes(), asbytes=True) if len(x) else b""


def _unpack(x: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(x, np.dtype(kind).itemsize * n, asbytes=True), dtype=kind) if n else np.zeros(0, kind)


def anchored(w: words.Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, first word, text and anchor of each node of k words."""
    key, first, text = w.windows(k)
    if not len(key):
        return key, first, text, key
    at = np.arange(len(w.hash) - m + 1)
    low = words._ranges(w.hash, at, at + m, words._WINDOWS)
    width, have = k - m + 1, 1
    while have < width:  # the least of ever wider stretches
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return key, first, text, low[first]


def _runs(first: np.ndarray, text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where runs of consecutive nodes with one anchor begin."""
    new = np.ones(len(first), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1] + 1)
    return np.flatnonzero(new)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else []
    return list(zip(at, [*at[1:], len(sorted_)], strict=False))


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct anchors with their least and greatest document and number."""
    key, low, high, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, low, high, n = key[order], low[order], high[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.add.reduceat(n, at)) if len(at) else (key, low, high, n)


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


_ANCHOR = "bucket long, n long, key binary, low binary, high binary, count binary"


def shared_anchors(docs: DataFrame, k: int, m: int, buckets: int, flush: int = 1_500_000) -> DataFrame:
    """Saved: a row for each bucket with the anchors that several documents have, and how often they occur."""

    def scan(batches):
        parts, held = [], 0

        def out():
            key, low, high, n = _merge(parts)
            rows = [(int(_bucket(key[a : a + 1], buckets)[0]), int(b - a), _pack(np.diff(key[a:b], prepend=np.uint64(0))), _pack(low[a:b]), _pack((high - low)[a:b]), _pack(n[a:b])) for a, b in _cuts(_bucket(key, buckets))]
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)], names=["bucket", "n", "key", "low", "high", "count"]) if rows else None

        for batch in words.slices(batches):
            _, first, text, anchor = anchored(words.split(batch.column(1), False), k - 1, m)
            at = _runs(first, text, anchor)
            doc = _docs(batch)[text[at]]
            parts.append(_merge([(anchor[at], doc, doc, np.ones(len(at), np.int64))]))
            held += len(parts[-1][0])
            if held > flush:
                if (made := out()) is not None:
                    yield made
                parts, held = [], 0
        if parts and (made := out()) is not None:
            yield made

    def merge(t: pa.Table) -> pa.Table:
        parts = []
        for n, a, b, c, d in zip(*(t[x].to_pylist() for x in ("n", "key", "low", "high", "count")), strict=True):
            low = _unpack(b, n, np.int64)
            parts.append((np.cumsum(_unpack(a, n, np.uint64), dtype=np.uint64), low, low + _unpack(c, n, np.int64), _unpack(d, n, np.int64)))
        key, low, high, n = _merge(parts)
        s = low < high
        return pa.table({"bucket": t["bucket"][:1], "every": [len(key)], "n": [int(s.sum())], "key": pa.array([_pack(key[s])], pa.binary()), "count": pa.array([_pack(n[s])], pa.binary()), "runs": [int(n.sum())]})

    return shared.save(docs.select("doc_id", "text").mapInArrow(scan, _ANCHOR).groupBy("bucket").applyInArrow(merge, "bucket long, every long, n long, key binary, count binary, runs long"), "substrings-anchors")


def _bits(key: np.ndarray, n: int):
    h = key
    for _ in range(PROBES):
        h = words.mix(h + np.uint64(0x9E3779B97F4A7C15))
        yield ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Filter:
    """Shared anchors' bits, each bucket's in a slice of its own, and the sorted hot anchors."""

    def __init__(self, slices: list[tuple[int, int, bytes]], hot: np.ndarray, buckets: int):
        self.size, self.base, self.buckets, self.hot = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), buckets, hot
        at = 0
        for bucket, size, _ in slices:
            self.size[bucket], self.base[bucket] = size, at
            at += size
        self.bits = np.frombuffer(b"".join(x for _, _, x in slices), np.uint8)

    def __call__(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors several documents may have, and which of them are hot."""
        bucket = _bucket(anchor, self.buckets)
        size, base = self.size[bucket], self.base[bucket]
        hit = size > 0
        for _i, at in enumerate(_bits(anchor, 1 << 31)):
            p = base + at * size // (1 << 31)
            p = np.where(hit, p, 0)
            if len(self.bits):
                hit = hit & (((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1) > 0)
        hot = np.zeros(len(anchor), dtype=bool)
        if len(self.hot):
            hot = self.hot[np.minimum(np.searchsorted(self.hot, anchor), len(self.hot) - 1)] == anchor
        return hit, hot


def build_filter(anchors: DataFrame, buckets: int, filter_mb: int, hot: int) -> Filter:
    total, runs = (x or 0 for x in anchors.agg(F.sum("n"), F.sum("runs")).first())
    each = min(12.0, (filter_mb << 23) / max(1, total))  # bits for an anchor
    most = max(hot, runs // 1_000_000)

    def one(batches):
        for batch in batches:
            rows = []
            for bucket, n, key, count in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                key, count = _unpack(key, n, np.uint64), _unpack(count, n, np.int64)
                size = max(8, int(n * each) // 8 * 8)
                bits = np.zeros(size // 8, np.uint8)
                for at in _bits(key, 1 << 31):
                    p = at * size // (1 << 31)
                    np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
                rows.append((bucket, size, bits.tobytes(), np.sort(key[count > most]).tobytes()))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "size", "bits", "hot"]) if rows else None

    got = [tuple(r) for r in anchors.where("n > 0").select("bucket", "n", "key", "count").mapInArrow(lambda b: (x for x in one(b) if x is not None), "bucket long, size long, bits binary, hot binary").toLocalIterator()]  # filter_mb and a million hot anchors at most
    return Filter([x[:3] for x in got], np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x[3], np.uint64) for x in got)])), buckets)


_NODES = "bucket long, n long, nodes long, row binary, doc binary, pos binary, size binary, node binary"
_WHOLE = (("left", np.uint64), ("right", np.uint64), ("first", np.int64), ("through", np.int64), ("last", np.int64), ("size", np.int64), ("source", np.int64), ("source_row", np.uint64), ("source_pos", np.int64))
_PLACE = (("piece", np.int64), ("row", np.uint64), ("pos", np.uint32))
_PATHS = "bucket long, n long, " + ", ".join(f"{c} binary" for c, _ in _WHOLE) + ", places long, " + ", ".join(f"{c} binary" for c, _ in _PLACE)
_RUN = "batch long, n long, row binary, pos binary, size binary, source binary, source_pos binary, hash binary"
_RUN_KINDS = (np.uint64, np.uint32, np.uint32, np.int64, np.uint32, np.dtype("V16"))


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _edge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return words.mix(left ^ words.mix(right + np.uint64(0x9E3779B97F4A7C15)))


def _run_rows(row, pos, size, source, source_pos, hash_, batches: int):
    """Places of paths, packed by the batch of their rows."""
    batch = (row.view(np.int64) % batches).astype(np.int64)
    order = np.argsort(batch, kind="stable")
    batch = batch[order]
    cols = [np.ascontiguousarray(x).astype(t, copy=False)[order] for x, t in zip((row, pos, size, source, source_pos, hash_), _RUN_KINDS, strict=True)]
    made = [(int(batch[a]), int(b - a), *(_pack(x[a:b]) for x in cols)) for a, b in _cuts(batch)]
    return pa.table([pa.array([m[i] for m in made], t) for i, t in enumerate([pa.int64()] * 2 + [pa.binary()] * 6)], names=_names(_RUN))


def paths(docs: DataFrame, held, k: int, m: int, buckets: int, flush: int = 1_000_000) -> DataFrame:
    """Each bucket's paths as far as it sees them, and the places of their first edges, packed (_PATHS)."""

    def scan(it):
        parts, count = [], 0

        def out():
            bucket, row, doc, pos, size, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, doc, bucket))
            n = (size >> 2).astype(np.int64)
            begin = np.cumsum(n) - n
            rows = []
            for a, b in _cuts(bucket[order]):
                o = order[a:b]
                flat = np.repeat(begin[o] - (np.cumsum(n[o]) - n[o]), n[o]) + np.arange(n[o].sum())
                rows.append((int(bucket[o[0]]), b - a, int(n[o].sum()), *(_pack(x) for x in (row[o], doc[o], pos[o], size[o], node[flat]))))
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()] * 5, strict=True)], names=_names(_NODES))

        for batch in words.slices(it):
            w = words.split(batch.column(1), False)
            key, first, text, anchor = anchored(w, k - 1, m)
            if not len(key):
                continue
            hit, hot = held.value(anchor)
            own = np.flatnonzero(hit & ~hot)
            bucket = _bucket(anchor, buckets)
            at = _runs(first[own], text[own], bucket[own])  # by buckets, so that none has an edge of a text twice
            if not len(at):
                continue
            a, n = own[at], np.diff(at, append=len(own))
            b = a + n
            before = np.concatenate([[False], text[1:] == text[:-1]])[a]  # a node before, and one after
            after = np.concatenate([text[1:] == text[:-1], [False]])[b - 1]
            n = n + before + after
            some = n > 1
            a, n, before, after = (a - before)[some], n[some], before[some], after[some]
            flat = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            t = text[a]
            row = batch.column(2).to_numpy().view(np.uint64)
            parts.append((bucket[a + before], row[t], _docs(batch)[t], (first[a] - w.at[t]).astype(np.uint32), (n << 2 | before << 1 | after).astype(np.uint32), key[flat]))
            count += len(flat)
            if count > flush:
                yield out()
                parts, count = [], 0
        if parts:
            yield out()

    def merge(t: pa.Table) -> pa.Table:
        cols = [[] for _ in range(5)]
        for n, nodes, *packed in zip(*(t[c].to_pylist() for c in _names(_NODES)[1:]), strict=True):
            for c, x, kind in zip(cols, packed, (np.uint64, np.int64, np.uint32, np.uint32, np.uint64), strict=True):
                c.append(_unpack(x, nodes if c is cols[4] else n, kind))
        row, doc, pos, size, node = (np.concatenate(c) for c in cols)
        whole, places = _compacted(row, doc, pos, size, node)
        out = {"bucket": t["bucket"][:1], "n": [len(whole[0])], **{c: pa.array([_pack(x.astype(kind, copy=False))], pa.binary()) for (c, kind), x in zip(_WHOLE, whole, strict=True)}}
        return pa.table({**out, "places": [len(places[0])], **{c: pa.array([_pack(x.astype(kind, copy=False))], pa.binary()) for (c, kind), x in zip(_PLACE, places, strict=True)}})

    return shared.save(docs.select("doc_id", "text", "row").mapInArrow(scan, _NODES).groupBy("bucket").applyInArrow(merge, _PATHS), "substrings-paths")


def _compacted(row, doc, pos, size, node) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Paths (_WHOLE) and places (_PLACE) of a bucket, from its runs of nodes."""
    n, before, after = (size >> 2).astype(np.int64), (size >> 1 & 1).astype(bool), (size & 1).astype(bool)
    run = np.repeat(np.arange(len(n)), n - 1)
    within = np.arange(len(run)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
    left = (np.cumsum(n) - n)[run] + within
    u, v, at = node[left], node[left + 1], pos[run].astype(np.int64) + within
    ours = ~(before[run] & (within == 0))  # the edge's first node is this bucket's
    enters = ~(after[run] & (within == n[run] - 2))  # its last one is
    own = _edge(u, v)
    order = np.lexsort((at, row[run], doc[run], own))
    new = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    of = np.empty(len(order), np.int64)  # each place's edge
    of[order] = np.cumsum(np.bincount(new, minlength=len(order))) - 1 if len(order) else 0
    count = np.diff(new, append=len(order))
    lead, final = order[new], order[new + count - 1]
    repeated = doc[run][lead] < doc[run][final]
    follows = np.zeros(len(order), bool)  # stands after a repeated edge
    follows[1:] = (within[1:] > 0) & repeated[of[:-1]]
    through = np.bincount(of, weights=follows, minlength=len(new)).astype(np.int64)
    # degrees of this bucket's nodes
    out_of, into = np.sort(u[lead][repeated & ours[lead]]), np.flatnonzero(repeated & enters[lead])
    into = into[np.argsort(v[lead][into], kind="stable")]
    ends = v[lead][into]
    e = np.flatnonzero(repeated & ours[lead])
    e = e[np.lexsort((at[lead][e], row[run][lead][e], doc[run][lead][e]))]  # along their sources
    begins = u[lead][e]
    degree_out = np.searchsorted(out_of, begins, side="right") - np.searchsorted(out_of, begins)
    low = np.searchsorted(ends, begins)
    degree_in = np.searchsorted(ends, begins, side="right") - low
    prior = into[np.minimum(low, len(into) - 1)] if len(into) else np.zeros(len(e), np.int64)
    joined = np.zeros(len(e), bool)
    joined[1:] = prior[1:] == e[:-1]  # the edge before it along the source is the one that enters its node
    joined &= (degree_in == 1) & (degree_out == 1) & (through[e] == count[e]) & (count[prior] == count[e]) if len(e) else joined
    start = np.flatnonzero(~joined)
    stop = np.append(start[1:], len(e)) - 1
    f, g = e[start], e[stop]
    whole = (u[lead][f], v[lead][g], count[f], through[f], count[g], stop - start + 1, doc[run][lead][f], row[run][lead][f], at[lead][f])
    piece = np.full(len(new), -1, np.int64)
    piece[f] = np.arange(len(f))
    p = np.flatnonzero((piece[of] >= 0) & (doc[run] > doc[run][lead][of]))
    return whole, (piece[of][p], row[run][p], at[p])


def compacted(found: DataFrame) -> DataFrame:
    """Whole paths: bucket, piece (where the path begins), source, source_row, source_pos, size (edges). Buckets' paths are
    joined at nodes where just one ends and one begins, and all that take the one take the other."""

    def unpack(it):
        for batch in it:
            for bucket, n, *packed in zip(*(batch.column(i).to_pylist() for i in range(2 + len(_WHOLE))), strict=True):
                cols = [_unpack(x, n, kind) for x, (_, kind) in zip(packed, _WHOLE, strict=True)]
                yield pa.record_batch([pa.array(np.full(n, bucket)), pa.array(np.arange(n)), *(pa.array(x.view(np.int64)) for x in cols)], names=["bucket", "piece", *(c for c, _ in _WHOLE)])

    pieces = shared.save(found.where("n > 0").select("bucket", "n", *(c for c, _ in _WHOLE)).mapInArrow(unpack, "bucket long, piece long, " + ", ".join(f"{c} long" for c, _ in _WHOLE)), "substrings-pieces")
    none = F.lit(None).cast("long")
    starts = pieces.select(F.col("left").alias("node"), F.col("first"), F.col("through"), none.alias("last"), F.col("source_row").alias("to_row"), F.col("source_pos").alias("to_pos"), none.alias("from_row"), none.alias("from_pos"))
    ends = pieces.select(F.col("right").alias("node"), none.alias("first"), none.alias("through"), F.col("last"), none.alias("to_row"), none.alias("to_pos"), F.col("source_row").alias("from_row"), (F.col("source_pos") + F.col("size")).alias("from_pos"))
    nodes = starts.unionByName(ends).groupBy("node").agg(F.count("first").alias("degree_out"), F.count("last").alias("degree_in"), *(F.max(c).alias(c) for c in starts.columns[1:]))
    plain = nodes.where("degree_in = 1 and degree_out = 1 and through = first and first = last and from_row = to_row and from_pos = to_pos").select(F.col("node").alias("left"), F.lit(True).alias("plain"))
    along = Window.partitionBy("source_row").orderBy("source_pos")  # one document's paths at most
    begun = pieces.join(plain, "left", "left").withColumn("start", F.last(F.when(F.col("plain").isNull(), F.col("source_pos")), ignorenulls=True).over(along))
    out = begun.groupBy("source_row", "start").agg(F.sum("size").alias("size"), F.min_by(F.struct("bucket", "piece", "source"), "source_pos").alias("x"))
    made = shared.save(out.select("x.bucket", "x.piece", "x.source", "source_row", F.col("start").alias("source_pos"), "size"), "substrings-whole")
    shared.drop(pieces)
    return made


def hot_places(docs: DataFrame, held, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """Places of the edges that leave nodes with hot anchors, and the repeated ones among them as paths (bucket -1, piece the edge)."""

    def scan(it):
        for batch in words.slices(it):
            w = words.split(batch.column(1), False)
            key, first, text, anchor = anchored(w, k - 1, m)
            _, hot = held.value(anchor) if len(key) else (None, np.zeros(0, dtype=bool))
            at = np.flatnonzero(hot[:-1] & (text[1:] == text[:-1]))
            own, t = _edge(key[at], key[at + 1]).view(np.int64), text[at]
            yield pa.record_batch([pa.array(own), pa.array(batch.column(2).to_numpy()[t]), pa.array(_docs(batch)[t]), pa.array(first[at] - w.at[t])], names=["own", "row", "doc", "pos"])

    places = docs.select("doc_id", "text", "row").mapInArrow(scan, "own long, row long, doc long, pos long")
    sources = places.groupBy("own").agg(F.min(F.struct("doc", "row", "pos")).alias("s"), F.max("doc").alias("last")).where("s.doc < last")
    return places, sources.select(F.lit(-1).cast("long").alias("bucket"), F.col("own").alias("piece"), F.col("s.doc").alias("source"), F.col("s.row").alias("source_row"), F.col("s.pos").alias("source_pos"), F.lit(1).cast("long").alias("size"))


def _hashed(text: list[bytes], start: int, end: int) -> bytes:
    return hashlib.blake2b(b" ".join(text[start:end]), digest_size=16).digest()


def with_hashes(docs: DataFrame, whole: DataFrame, k: int, batches: int) -> DataFrame:
    """whole with the hash of each path's words, read at its source's coordinates. A bitmap of rows spares other texts the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(shared.bitmap(whole.select("source_row").distinct(), "source_row"))

    def chosen(it):
        for batch in it:
            keep = shared.among(bits.value, batch.column(2).to_numpy())
            if keep.any():
                yield batch.filter(pa.array(keep)).select(["text", "row"])

    texts = docs.select("text", "row", F.xxhash64("row").alias("hashed")).mapInArrow(chosen, "text string, row long").withColumn("batch", F.pmod("row", F.lit(batches)))

    def read(texts: pa.Table, asked: pa.Table) -> pa.Table:
        rows, first = np.unique(asked["source_row"].to_numpy(), return_inverse=True)
        order = np.argsort(first, kind="stable")
        cut = np.searchsorted(first[order], np.arange(len(rows) + 1))
        start, size = asked["source_pos"].to_numpy(), asked["size"].to_numpy()
        made: list[bytes | None] = [None] * asked.num_rows
        for i, row in enumerate(texts["row"].to_pylist()):
            at = int(np.searchsorted(rows, row))
            if at < len(rows) and rows[at] == row:
                text = (texts["text"][i].as_py() or "").encode().split()
                for j in order[cut[at] : cut[at + 1]].tolist():
                    made[j] = _hashed(text, start[j], start[j] + size[j] + k - 1)
        return asked.append_column("hash", pa.array(made, pa.binary())).select(["bucket", "piece", "source", "source_pos", "size", "hash"])

    asked = whole.withColumn("batch", F.pmod("source_row", F.lit(batches)))
    return shared.save(texts.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(read, "bucket long, piece long, source long, source_pos long, size long, hash binary"), "substrings-hashed")


def runs_of(found: DataFrame, hashed: DataFrame, batches: int) -> DataFrame:
    """Where whole paths stand (_RUN), from the places of their first pieces."""

    def one(held: pa.Table, heads: pa.Table) -> pa.Table:
        if not held.num_rows or not heads.num_rows:
            return _run_rows(*(np.zeros(0, t) for t in _RUN_KINDS), batches)
        n = held["places"][0].as_py()
        piece, row, pos = (_unpack(held[c][0].as_py(), n, kind) for c, kind in _PLACE)
        order = np.argsort(heads["piece"].to_numpy(), kind="stable")
        head = heads["piece"].to_numpy()[order]
        at = np.minimum(np.searchsorted(head, piece), len(head) - 1)
        keep = head[at] == piece
        at = order[at[keep]]
        hash_ = np.frombuffer(b"".join(heads["hash"].to_pylist()), "V16")
        return _run_rows(row[keep], pos[keep], heads["size"].to_numpy()[at], heads["source"].to_numpy()[at], heads["source_pos"].to_numpy()[at], hash_[at], batches)

    held = found.where("places > 0").select("bucket", "places", *(c for c, _ in _PLACE))
    heads = hashed.where("bucket >= 0 and hash is not null")
    return held.groupBy("bucket").cogroup(heads.groupBy("bucket")).applyInArrow(one, _RUN)


def hot_runs(places: DataFrame, hashed: DataFrame, batches: int) -> DataFrame:
    """The same for the hot edges, joined back to every place."""
    found = places.join(hashed.where("bucket < 0 and hash is not null").withColumnRenamed("piece", "own"), "own").where("source < doc").select("row", "pos", "source", "source_pos", "hash")

    def pack(it):
        for batch in it:
            row, pos, source, source_pos = (batch.column(i).to_numpy() for i in range(4))
            yield from _run_rows(row.view(np.uint64), pos, np.ones(len(row), np.uint32), source, source_pos, np.frombuffer(b"".join(batch.column(4).to_pylist()), "V16"), batches).to_batches()

    return found.mapInArrow(pack, _RUN)


def spans_of(runs: list[tuple[int, int, int, int]], k: int) -> list[tuple[int, int, int, int]]:
    """(first word, end, source document, first word there) of the paths (pos, size, source, source_pos): those that follow
    each other in the source, too, are one span."""
    out: list[list[int]] = []
    for p, n, s, q in sorted(set(runs)):
        if out and out[-1][1] - k + 1 == p and out[-1][2] == s and q - out[-1][3] == p - out[-1][0]:
            out[-1][1] = p + n - 1 + k
        else:
            out.append([p, p + n - 1 + k, s, q])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, k: int = 13, m: int = 5, hot: int = 5000, filter_mb: int = 48, batch_mb: int = 4, bucket_mb: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single spaces), spans (what went, and where it was first)."""
    shared.small_batches(docs.sparkSession)
    size = shared.text_bytes(docs)
    buckets, batches = max(4, math.ceil(size / (bucket_mb << 20))), max(1, math.ceil(size / (batch_mb << 20)))
    docs = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    known = docs.where(F.col("doc_id").isNotNull())
    anchors = shared_anchors(known, k, m, buckets)
    held = docs.sparkSession.sparkContext.broadcast(build_filter(anchors, buckets, filter_mb, hot))
    shared.drop(anchors)
    found = paths(known, held, k, m, buckets)
    places, often = hot_places(known, held, k, m)
    hashed = with_hashes(known, shared.save(compacted(found).unionByName(often), "substrings-asked"), k, batches)
    runs = runs_of(found, hashed, batches).unionByName(hot_runs(places, hashed, batches))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))

    def clean(texts: pa.Table, packed: pa.Table) -> pa.Table:
        cols = [[np.zeros(0, kind)] for kind in _RUN_KINDS]
        for n, *x in zip(*(packed[c].to_pylist() for c in _names(_RUN)[1:]), strict=True):
            for c, p in zip(cols, x, strict=True):
                c.append(_unpack(p, n, c[0].dtype))
        row, *rest = (np.concatenate(c) for c in cols)
        order = np.argsort(row, kind="stable")
        row, rest = row[order], [c[order] for c in rest]
        own = texts["row"].to_numpy().view(np.uint64)
        a, b = np.searchsorted(row, own), np.searchsorted(row, own, side="right")
        out = {"n_words": [], "n_removed": [], "kept": [], "spans": []}
        for i, (lo, hi, known_) in enumerate(zip(a.tolist(), b.tolist(), texts["doc_id"].is_valid().to_pylist(), strict=True)):
            text = (texts["text"][i].as_py() or "").encode().split()
            places_ = zip(*(c[lo:hi].tolist() for c in rest), strict=True) if known_ else ()
            spans = spans_of([(p, n, s, q) for p, n, s, q, h in places_ if _hashed(text, p, p + n + k - 1) == h], k)
            keep = np.ones(len(text), dtype=bool)
            for s in spans:
                keep[s[0] : s[1]] = False
            out["n_words"].append(len(text)), out["n_removed"].append(len(text) - int(keep.sum()))
            out["kept"].append(b" ".join(compress(text, keep.tolist()) if spans else text).decode())
            out["spans"].append([dict(zip(("start", "end", "source", "source_start"), s, strict=True)) for s in spans])
        types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "spans": span}
        return pa.table({"doc_id": texts["doc_id"], **{c: pa.array(v, types[c]) for c, v in out.items()}})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int,source:long,source_start:int>>"
    texts = docs.withColumn("batch", F.pmod("row", F.lit(batches)))
    return texts.groupBy("batch").cogroup(runs.groupBy("batch")).applyInArrow(clean, schema)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(shared.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
