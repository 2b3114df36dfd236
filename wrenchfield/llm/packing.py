"""Cost-balanced packing of documents into token sequences.

A text's ids and an end id are cut at every `capacity` ids; whole cuts are sequences of their own, and the remainders
are packed. Remainders are dealt by hash into groups of about `group_rows`. A group opens as many sequences as its ids
fill, the last ones with lengths that are powers of two, so that nothing is padded. Longest first, each remainder goes
to the sequence with the lowest estimated cost, linear * n + quadratic * n * n over the pieces in it, among those with
room for it; only when none has room is it cut, into the sequences with most room.

Defined results: a null or empty text is one end id; a null doc_id is kept as it is; repeated rows are packed each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens, words

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_ROW = 40  # bits for a row's number within its partition, and for a sequence's within its group
_SHARED = 1 << 62  # marks sequences that hold remainders


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Whole cuts as finished pieces, remainders as rows with their ids and no sequence yet."""

    def run(batches):
        encoder, seq = tokens.encoder(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << _ROW
        for batch in words.slices(batches):
            flat, count = encoder.encode(batch.column(1))
            out = {n: [] for n in [*_NAMES, "ids"]}
            at = 0
            for doc, n in zip(batch.column(0).to_pylist(), count.tolist(), strict=True):
                ids = np.append(flat[at : at + n], flat.dtype.type(end_id))
                at += n
                for start in range(0, n + 1, capacity):
                    piece = ids[start : start + capacity]
                    whole = len(piece) == capacity
                    row = (doc, start, len(piece), _crc(piece) if whole else None, n + 1, seq, 0 if whole else None, piece.tobytes() if with_ids or not whole else None)
                    for name, v in zip(out, row, strict=True):
                        out[name].append(v)
                    seq += 1
            yield pa.record_batch([pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in out.items()], names=list(out))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", ids binary")


def balance(length: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset there) of each piece, longest items first."""
    total = int(length.sum())
    size = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    room, cost, used = np.array(size, np.int64), np.zeros(len(size)), np.zeros(len(size), np.int64)
    out = []
    for i in np.argsort(-length, kind="stable").tolist():
        start, left = 0, int(length[i])
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            n = min(left, int(room[s]))
            out.append((i, start, n, s, int(used[s])))
            room[s] -= n
            used[s] += n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, group_rows: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text) and where they lie: PIECE, with the ids (little-endian) if asked for."""
    shared.small_batches(docs.sparkSession)
    path = path or tokens.default_path()
    wide = tokens.Encoder(path).wide
    rows = shared.save(cut(docs, path, capacity, end_id, with_ids), "pack-cuts")
    whole, rest = rows.where(F.col("offset").isNotNull()), rows.where(F.col("offset").isNull())
    groups = max(1, math.ceil(rest.count() / group_rows))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("sequence_id")  # as numbered when cut: the same at every run
        group = table["group"][0].as_py()
        ids = [np.frombuffer(x, "<u4" if wide else "<u2") for x in table["ids"].to_pylist()]
        doc, base, tokens_ = (table[n].to_pylist() for n in ("doc_id", "start", "doc_tokens"))
        made = balance(table["length"].to_numpy(), capacity, linear, quadratic)
        cols = [(doc[i], base[i] + a, n, _crc(ids[i][a : a + n]), tokens_[i], _SHARED | group << 20 | s, o, ids[i][a : a + n].tobytes() if with_ids else None) for i, a, n, s, o in made]
        return pa.table({n: pa.array([r[k] for r in cols], pa.binary() if n == "ids" else pa.int64()) for k, n in enumerate([*_NAMES, "ids"])})

    packed = rest.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("group").applyInArrow(one, PIECE + ", ids binary")
    out = whole.unionByName(packed)
    return out if with_ids else out.drop("ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.documents(spark, sf_dir))
