"""Committed snapshots: generations of tables with a manifest that is written last.

A generation is a folder with a Parquet folder for each table. It counts from the moment when its manifest, one JSON file,
appears under its final name, by a rename; a write that stops halfway leaves a folder that nothing reads, and the
generation before stays the newest. Tables are digested without an order (their rows' hashes, added up, and their number),
so that a copy that lost or changed a row is found out, however its files are cut."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

MANIFESTS = "_manifests"


class Damaged(ValueError):
    """A table that isn't what its manifest says."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and the sum of their hashes: the same for the same rows in any order and any files."""
    flat = [F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in flat]) if flat else F.lit("")  # a null hashes like a column that isn't there
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(nulls, *flat).cast("decimal(20,0)"))).first()
    return n, str(total or 0)


def in_order(names: Iterable[str], needs: dict[str, Iterable[str]]) -> list[str]:
    """names, each after those that it needs (by foreign keys), else as they stand."""
    names, out = list(names), []

    def add(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"tables need each other: {' -> '.join([*above, name])}")
        if name not in out:
            for other in needs.get(name, ()):
                if other in names:
                    add(other, (*above, name))
            out.append(name)

    for name in names:
        add(name, ())
    return out


def commit(tables: dict[str, DataFrame], path: str, needs: dict[str, Iterable[str]] | None = None, note: str = "") -> int:
    """Write a generation of all tables and give its number. Without a success for every table nothing is committed, and what
    was written goes. Of two writers the first to rename its manifest gets a number, the other one the next."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"gen-{uuid.uuid4().hex}"
    rows = []
    try:
        for name in in_order(tables, needs or {}):
            tables[name].write.parquet(f"{path}/{folder}/{name}")
            n, sum_ = digest(spark.read.schema(tables[name].schema).parquet(f"{path}/{folder}/{name}"))
            rows.append({"name": name, "rows": n, "digest": sum_, "schema": tables[name].schema.json()})
        held = json.dumps({"folder": folder, "note": note, "at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "tables": rows}, ensure_ascii=False)
        draft, fs = _fs(spark, f"{path}/{MANIFESTS}/.{folder}")
        stream = fs.create(draft, True)
        stream.write(bytearray(held.encode()))
        stream.close()
        number = max([g for g, _ in _manifests(spark, path)], default=0) + 1
        while not _renamed(spark, fs, draft, f"{path}/{MANIFESTS}/{number:012d}.json"):
            number += 1
        return number
    except BaseException:
        for left in (f"{path}/{folder}", f"{path}/{MANIFESTS}/.{folder}"):
            p, fs = _fs(spark, left)
            fs.delete(p, True)
        raise


def _renamed(spark: SparkSession, fs, draft, to: str) -> bool:
    p, _ = _fs(spark, to)
    return not fs.exists(p) and fs.rename(draft, p)


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and path of the committed generations: a small list, one entry for each snapshot that was taken."""
    p, fs = _fs(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((int(n[:-5]), f"{path}/{MANIFESTS}/{n}") for n in names if n.endswith(".json") and n[:-5].isdigit())


def generations(spark: SparkSession, path: str) -> DataFrame:
    """generation, at, note, folder, tables (name, rows, digest, schema) of what is committed, newest first."""
    found = _manifests(spark, path)
    ddl = "at string, note string, folder string, tables array<struct<name:string,rows:long,digest:string,schema:string>>"
    if not found:
        return spark.createDataFrame([], f"generation long, {ddl}")
    rows = spark.read.schema(ddl).json([m for _, m in found]).withColumn("generation", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long"))
    return rows.select("generation", "at", "note", "folder", "tables").orderBy(F.desc("generation"))


def read(spark: SparkSession, path: str, generation: int | None = None, check: bool = False) -> dict[str, DataFrame]:
    """The tables of a generation, the newest if none is named, in the order in which they were written; with check, each is
    digested and held against the manifest first."""
    found = generations(spark, path)
    row = (found if generation is None else found.where(F.col("generation") == generation)).first()
    if row is None:
        raise LookupError(f"no generation {generation or ''} in {path}")
    out = {}
    for t in row["tables"]:
        out[t["name"]] = spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{path}/{row['folder']}/{t['name']}")
        if check and (seen := digest(out[t["name"]])) != (t["rows"], t["digest"]):
            raise Damaged(f"{t['name']}: {seen[0]} rows, digest {seen[1]}; the manifest says {t['rows']}, {t['digest']}")
    return out


def restore(spark: SparkSession, path: str, to: str, generation: int | None = None, needs: dict[str, Iterable[str]] | None = None, user_id: int | None = None) -> DataFrame:
    """Make a generation of `path` the newest one of `to`, all tables or none, and give the row for the audit log. A damaged
    snapshot is not restored."""
    tables = read(spark, path, generation, check=True)
    made = commit(tables, to, needs, note=f"restored from {path}, generation {generation or 'newest'}")
    rows = {t["name"]: t["rows"] for t in generations(spark, to).where(F.col("generation") == made).first()["tables"]}
    value = json.dumps({"source": path, "generation": generation, "tables": rows}, ensure_ascii=False)
    return spark.createDataFrame([(user_id, "backup", str(made), "backup_restored", value)], "user_id long, entity_type string, entity_id string, action_type string, new_value string")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest `keep` generations, and folders that no manifest names; give the number of folders deleted.
    Not while someone writes."""
    found = generations(spark, path).collect()
    for r in found[keep:]:
        p, fs = _fs(spark, f"{path}/{MANIFESTS}/{r['generation']:012d}.json")
        fs.delete(p, False)
    stay = {r["folder"] for r in found[:keep]}
    root, fs = _fs(spark, path)
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("gen-") and s.getPath().getName() not in stay]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
