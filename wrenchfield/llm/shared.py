"""What the operators share: scratch tables in the cluster's shared folder, sizes, and order without a single task."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores before it if columns have it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a session without a cluster may leave it unset: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wrenchfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows of a text table are large: unless the session asks for fewer, Arrow batches of `rows` keep workers small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
    """About n rows of df (all, if it has no more), those whose hashed key lies under n / rows: the same at each run. Never over 2 n."""
    total = df.count()
    if total <= n:
        return df
    hashed = F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(1 << 30))
    some = df.where(hashed < int(n / total * (1 << 30)))
    return some.orderBy(hashed, *key).limit(2 * n)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of any executor."""
    path = f"{scratch_dir(df.sparkSession)}/wrenchfield/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote and nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/wrenchfield/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(df: DataFrame, few: DataFrame, on: list[str], spread: list[str], most_mb: int = 16, salts: int = 32) -> DataFrame:
    """df with the other columns of few (null where it has no row), which has one row for each value of `on`; nulls are equal.
    few is broadcast if its bytes, counted, are at most most_mb; else each of its rows stands `salts` times, and the hash of
    df's columns `spread` says which one a row of df takes, so that no value is one task's."""
    size = few.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16).cast("long") for c in few.columns))).first()[0] or 0
    right = few.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    if size <= most_mb << 20:
        return df.join(F.broadcast(right), same, "left").drop(*(f"_of_{c}" for c in on))
    right = right.withColumn("_of_salt", F.explode(F.lit(list(range(salts))).cast("array<long>")))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread, F.lit(23)), F.lit(salts)))
    return left.join(right, [*same, F.col("_salt") == F.col("_of_salt")], "left").drop("_salt", "_of_salt", *(f"_of_{c}" for c in on))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of the column text, counted: a plan's own estimate holds for bare scans only."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def bitmap(ids: DataFrame, key: str, most: int = 1 << 30, slices: int = 64, hashed: bool = False) -> np.ndarray:
    """Bits of the hashes of ids' key (of the key itself, if it is a hash), 8 for each of them as far as `most` bits go: what it
    rules out isn't among the ids."""
    bits = min(most, max(1 << 20, 1 << (8 * ids.count()).bit_length()))
    width = bits // slices

    def one(t: pa.Table) -> pa.Table:
        own = np.zeros(width // 8, np.uint8)
        p = np.unique(t["at"].to_numpy()) % width
        np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))
        return pa.table({"slice": t["slice"][:1], "bits": pa.array([own.tobytes()], pa.binary())})

    at = F.pmod(F.col(key) if hashed else F.xxhash64(key), F.lit(bits))
    whole = np.zeros(bits // 8, np.uint8)
    for r in ids.select(at.alias("at")).distinct().withColumn("slice", F.floor(F.col("at") / width)).groupBy("slice").applyInArrow(one, "slice long, bits binary").toLocalIterator():
        whole[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the keys with these xxhash64 values may be among bitmap()'s ids."""
    p = hashes.view(np.uint64) % np.uint64(len(bits) * 8)
    return ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, *by: str, rank: str = "rank") -> DataFrame:
    """df with its 0-based position in the order of `by` (nulls last; ties in any order), never in a single task:
    ranges are ranked on their own and shifted by the sizes of the ranges before them (one row for each range)."""
    order = [F.col(c).asc_nulls_last() for c in by]
    parts = save(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return local.join(F.broadcast(before), "_part").withColumn(rank, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")
