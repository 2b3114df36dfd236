"""Tables that a query writes for itself, so that what several of its parts need is worked out once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def save(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read back. Only a session without a cluster may leave it unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wrenchfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/wrenchfield/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
