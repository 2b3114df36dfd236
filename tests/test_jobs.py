"""The life of jobs: by hand, and a stream of late, doubled and replayed events against the whole history."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wrenchfield.streaming import jobs

T = dt.datetime(2024, 1, 1)
EVENTS = "document_id long, event_id string, event string, at timestamp, error string"
minute = lambda n: T + dt.timedelta(minutes=n)


def test_life_of_a_job(spark):
    said = [("enqueue", 0), ("enqueue", 1), ("start", 2), ("start", 3), ("fail", 4), ("enqueue", 5), ("retry", 6), ("start", 7), ("retry", 8), ("complete", 9), ("retry", 10), ("start", 12), ("complete", 500), ("start", 501)]
    rows = [(1, f"{i:02}", e, minute(n), "bad" if e == "fail" else None) for i, (e, n) in enumerate(said)] + [(1, None, "enqueue", T, None), (None, "x", "enqueue", T, None), (2, "y", "complete", T, None)]
    got = [(r["job"], r["status"], r["attempts"], int((r["at"] - T).total_seconds() // 60), r["error"]) for r in jobs.history(spark.createDataFrame(rows + rows[:5], EVENTS), until=minute(10_000)).orderBy("at").collect()]
    assert got == [
        (1, "queued", 0, 0, None), (1, "processing", 1, 2, None), (1, "failed", 1, 4, "bad"), (2, "queued", 0, 5, None), (2, "processing", 1, 7, None), (2, "completed", 1, 9, None), (3, "queued", 0, 10, None), (3, "processing", 1, 12, None),
        (3, "retry", 1, 72, "stuck"), (3, "processing", 2, 501, None), (3, "retry", 2, 561, "stuck"),
    ]
    assert jobs.history(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_stream_gives_the_rows_of_the_history(spark, tmp_path):
    rng = np.random.default_rng(4)
    events = [(int(rng.integers(0, 9)), f"e{i:03}", str(rng.choice(["enqueue", "retry", "start", "complete", "fail"], p=[0.15, 0.15, 0.4, 0.15, 0.15])), minute(i), "bad") for i in range(240)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    shown = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n, a in enumerate(range(0, 240, 60)):
            part = events[a : a + 60]
            part = [part[i] for i in rng.permutation(60)] + part[:20] + (events[a - 5 : a] if a else [])  # out of order, doubled, and some that came before
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
        spark.createDataFrame([(99, "end", "enqueue", minute(9_000), None)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/9")
        read = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        made = jobs.stream(read, late="70 minutes")
        query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert not query.isActive and query.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shown)
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    key = lambda df: sorted((r["document_id"], r["at"], r["job"], r["status"], r["attempts"], r["error"] or "") for r in df.where("document_id < 99").collect())
    got, want = spark.read.parquet(f"{tmp_path}/out"), jobs.history(spark.createDataFrame(events, EVENTS), until=minute(8_000))
    assert key(got) == key(want) and len(key(want)) > 60
    assert key(jobs.current(got)) == key(jobs.current(want))
