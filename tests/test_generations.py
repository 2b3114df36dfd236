"""Generations: committed last, found out when damaged, restored whole or not at all."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wrenchfield.sources import generations


def tables(spark, n):
    v = spark.createDataFrame([(i, None if i % 3 else f"P{i}", {"a": i}, [i, None]) for i in range(n)], "id long, plate string, props map<string,int>, list array<int>")
    return {"lines": v.select("id", "list"), "repairs": v.select("id", "plate"), "vehicles": v}


def test_a_write_that_stops_leaves_the_generation_before(spark, tmp_path):
    path = str(tmp_path / "s")
    assert generations.generations(spark, path).count() == 0
    with pytest.raises(LookupError):
        generations.read(spark, path)
    needs = {"lines": ["repairs"], "repairs": ["vehicles"]}
    assert generations.commit(tables(spark, 5), path, needs) == 1
    assert list(generations.read(spark, path, check=True)) == ["vehicles", "repairs", "lines"]
    broken = tables(spark, 9) | {"lines": spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))}
    before = {p for p in Path(path).rglob("*.parquet")}
    with pytest.raises(Exception, match="lost"):
        generations.commit(broken, path, needs)
    assert {p for p in Path(path).rglob("*.parquet")} == before
    assert generations.read(spark, path)["vehicles"].count() == 5
    # a folder of a writer that died before its manifest
    tables(spark, 7)["vehicles"].write.parquet(f"{path}/gen-dead/vehicles")
    assert [r["generation"] for r in generations.generations(spark, path).collect()] == [1]
    assert generations.commit(tables(spark, 8), path, needs, note="second") == 2
    assert generations.read(spark, path)["vehicles"].count() == 8 and generations.read(spark, path, 1)["vehicles"].count() == 5
    assert generations.vacuum(spark, path) == 2
    assert [r["note"] for r in generations.generations(spark, path).collect()] == ["second"] and generations.read(spark, path, check=True)["lines"].count() == 8


def test_digests_have_no_order(spark):
    v = tables(spark, 60)["vehicles"]
    assert generations.digest(v) == generations.digest(v.orderBy(F.desc("id")).repartition(7))
    assert generations.digest(v) != generations.digest(v.where("id <> 5")) and generations.digest(v)[1] != generations.digest(v.withColumn("plate", F.when(F.col("id") == 4, "x").otherwise(F.col("plate"))))[1]
    a = spark.createDataFrame([("x", None)], "a string, b string")
    assert generations.digest(a)[1] != generations.digest(a.select(F.lit(None).cast("string").alias("a"), F.col("a").alias("b")))[1]
    assert generations.digest(v.limit(0)) == (0, "0")


def test_restoring(spark, tmp_path):
    path, to = str(tmp_path / "s"), str(tmp_path / "to")
    generations.commit(tables(spark, 5), path)
    generations.commit(tables(spark, 6), to)
    audit = generations.restore(spark, path, to, 1, {"lines": ["repairs"]}, user_id=3).first()
    assert (audit["user_id"], audit["action_type"], audit["entity_id"]) == (3, "backup_restored", "2") and '"vehicles": 5' in audit["new_value"]
    assert generations.read(spark, to, check=True)["vehicles"].count() == 5 and generations.read(spark, to, 1)["vehicles"].count() == 6
    victim = next(p for p in Path(path).rglob("*.parquet") if p.is_file() and p.parent.name == "repairs" and p.stat().st_size > 0)
    spark.read.parquet(f"{victim.parent}").limit(2).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/less")
    for p in victim.parent.glob("*.parquet"):
        p.unlink()
    for p in victim.parent.glob(".*.crc"):
        p.unlink()
    for p in Path(f"{tmp_path}/less").glob("part-*.parquet"):
        p.rename(victim.parent / p.name)
    with pytest.raises(generations.Damaged, match="repairs: 2 rows"):
        generations.restore(spark, path, to)
    assert [r["generation"] for r in generations.generations(spark, to).collect()] == [2, 1]


def test_tables_that_need_each_other():
    assert generations.in_order(["a", "b", "c"], {"a": ["c", "elsewhere"], "c": ["b"]}) == ["b", "c", "a"]
    with pytest.raises(ValueError, match="a -> b -> a"):
        generations.in_order(["a", "b"], {"a": ["b"], "b": ["a"]})
