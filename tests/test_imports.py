"""Imports, upserts and the life of jobs: what is read and shuffled grows with the rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from test_pairs import shuffled

from wrenchfield.operators import mutations, resolve
from wrenchfield.streaming import jobs

N = 300


def read(spark, action) -> int:
    """Records that the stages of an action read from files."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_upserts_meet_one_vehicle_a_key(spark):
    """Each of the rows met all vehicles with its VIN: N * N rows."""
    v = spark.range(N).selectExpr("id", "concat('e-', CAST(id AS STRING)) AS external_id", "'VIN1' AS vin", "CAST(NULL AS STRING) AS plate_number", "'truck' AS vehicle_type")
    new = v.selectExpr("id AS row", "CAST(NULL AS STRING) AS external_id", "vin", "plate_number", "vehicle_type")
    joined = mutations.upsert_vehicles(v, new)
    assert [tuple(r) for r in joined.select("id", "outcome").distinct().collect()] == [(0, "updated")] and joined.count() == N
    assert mutations.upserted_vehicles(v, new).count() == N
    nothing = v.withColumn("id", F.lit(None).cast("long"))
    assert mutations.upsert_vehicles(nothing, new).where("outcome = 'updated'").count() == 0
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "min(id#" in plan  # a vehicle for each key, before any row meets it (keys that are all null are left out)


def test_an_import_reads_its_lines_once(spark, tmp_path):
    """It read and normalised them five times."""
    spark.range(2000).select(
        F.col("id").alias("row"), F.lit("P100001").alias("plate"), F.lit("Shop").alias("supplier"), F.lit("заказ-наряд 5").alias("registrar"), F.lit(dt.date(2024, 1, 2)).alias("day"), F.lit("P100001|SHOP|5|2024-01-02").alias("source_key"), F.lit(7).cast("long").alias("mileage"), F.lit("work").alias("kind"), F.lit(1.5).alias("line_total")
    ).write.parquet(f"{tmp_path}/lines")
    vehicles = spark.createDataFrame([(3, "P100001"), (4, "P200001")], "id long, plate_number string")
    services = spark.createDataFrame([("Shop", "confirmed", None)], "name string, status string, created_by_user_id long")
    known = spark.createDataFrame([("historical_import:x",)], "reason string")
    out = []
    assert read(spark, lambda: out.extend(mutations.imported(spark.read.parquet(f"{tmp_path}/lines"), known, vehicles, services)["repairs"].collect())) < 2 * 2000
    assert [(r["vehicle_id"], r["service"], r["order_number"], r["mileage"], r["work_total"], r["parts_total"]) for r in out] == [(3, "Shop", "5", 7, 3000.0, 0.0)]


def test_a_plate_is_asked_once(spark):
    """Each row of an import asked for all beginnings of its plate."""
    plates = spark.range(0, 2000, 1, 4).selectExpr("id", "'P1000017' AS plate")
    vehicles = spark.createDataFrame([(1, "P100001"), (2, "P200001"), (3, "X")], "id long, plate_number string")
    assert shuffled(spark, lambda: resolve.vehicle_of_import(plates, vehicles).write.format("noop").mode("overwrite").save()) < 300
    assert {r["vehicle_id"] for r in resolve.vehicle_of_import(plates, vehicles).collect()} == {1}
    odd = spark.createDataFrame([(1, "P100001"), (2, "P100001"), (3, None), (4, ""), (5, "P20000"), (6, "X99999"), (7, "P3")], "id long, plate string")
    assert {r["id"]: r["vehicle_id"] for r in resolve.vehicle_of_import(odd, vehicles).collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: 2, 6: 3, 7: None}


def test_documents_are_no_groups_of_their_own(spark):
    """Each document was a group with a frame and a call of its own."""
    t = dt.datetime(2024, 1, 1)
    events = spark.range(5000).select(F.col("id").alias("document_id"), F.inline(F.array(*[F.struct(F.lit(n).alias("event_id"), F.lit(e).alias("event"), (F.lit(t) + F.expr(f"INTERVAL {n} MINUTES")).alias("at"), F.lit(None).cast("string").alias("error")) for n, e in (("1", "enqueue"), ("2", "start"), ("3", "fail"))])))
    out = jobs.history(events.unionByName(events))
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.groupBy("status").count().collect()} == {("queued", 5000), ("processing", 5000), ("failed", 5000)}
