"""Vehicles that many others are like: they are counted, and pairs are not shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wrenchfield.operators import filters, resolve

N = 300


def shuffled(spark, action) -> int:
    """Records that the stages of an action write to shuffles."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


@pytest.fixture(scope="module")
def alike(spark):
    """One VIN and one plate for all."""
    rows = spark.range(N).select("id", F.lit("VIN1").alias("vin"), F.lit("P100000").alias("plate"))
    return rows, rows.withColumnRenamed("plate", "plate_number").withColumn("external_id", F.lit("x"))


@pytest.mark.parametrize("of", [resolve.vehicle_by_vin_or_plate, lambda a, v: resolve.vehicle_or_conflict(a, v, filters.PLACEHOLDER), resolve.vehicle_of_import])
def test_no_vehicle_meets_a_question(spark, alike, of):
    """Each question met each vehicle with its VIN, plate or beginning."""
    assert shuffled(spark, lambda: of(*alike).collect()) < 30 * N
    assert {tuple(r)[1] for r in of(*alike).collect()} == {None}


def test_vehicles_of_either_are_counted_once(spark):
    v = spark.createDataFrame([(1, "V1", "P100000", "x"), (1, "V1", "P100000", "x"), (2, "V2", "P200000", "x"), (3, None, "P2000001", "x"), (4, "V4", None, "x")], "id long, vin string, plate_number string, external_id string")
    a = spark.createDataFrame([(1, "V1", "P100000"), (2, "V1", "P200000"), (3, None, "P20000"), (4, "V4", None), (5, None, "P10000099"), (6, None, None)], "id long, vin string, plate string")
    assert sorted(map(tuple, resolve.vehicle_by_vin_or_plate(a, v).collect())) == [(1, 1, 1), (2, None, 2), (3, None, 0), (4, 4, 1), (5, 1, 0), (6, None, 0)]
    assert sorted(map(tuple, resolve.vehicle_or_conflict(a, v, filters.PLACEHOLDER).collect())) == [(1, 1, False), (2, None, True), (3, None, False), (4, 4, False), (5, None, False), (6, None, False)]
