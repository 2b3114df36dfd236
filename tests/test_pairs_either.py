"""Pairs alike in one of two keys."""

from __future__ import annotations

from test_pairs import N, alike, shuffled  # noqa: F401

from wrenchfield.operators import resolve


def test_pairs_are_not_shuffled(spark, alike):  # noqa: F811
    v = alike[1].select("id", "vin", "plate_number")
    assert shuffled(spark, lambda: resolve.or_equi(v, v, ["vin", "plate_number"], "id").write.format("noop").mode("overwrite").save()) < 30 * N
    assert resolve.or_equi(v, v, ["vin", "plate_number"], "id").count() == N * N


def test_an_id_of_several_rows_gives_each_pair_once(spark):
    v = spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (2, "a", "q"), (3, None, "q")], "id long, vin string, plate string")
    assert sorted(map(tuple, resolve.or_equi(v, v, ["vin", "plate"], "id").collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]
