"""Many patterns at once against one at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchfield.operators import resolve
from wrenchfield.operators.matching import occurrences


@pytest.mark.parametrize("most", [200_000, 7])
def test_occurrences(spark, most):
    rng = np.random.default_rng(1)
    texts = [(int(i) if i % 9 else None, "".join(rng.choice(list("abя "), int(rng.integers(0, 40))))) for i in range(80)] + [(5, None), (5, ""), (6, "x" * 100_000 + "ab")]
    patterns = sorted({"".join(rng.choice(list("abя"), int(rng.integers(1, 5)))) for _ in range(60)})
    got = occurrences(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in [*patterns, *patterns[:3], "", None]], "pattern string"), most)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, p) for i, t in texts for p in patterns if t and p in t), key=key)
    assert occurrences(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "pattern string"), most).count() == 0


def test_catalogues_by_any_first_rule(spark):
    vehicles = spark.createDataFrame([(1, "truck", "КамАЗ", "5490 NEO", "XTA123", 2015), (2, "trailer", "Schmitz", None, None, None), (3, None, None, "neo", "xta 999", 1999), (4, "truck", "MAN", "TGX", "", 2020)], "id long, vehicle_type string, brand string, model string, vin string, year int")
    rows = [
        ("brand", ["камаз", "man"], None, None, None, None, None, 1, True, "confirmed"), ("brand+model", ["КАМАЗ"], ["neo"], None, "truck", None, None, 1, True, "confirmed"), ("model", None, ["NEO", "tgx"], None, None, 2000, None, 1, True, "confirmed"),
        ("vin", None, None, ["XTA", "XTA1"], None, None, None, 1, True, "confirmed"), ("type", None, None, None, "truck", None, None, 1, True, "confirmed"), ("all", None, None, None, None, None, None, 1, True, "confirmed"), ("years", [], [], [], None, None, 2000, 1, True, "confirmed"), ("off", None, None, None, None, None, None, 1, False, "confirmed"),
    ]
    c = spark.createDataFrame(rows, "scope string, brand_keywords array<string>, model_keywords array<string>, vin_prefixes array<string>, vehicle_type string, year_from int, year_to int, priority int, auto_match boolean, status string")
    got = resolve.catalogue_matches(vehicles, c).groupBy("vehicle_id").agg(F.sort_array(F.collect_list("scope")).alias("s")).collect()
    assert {r["vehicle_id"]: r["s"] for r in got} == {1: ["all", "brand", "brand+model", "model", "type", "vin"], 2: ["all"], 3: ["all", "vin", "years"], 4: ["all", "brand", "model", "type"]}
