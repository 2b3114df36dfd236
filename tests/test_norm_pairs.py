"""Works and norms that share their tokens with many others."""

from __future__ import annotations

from test_pairs import shuffled

from wrenchfield.operators import resolve


def test_pairs_are_not_shuffled(spark):
    """Each pair was a row of a shuffle for each token that it shares."""
    works = spark.range(300).selectExpr("CAST(NULL AS STRING) AS code", "concat('oil pump no', CAST(id AS STRING)) AS name")
    norms = spark.range(100).selectExpr("'light' AS scope", "concat('N-', CAST(id AS STRING)) AS code", "'oil pump' AS name", "CAST(id AS DOUBLE) AS standard_hours", "'active' AS status")
    assert shuffled(spark, lambda: resolve.norm_scores(works, norms).write.format("noop").mode("overwrite").save()) < 3000
    assert resolve.norm_scores(works, norms).where("score = 0.8300 AND matched_by = 'name_contains'").count() == 30_000


def test_repeated_norms_count_once(spark):
    works = spark.createDataFrame([(None, "oil pump oil")], "code string, name string")
    norms = spark.createDataFrame([("light", "a", "pump seal", 1.0, "active"), ("light", "a", "pump seal", 1.0, "active")], "scope string, code string, name string, standard_hours double, status string")
    assert [r["score"] for r in resolve.norm_scores(works, norms, least=0.0).collect()] == [0.5]


def test_names_are_scored_once(spark):
    """A work was scored against each norm of a name, and against those that share a word only."""
    works = spark.range(300).selectExpr("CAST(NULL AS STRING) AS code", "concat('oil pump no', CAST(id AS STRING)) AS name")
    norms = spark.range(3000).selectExpr("'light' AS scope", "concat('N-', CAST(id AS STRING)) AS code", "CASE WHEN id < 2 THEN 'oil pump' ELSE concat('pump of kind seal ', CAST(id % 10 AS STRING), 'x') END AS name", "CAST(id AS DOUBLE) AS standard_hours", "'active' AS status")
    scores = resolve.norm_scores(works, norms)
    assert scores.count() == 600
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("token" in j for j in joins) and any("n_norm" in j and "token" not in j for j in joins)
