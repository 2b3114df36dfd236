"""First, last and best rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order; Spark cuts the groups before they travel."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def latest_version(versions: DataFrame) -> DataFrame:
    return best(versions, ["document_id"], F.desc("version_number"), F.desc("id"))


def latest_job(jobs: DataFrame) -> DataFrame:
    return best(jobs, ["document_id"], F.desc("id"))


def latest_path(versions: DataFrame) -> DataFrame:
    return versions.where("source_path <> ''").groupBy("document_id").agg(F.max_by("source_path", "version_number").alias("source_path"))


def sibling_profile(documents: DataFrame, versions: DataFrame, group: str) -> DataFrame:
    """For each document, the profile of the latest version of another document of its group. The two latest documents of a group answer for all."""
    last = latest_version(versions).select("document_id", "profile", F.col("id").alias("version_id"))
    rows = documents.select("id", group).join(last, documents["id"] == last["document_id"]).select("id", group, "profile", "version_id")
    two = rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("version_id")))).where("n <= 2").groupBy(group).agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("n") == 1, F.col("profile"))).alias("p1"), F.max(F.when(F.col("n") == 2, F.col("profile"))).alias("p2"))
    return documents.select("id", group).join(two, group, "left").select("id", F.when(F.col("first") == F.col("id"), F.col("p2")).otherwise(F.col("p1")).alias("sibling_profile"))


def primary_document(documents: DataFrame, group: str, source: DataFrame | None = None) -> DataFrame:
    """The source document of the group (source: group, source_document_id) first, then those marked as primary, then the least id."""
    if source is None:
        return best(documents, [group], F.desc("is_primary"), F.asc("id"))
    s = source.select(F.col(group).alias("_g"), F.col("source_document_id").alias("_s"))
    ranked = documents.join(s, F.col(group) == F.col("_g"), "left").withColumn("_first", F.coalesce(F.col("id") == F.col("_s"), F.lit(False)))
    return best(ranked, [group], F.desc("_first"), F.desc("is_primary"), F.asc("id")).drop("_g", "_s", "_first")


def replacement_primary(documents: DataFrame, group: str) -> DataFrame:
    """The newest order or repeat scan that isn't archived and isn't the primary itself."""
    p = primary_document(documents, group).select(F.col(group).alias("_g"), F.col("id").alias("primary_id"))
    rest = documents.where(F.col("kind").isin("order", "repeat_scan") & (F.col("status") != "archived")).join(p, F.col(group) == F.col("_g")).where("id <> primary_id")
    return best(rest, [group], F.desc("id")).select(group, "primary_id", F.col("id").alias("replacement_id"))


def next_version(documents: DataFrame, versions: DataFrame) -> DataFrame:
    v = versions.groupBy("document_id").agg(F.max("version_number").alias("last"))
    return documents.select("id").join(v, documents["id"] == v["document_id"], "left").select("id", (F.coalesce("last", F.lit(0)) + 1).alias("next_version"))


def first_and_last(repairs: DataFrame) -> DataFrame:
    at = F.struct("repair_date", "id")
    return repairs.groupBy("vehicle_id").agg(F.min_by("id", at).alias("first_repair"), F.max_by("id", at).alias("last_repair"))


def since_previous(repairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("vehicle_id").orderBy("repair_date", "id")
    return repairs.select("id", "vehicle_id", F.datediff("repair_date", F.lag("repair_date").over(w)).alias("days_since_previous"))
