"""Imports, upserts and workflow as snapshots: a table and its changes in, the new table out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources import scratch

HISTORY_HEADERS = ("plate", "vehicle_kind", "period", "mileage", "supplier", "column", "registrar", "auto_group", "article", "expense_item", "vehicle_model", "nomenclature", "quantity", "amount")


def check_headers(df: DataFrame, wanted: tuple[str, ...] = HISTORY_HEADERS) -> DataFrame:
    if tuple(df.columns) != tuple(wanted):
        raise ValueError(f"headers differ: {df.columns}")
    return df


def import_lines(rows: DataFrame) -> DataFrame:
    """Rows of a history file (HISTORY_HEADERS, and row: their number), normalised, with the key of the repair that they belong
    to; those without a date belong to none and go."""
    day = text.imported_day(F.col("period"))
    part = lambda c: F.coalesce(F.nullif(text.identifier(F.col(c)), F.lit("")), F.lit("-"))
    out = rows.withColumn("day", day).where("day is not null")
    return out.select(
        "row", "plate", "supplier", "registrar", "day", F.concat_ws("|", part("plate"), part("supplier"), part("registrar"), F.col("day").cast("string")).alias("source_key"), text.imported_mileage(F.col("mileage")).alias("mileage"), F.nullif(F.trim("article"), F.lit("")).alias("article"),
        F.nullif(F.trim("nomenclature"), F.lit("")).alias("name"), text.quantity(F.col("quantity")).alias("quantity"), text.amount_or_zero(F.col("amount")).alias("line_total"), text.line_kind(F.col("expense_item"), F.col("auto_group"), F.coalesce("nomenclature", F.lit(""))).alias("kind"),
    ).withColumn("price", F.round(F.col("line_total") / F.col("quantity"), 2))


def imported(lines: DataFrame, repairs: DataFrame, vehicles: DataFrame, services: DataFrame) -> dict[str, DataFrame]:
    """What an import of import_lines() makes: repairs (by source_key), their lines, conflicts (keys that a repair already has,
    plates that find no vehicle) and services that aren't known yet."""
    from . import resolve

    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("line_total").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double")
    groups = lines.groupBy("source_key").agg(*(F.min_by(c, "row").alias(c) for c in ("plate", "supplier", "registrar", "day")), F.max("mileage").alias("mileage"), total("work").alias("work_total"), total("part").alias("parts_total"))
    groups = scratch.save(groups, "import-groups")  # lines are read and normalised once for all that follows
    new, known = new_and_known(groups, repairs)
    found = resolve.vehicle_of_import(new.select(F.col("source_key").alias("id"), "plate"), vehicles).withColumnRenamed("id", "source_key")
    placed = new.join(found, "source_key").withColumn("name", F.trim("supplier"))
    named = placed.where("name <> ''").select("name").distinct().withColumn("id", F.col("name"))
    shop = resolve.service_by_alias(named, services).select("name", "service")
    of = placed.where("vehicle_id is not null").join(shop, "name", "left")
    made = of.select("source_key", text.order_number_of_registrar(F.col("registrar")).alias("order_number"), F.col("day").alias("repair_date"), "vehicle_id", F.coalesce("service", F.nullif("name", F.lit(""))).alias("service"), "mileage", F.concat(F.lit("historical_import:"), "source_key").alias("reason"), "work_total", "parts_total", F.round(F.col("work_total") + F.col("parts_total"), 2).alias("grand_total"), F.lit("confirmed").alias("status"))
    conflicts = known.select("source_key", F.lit("duplicate").alias("why")).unionByName(placed.where("vehicle_id is null").select("source_key", F.lit("vehicle_not_found").alias("why")))
    return {"repairs": made, "lines": lines.join(made.select("source_key"), "source_key", "left_semi"), "conflicts": conflicts, "services": of.where("service is null and name <> ''").select("name").distinct()}


def import_groups(lines: DataFrame) -> DataFrame:
    """Imported lines to repairs: by plate, supplier, registrar and date; the greatest mileage, the first row's article, the
    lines in order of their rows (an array as long as a repair), totals."""
    rows = lines.withColumn("amount", F.coalesce(F.col("amount"), F.lit(0.0))).withColumn("quantity", text.quantity(F.col("quantity"))).withColumn("source_key", text.source_key(F.col("plate"), F.col("supplier"), F.col("registrar"), F.col("day")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "article"))), lambda x: F.coalesce(x["article"], F.lit("-")))
    return rows.groupBy("source_key").agg(F.max("mileage").alias("mileage"), F.count("*").alias("lines"), F.min_by("article", "row").alias("first_article"), F.array_join(ordered, ";").alias("articles"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


def new_and_known(incoming: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports not seen yet, and those whose source key a repair already carries (conflicts)."""
    known = repairs.where(F.col("reason").startswith("historical_import:")).select(F.substring("reason", len("historical_import:") + 1, 1 << 30).alias("source_key")).distinct()
    return incoming.join(known, "source_key", "left_anti"), incoming.join(known, "source_key", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New snapshot: the last row of each key wins, NULLs keep what was there; with the outcome of each row."""
    rest = [c for c in old.columns if c not in keys]
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").select(*keys, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(last, keys, "full")
    changed = [~F.coalesce(f"_{c}", c).eqNullSafe(F.col(c)) for c in rest]
    differs = changed[0]
    for c in changed[1:]:
        differs = differs | c
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull() | ~differs, "kept").otherwise("updated")
    return both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in rest], outcome.alias("outcome"))


def outcomes(upserted: DataFrame) -> DataFrame:
    return upserted.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "kept")])


def upsert_vehicles(old: DataFrame, new: DataFrame) -> DataFrame:
    """By external id, else VIN, else plate, within the type: the first key that finds a vehicle decides, the least id among
    those of one key. A row meets that vehicle only, not all that share its key."""
    hits = None
    for rank, key in enumerate(("external_id", "vin", "plate_number")):
        least = old.where(F.col("id").isNotNull()).groupBy("vehicle_type", key).agg(F.min("id").alias("id"))
        h = new.select("row", "vehicle_type", key).where(F.col(key).isNotNull()).join(least, ["vehicle_type", key]).select("row", "id", F.lit(rank).alias("rank"))
        hits = h if hits is None else hits.unionByName(h)
    found = hits.groupBy("row").agg(F.min(F.struct("rank", "id")).alias("x")).select("row", F.col("x.id").alias("id"))
    return new.join(found, "row", "left").select("row", "id", F.when(F.col("id").isNull(), "created").otherwise("updated").alias("outcome"))


def upserted_vehicles(old: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshot of vehicles (id, external_id, vehicle_type, vin, plate_number): a row of `new` that finds one
    (upsert_vehicles) changes it, the last row wins, NULLs keep what was there; other rows are added, their ids after the old ones."""
    c = ["external_id", "vin", "plate_number"]
    hit = upsert_vehicles(old, new).select("row", "id")
    rows = new.join(hit, "row")
    change = rows.where("id is not null").groupBy("id").agg(*(F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col("row"))).alias(f"_{x}") for x in c))
    kept = old.join(change, "id", "left").select("id", "vehicle_type", *(F.coalesce(f"_{x}", x).alias(x) for x in c))
    last = F.broadcast(old.agg(F.max("id").alias("_last")))  # one row
    added = rows.where("id is null").join(last).select((F.coalesce("_last", F.lit(0)) + 1 + F.col("row")).cast("long").alias("id"), "vehicle_type", *c)
    return kept.unionByName(added)


def upserted_catalogues(old: DataFrame, changes: dict[str, dict], norms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New snapshots of catalogues and of their norms: changes holds, for each scope, the fields that are set (NULL is a value;
    what isn't named stays, or is the default of a new catalogue); norms take over their catalogue's name and family."""
    fields = {"catalog_name": None, "brand_family": None, "vehicle_type": None, "year_from": None, "year_to": None, "priority": 100, "auto_match": True, "status": "confirmed"}
    kinds = {f: dict(old.dtypes)[f] for f in fields}
    spark = old.sparkSession
    rows = [(scope, *[v for f in fields for v in (f in set_, set_.get(f))]) for scope, set_ in changes.items()]
    ddl = "scope string, " + ", ".join(f"has_{f} boolean, new_{f} {kinds[f]}" for f in fields)
    both = old.withColumn("_old", F.lit(True)).join(F.broadcast(spark.createDataFrame(rows, ddl)), "scope", "full")  # a row of configuration each
    default = lambda f: F.col("scope") if f == "catalog_name" else F.lit(fields[f]).cast(kinds[f])
    out = both.select("scope", *[F.when(F.col(f"has_{f}"), F.col(f"new_{f}")).when(F.col("_old"), F.col(f)).otherwise(default(f)).alias(f) for f in fields])
    meta = out.select("scope", F.col("catalog_name").alias("_n"), F.col("brand_family").alias("_f"))
    synced = norms.join(meta, "scope", "left").withColumn("catalog_name", F.coalesce("_n", "catalog_name")).withColumn("brand_family", F.when(F.col("_n").isNotNull(), F.col("_f")).otherwise(F.col("brand_family"))).drop("_n", "_f")
    return out, synced


def replaced(old: DataFrame, new: DataFrame, key: str, also: str = "true") -> DataFrame:
    """Rows of the keys in `new` (those that `also` holds for) give way to new's."""
    keys = new.select(F.col(key).alias("_k")).distinct()
    return old.join(keys, (F.col(key) == F.col("_k")) & F.expr(also), "left_anti").unionByName(new)


def without(table: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """A cascading delete, table by table."""
    return table.join(gone.select(F.col(gone_key).alias(key)).distinct(), key, "left_anti")


def override(old: DataFrame, new: DataFrame, key: str, value: str, manual: str) -> DataFrame:
    """A synchronised value, unless it was set by hand."""
    n = new.select(key, F.col(value).alias("_v"))
    return old.join(n, key, "left").withColumn(value, F.when(F.col(manual), F.col(value)).otherwise(F.coalesce("_v", value))).drop("_v")


def enqueued(asked: DataFrame, latest: DataFrame) -> DataFrame:
    """What asking for a job does: an active one is reused, a failed one retried, else a new one is made."""
    j = latest.select("document_id", F.col("id").alias("job_id"), F.col("status").alias("was"))
    both = asked.join(j, "document_id", "left")
    action = F.when(F.col("was").isin("queued", "processing", "retry"), "reused").when((F.col("was") == "failed") & F.col("retry"), "retried").otherwise("created")
    return both.select("document_id", F.when(action != "created", F.col("job_id")).alias("job_id"), action.alias("action"))


def audit_rows(before: DataFrame, after: DataFrame, key: str, entity: str, user_id: int, at: dt.datetime) -> DataFrame:
    """An audit row with both snapshots for each row that differs."""
    a = before.select(F.col(key).alias("_k"), F.to_json(F.struct(*before.columns)).alias("old_value"))
    b = after.select(F.col(key).alias("_k"), F.to_json(F.struct(*after.columns)).alias("new_value"))
    both = a.join(b, "_k", "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return both.select(F.lit(user_id).alias("user_id"), F.lit(entity).alias("entity_type"), F.col("_k").cast("string").alias("entity_id"), F.when(F.col("old_value").isNull(), "create").when(F.col("new_value").isNull(), "delete").otherwise("update").alias("action_type"), "old_value", "new_value", F.lit(at).alias("created_at"))
