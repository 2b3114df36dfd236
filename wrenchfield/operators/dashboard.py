"""Summaries, lists, search and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filters


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))  # one row each
    return out


def summary(vehicles: DataFrame, repairs: DataFrame, documents: DataFrame) -> DataFrame:
    return beside(
        vehicles.agg(F.count("*").alias("vehicles_total")),
        repairs.agg(F.count("*").alias("repairs_total"), F.count_if(F.col("status") == "suspicious").alias("repairs_suspicious"), F.count_if(F.col("status").isin("in_review")).alias("repairs_open")),
        documents.agg(F.count("*").alias("documents_total"), F.count_if(F.col("status").isin("uploaded", "needs_review", "partially_recognized", "ocr_error")).alias("documents_queue")),
    )


def data_quality(documents: DataFrame, repairs: DataFrame, services: DataFrame, conflicts: DataFrame) -> DataFrame:
    d = documents.agg(
        F.round(F.avg("ocr_confidence"), 6).alias("average_confidence"), F.count_if(filters.low_confidence(F.col("ocr_confidence"))).alias("documents_low_confidence"), F.count_if(F.col("status") == "ocr_error").alias("documents_ocr_error"),
        F.count_if(F.col("status") == "needs_review").alias("documents_needs_review"), F.count_if(F.col("status") == "partially_recognized").alias("documents_partial"),
    )
    r = repairs.agg(F.count_if("is_partially_recognized").alias("repairs_partial"), F.count_if(F.col("status") == "suspicious").alias("repairs_suspicious"))
    s = services.where("status = 'preliminary'").select(F.col("id").alias("service_id"))
    used = repairs.join(s, "service_id", "left_semi").agg(F.countDistinct("service_id").alias("services_preliminary"))
    return beside(d, r, used, conflicts.agg(F.count_if(F.col("status") == "pending").alias("conflicts_pending")))


def services_in_use(services: DataFrame, repairs: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Services, also those without repairs, most repairs first; never used dates come first among equals."""
    r = repairs.select("service_id", F.col("id").alias("repair_id"), "repair_date")
    rows = services if status is None else services.where(F.col("status") == status)
    out = rows.join(r, rows["id"] == r["service_id"], "left").groupBy("id", "name", "city").agg(F.countDistinct("repair_id").alias("repairs_total"), F.max("repair_date").alias("last_repair_date"))
    out = out.orderBy(F.desc("repairs_total"), F.desc_nulls_first("last_repair_date"), "name")
    return out if limit is None else out.limit(limit)


def vehicle_history(repairs: DataFrame, documents: DataFrame) -> DataFrame:
    d = documents.groupBy("repair_id").agg(F.count("*").alias("docs"))
    r = repairs.join(d, repairs["id"] == d["repair_id"], "left")
    return r.groupBy("vehicle_id").agg(
        F.count("*").alias("repairs_total"), F.coalesce(F.sum("docs"), F.lit(0)).alias("documents_total"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.count_if(F.col("status") == "suspicious").alias("suspicious"),
        F.max("repair_date").alias("last_repair_date"), F.max_by("mileage", F.struct("repair_date", "id")).alias("last_mileage"),
    )


def historical_summary(repairs: DataFrame) -> DataFrame:
    h = repairs.where(filters.is_historical(F.col("reason")))
    return h.groupBy("vehicle_id").agg(F.count("*").alias("repairs_total"), F.countDistinct("service_id").alias("services_total"), F.sum(F.col("grand_total").cast("decimal(18,2)")).cast("double").alias("total_spend"), F.min("repair_date").alias("first_date"), F.max("repair_date").alias("last_date"), F.max_by("mileage", F.struct("repair_date", "id")).alias("last_mileage"))


def search_repairs(repairs: DataFrame, vehicles: DataFrame, services: DataFrame, lines: DataFrame, q: str) -> DataFrame:
    """Repairs whose own columns, vehicle, service, works or parts hold the query. Lines are searched once and joined as a flag."""
    hit = lines.where(filters.ilike_any(q, F.col("name"), F.col("code"))).select(F.col("repair_id").alias("_l")).distinct().withColumn("_hit", F.lit(True))
    v = vehicles.select(F.col("id").alias("_v"), "plate_number", "vin", "brand", "model")
    s = services.select(F.col("id").alias("_s"), F.col("name").alias("service_name"))
    both = repairs.join(v, repairs["vehicle_id"] == v["_v"], "left").join(s, repairs["service_id"] == s["_s"], "left").join(hit, repairs["id"] == hit["_l"], "left")
    own = filters.ilike_any(q, *[F.col(c) for c in ("order_number", "reason", "plate_number", "vin", "brand", "model", "service_name")])
    found = both.where(own | F.coalesce("_hit", F.lit(False)))
    by = filters.matched_by(q, order_number=F.col("order_number"), reason=F.col("reason"), plate_number=F.col("plate_number"), vin=F.col("vin"), service_name=F.col("service_name"))
    return found.withColumn("matched_by", F.array_join(by, ",")).drop("_v", "_s", "_l", "_hit")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order; only offset + limit rows of each partition travel."""
    return df.orderBy(*order).offset(offset).limit(limit)


def visible_audit(audit: DataFrame, user_id: int, repairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Own entries, and those about repairs, documents and vehicles that the user sees: ids are strings here."""
    def flag(df: DataFrame, kind: str, c: str) -> DataFrame:
        return df.select(F.lit(kind).alias("entity_type"), F.col(c).cast("string").alias("entity_id")).distinct()

    seen = flag(repairs, "repair", "id").unionByName(flag(documents, "document", "id")).unionByName(flag(repairs, "vehicle", "vehicle_id")).withColumn("_seen", F.lit(True))
    both = audit.join(seen, ["entity_type", "entity_id"], "left")
    return both.where((F.col("user_id") == user_id) | F.col("_seen")).drop("_seen")


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """facet, value, n of each column's values."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def compared_documents(pairs: DataFrame, extracted: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields of two documents (pairs: left_id, right_id; extracted: document_id and the fields), as shown, and whether they differ."""
    shown = lambda c: F.format_string("%.2f", F.col(c)) if dict(extracted.dtypes)[c] == "double" else F.col(c).cast("string")
    side = lambda name: extracted.select(F.col("document_id").alias(f"{name}_id"), F.array(*[F.when(F.col(f).isNotNull(), shown(f)) for f in fields]).alias(name))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    rows = both.select("left_id", "right_id", F.inline(F.arrays_zip(F.array(*[F.lit(f) for f in fields]).alias("field"), F.col("left"), F.col("right"))))
    return rows.withColumn("is_different", ~F.col("left").eqNullSafe(F.col("right")))


def sections(**frames: DataFrame) -> DataFrame:
    """A page of several lists as rows: section, place, id, label, n. Each frame has id, label and n in its order, and is a page itself."""

    out = None
    for name, df in frames.items():
        place = F.row_number().over(Window.orderBy("_at"))  # a page's rows, no more
        rows = df.withColumn("_at", F.monotonically_increasing_id()).select(F.lit(name).alias("section"), place.alias("place"), F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), F.col("n").cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def data_quality_lists(documents: DataFrame, repairs: DataFrame, checks: DataFrame, services: DataFrame, conflicts: DataFrame, limit: int = 8) -> DataFrame:
    """The five lists behind the data-quality numbers: documents to look at, partial and suspicious repairs, provisional
    services in use, pending conflicts."""
    limit = filters.clamp(limit, 1, 25)
    d = documents.where(filters.needs_attention(F.col("status"), F.col("ocr_confidence"), ["uploaded", "needs_review", "partially_recognized", "ocr_error"]))
    open_ = checks.where(~F.col("is_resolved")).groupBy(F.col("repair_id").alias("_r")).agg(F.count("*").alias("n"))
    r = repairs.join(open_, repairs["id"] == open_["_r"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    take = lambda df, order, label, n: page(df, order, 0, limit).select("id", F.col(label).alias("label"), n.alias("n"))
    by_date = [F.desc("repair_date"), F.desc("id")]
    return sections(
        documents=take(d, [F.desc("review_queue_priority"), F.desc("id")], "status", F.col("review_queue_priority")),
        partial=take(r.where("is_partially_recognized"), by_date, "order_number", F.col("n")),
        suspicious=take(r.where("status = 'suspicious'"), [F.desc("n"), *by_date], "order_number", F.col("n")),
        services=services_in_use(services, repairs, "preliminary", limit).select("id", F.col("name").alias("label"), F.col("repairs_total").alias("n")),
        conflicts=take(conflicts.where("status = 'pending'"), [F.desc("id")], "conflict_key", F.col("import_job_id")),
    )


def global_search(repairs: DataFrame, documents: DataFrame, vehicles: DataFrame, services: DataFrame, lines: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Repairs, documents and vehicles that hold the query: a page of each, with what they were found by, and all totals."""
    r = search_repairs(repairs, vehicles, services, lines, q)
    d = documents.where(filters.ilike_any(q, F.col("original_filename"), F.col("source"))).withColumn("matched_by", F.array_join(filters.matched_by(q, original_filename=F.col("original_filename"), source=F.col("source")), ","))
    names = ("external_id", "plate_number", "vin", "brand", "model")
    v = vehicles.where(filters.ilike_any(q, *[F.col(c) for c in names])).withColumn("matched_by", F.array_join(filters.matched_by(q, **{c: F.col(c) for c in names}), ","))
    top = lambda df, *order: page(df, [*order], 0, limit).select("id", F.col("matched_by").alias("label"), F.lit(1).alias("n"))
    total = lambda df: df.agg(F.count("*").alias("n")).select(F.lit("all").alias("id"), F.lit("total").alias("label"), "n")
    return sections(repairs=top(r, F.desc("repair_date"), F.desc("id")), documents=top(d, F.desc("id")), vehicles=top(v, F.asc("id")), repairs_total=total(r), documents_total=total(d), vehicles_total=total(v))


def nested(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Each parent with its children as arrays, each child aggregated before it is joined, so that none multiplies another."""
    for name, child in children.items():
        rest = [c for c in child.columns if c != key]
        parents = parents.join(child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    return parents


def learning_summaries(signals: DataFrame) -> DataFrame:
    """field, profile, kind with their number and the first three services (in order of name). Names are counted first, so that
    only those that are shown are collected."""
    keys = ["target_field", "profile", "signal_type"]
    each = signals.groupBy(*keys, "service_name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("service_name")))
    shown = F.when((F.col("rank") <= 3) & F.col("service_name").isNotNull(), F.struct("rank", "service_name"))
    out = each.withColumn("rank", rank).groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(shown)).alias("x"))
    return out.select(*keys, "n", F.array_join(F.transform("x", lambda x: x["service_name"]), ";").alias("examples"))


def bars(total: Column, draft: Column, suspicious: Column) -> Column:
    """Named bars, zero ones left out; confirmed is what remains."""
    every = F.array(*[F.struct(F.lit(n).alias("bar"), v.cast("long").alias("value")) for n, v in (("confirmed", F.greatest(F.lit(0), total - draft - suspicious)), ("draft", draft), ("suspicious", suspicious))])
    return F.filter(every, lambda x: x["value"] > 0)


def changed_fields(old: Column, new: Column) -> Column:
    """Keys whose values differ between two maps."""
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(old), F.map_keys(new))))
    return F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
