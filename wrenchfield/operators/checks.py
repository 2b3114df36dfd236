"""Checks of a parsed work order: plates, totals, hours, reasons for a manual review; signals to learn from; export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import resolve

#: Check types of reasons whose check isn't named after them, and all such checks' titles.
REASON_TYPES = {"service_name_missing": "ocr_service_missing", "image_ocr_unavailable": "ocr_image_backend_unavailable", "pdf_ocr_unavailable": "ocr_pdf_backend_unavailable"}
REASON_TITLES = {
    "vehicle_not_found": "Техника не найдена в базе", "vehicle_missing": "Не удалось определить технику", "service_not_found": "Сервис не найден в справочнике", "service_name_missing": "Не удалось определить сервис", "text_not_found": "Не удалось извлечь текст из документа",
    "image_ocr_unavailable": "OCR для изображений недоступен", "pdf_ocr_unavailable": "OCR для PDF-сканов недоступен", "pdf_renderer_unavailable": "Рендер PDF для OCR недоступен",
}
OTHER_REASON = "Нужна ручная проверка OCR"
#: The header's fields that corrections are learned from.
LEARNED = ("order_number", "repair_date", "mileage", "service_name", "work_total", "parts_total", "vat_total", "grand_total")


def _case(c: Column, values: dict[str, str], last: Column) -> Column:
    for k, v in values.items():
        last = F.when(c == k, v).otherwise(last)
    return last


def plate_mismatch(documents: DataFrame, repairs: DataFrame, vehicles: DataFrame) -> DataFrame:
    """documents (document_id, repair_id, plate_number) whose plate differs from their vehicle's, look-alike letters folded."""
    v = repairs.select(F.col("id").alias("repair_id"), "vehicle_id").join(vehicles.select(F.col("id").alias("vehicle_id"), F.col("plate_number").alias("vehicle_plate")), "vehicle_id")
    both = documents.join(v, "repair_id")
    a, b = text.compare_token(F.col("plate_number")), text.compare_token(F.col("vehicle_plate"))
    return both.where(a != b).select("document_id", "repair_id", "plate_number", "vehicle_plate", F.lit("ocr_vehicle_plate_mismatch").alias("check_type"), F.lit("warning").alias("severity"))


def total_checks(headers: DataFrame, sums: DataFrame) -> DataFrame:
    """headers (repair_id and the four totals) against sums of lines (repair_id, work_total, parts_total: NULL without lines):
    works that don't make their total, parts that don't, and totals that don't make the grand total (missing ones are 0)."""
    s = sums.select("repair_id", F.col("work_total").alias("_w"), F.col("parts_total").alias("_p"))
    made = F.round(F.coalesce("work_total", F.lit(0.0)) + F.coalesce("parts_total", F.lit(0.0)) + F.coalesce("vat_total", F.lit(0.0)), 2)
    one = lambda name, lines, header: F.when(lines != header, F.struct(F.lit(name).alias("check_type"), lines.alias("lines_total"), header.alias("header_total")))
    every = F.array_compact(F.array(one("ocr_work_lines_total_mismatch", F.col("_w"), F.col("work_total")), one("ocr_part_lines_total_mismatch", F.col("_p"), F.col("parts_total")), one("ocr_total_mismatch", made, F.col("grand_total"))))
    return headers.join(s, "repair_id", "left").select("repair_id", F.inline(every)).withColumn("severity", F.lit("suspicious"))


def reason_checks(reasons: DataFrame) -> DataFrame:
    """reasons (repair_id, reason) as checks: repair_id, reason, check_type, severity, title."""
    r = F.col("reason")
    return reasons.select("repair_id", "reason", _case(r, REASON_TYPES, F.concat(F.lit("ocr_"), r)).alias("check_type"), F.lit("warning").alias("severity"), _case(r, REASON_TITLES, F.lit(OTHER_REASON)).alias("title"))


def mileage_missing(repairs: DataFrame) -> DataFrame:
    """Imported repairs without mileage."""
    from .filters import is_historical

    return repairs.where(is_historical(F.col("reason")) & (F.coalesce("mileage", F.lit(0)) <= 0)).select(F.col("id").alias("repair_id"), F.lit("historical_mileage_missing").alias("check_type"), F.lit("warning").alias("severity"))


def processing_failed(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """A check for each document whose latest job failed (jobs: latest_job())."""
    failed = jobs.where("status = 'failed'").select("document_id")
    return documents.join(failed, documents["id"] == failed["document_id"], "left_semi").select("repair_id", F.col("id").alias("document_id"), F.lit("ocr_processing_failed").alias("check_type"), F.lit("error").alias("severity"))


def with_norms(works: DataFrame, choice: DataFrame, norms: DataFrame) -> DataFrame:
    """works (with code, name, vehicle_id) with the norm that their vehicle's catalogue has for them: norm_code, norm_name,
    norm_hours, norm_score, norm_by, and the code of the norm where they have none. choice: catalogue_choice()."""
    scoped = works.join(choice.where("scope is not null").select("vehicle_id", F.col("scope").alias("n_scope")), "vehicle_id", "left")
    asked = scoped.where("n_scope is not null").select("code", "name", "n_scope").distinct()
    scores = resolve.norm_scores(asked.select("code", "name").distinct(), norms)
    pairs = asked.select(F.col("code").alias("_c"), F.col("name").alias("_n"), F.col("n_scope").alias("_s"))
    own = scores.join(pairs, F.col("code").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n")) & (F.col("n_scope") == F.col("_s")), "left_semi")
    # names within a catalogue: two works of different catalogues are two questions
    best = resolve.best_norm(own, ["n_scope"])
    best = best.select(F.col("code").alias("_c"), F.col("name").alias("_n"), F.col("n_scope").alias("_s"), F.col("n_code").alias("norm_code"), F.col("n_name").alias("norm_name"), F.col("standard_hours").alias("norm_hours"), F.col("score").alias("norm_score"), F.col("matched_by").alias("norm_by"))
    both = scoped.join(best, F.col("code").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n")) & (F.col("n_scope") == F.col("_s")), "left")
    return both.withColumn("code", F.coalesce("code", "norm_code")).drop("_c", "_n", "_s")


def hours_checks(works: DataFrame) -> DataFrame:
    """works (quantity, unit, standard_hours, actual_hours, norm_hours): actual hours (a quantity in hours, if there are none)
    above 1.1 times the document's norm, or else the catalogue's; a document's norm above the catalogue's."""
    actual = F.coalesce("actual_hours", F.when(F.col("unit").isin("нч", "ч"), F.col("quantity")))
    norm = F.coalesce("standard_hours", "norm_hours")
    exceeded = F.when((norm > 0) & (actual > F.round(norm * 1.1, 2)), F.struct(F.lit("ocr_standard_hours_exceeded").alias("check_type"), actual.alias("hours"), norm.alias("norm")))
    above = F.when(F.col("standard_hours") - F.col("norm_hours") > 0.01, F.struct(F.lit("ocr_document_standard_hours_exceeded").alias("check_type"), F.col("standard_hours").alias("hours"), F.col("norm_hours").alias("norm")))
    return works.select("repair_id", "part_id", "line_no", F.inline(F.array_compact(F.array(exceeded, above)))).withColumn("severity", F.lit("suspicious"))


def export_warnings(checks: DataFrame, reasons: DataFrame) -> DataFrame:
    """Rows of a repair's warning sheet: its checks, and the reasons (repair_id, reason) that no check stands for."""
    of = lambda df, source, done: df.select("repair_id", text.report_section(F.col("check_type")).alias("section"), "severity", "title", F.lit(source).alias("source"), done.alias("is_resolved"))
    seen = checks.where(F.col("check_type").startswith("ocr_")).select("repair_id", F.substring("check_type", 5, 1 << 30).alias("reason")).distinct()
    rest = reason_checks(reasons.distinct().join(seen, ["repair_id", "reason"], "left_anti"))
    return of(checks, "check", F.col("is_resolved")).unionByName(of(rest, "manual_review_reason", F.lit(False)))


def _shown(df: DataFrame, c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))) if dict(df.dtypes)[c] == "double" else F.col(c).cast("string")


def learning_signals(corrected: DataFrame, extracted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """repair_id, field, signal_type, extracted, corrected: header fields (LEARNED) that were corrected by hand: missing in, or
    other than, what was read. Signals that are known (repair_id, field, extracted, corrected) are not made again."""
    long = lambda df, name: df.select("repair_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(_shown(df, f), F.lit("")).alias(name)) for f in LEARNED])))
    both = long(corrected, "corrected").where("corrected is not null").join(long(extracted, "extracted"), ["repair_id", "field"])
    out = both.where(~F.col("extracted").eqNullSafe(F.col("corrected"))).withColumn("signal_type", F.when(F.col("extracted").isNull(), "missing").otherwise("mismatch"))
    if known is not None:
        k = known.select(*[F.col(c).alias(f"_{c}") for c in ("repair_id", "field", "extracted", "corrected")])
        out = out.join(k, (F.col("repair_id") == F.col("_repair_id")) & (F.col("field") == F.col("_field")) & F.col("extracted").eqNullSafe(F.col("_extracted")) & (F.col("corrected") == F.col("_corrected")), "left_anti")
    return out


#: Labels that stand before a field's value.
HINTS = {
    "order_number": r"(?:заказ[\s-]*наряд|наряд[\s-]*заказ|№|N|#)", "repair_date": "(?:дата|от)", "mileage": "(?:пробег|одометр)", "service_name": "(?:сервис|сто|исполнитель|подрядчик)", "work_total": r"(?:работы[\s-]*итого|стоимость[\s-]*работ|итого[\s-]*работ)",
    "parts_total": r"(?:запчасти[\s-]*итого|материалы[\s-]*итого|стоимость[\s-]*запчастей|стоимость[\s-]*материалов)", "vat_total": "(?:ндс)", "grand_total": r"(?:итого[\s-]*к[\s-]*оплате|к[\s-]*оплате|итого|всего)",
}


def draft_rules(signals: DataFrame) -> DataFrame:
    """signals (field, corrected) with a draft of a rule: the pattern of the value after its label, and its parser."""
    escaped = F.regexp_replace(F.regexp_replace(F.trim("corrected"), r"([^\p{L}\p{N}_\s])", r"\\$1"), r"\s+", r"\\s+")
    prefix = _case(F.col("field"), {k: f"(?:{v})" + r"[^\n\r\dA-Za-zА-Яа-я]{0,20}" for k, v in HINTS.items()}, F.lit(""))
    parser = F.when(F.col("field") == "repair_date", "date").when(F.col("field") == "mileage", "digits_int").when(F.col("field").endswith("_total"), "amount").otherwise("raw")
    return signals.withColumn("pattern", F.concat(prefix, F.lit("("), escaped, F.lit(")"))).withColumn("parser", parser)


def queue_items(documents: DataFrame, repairs: DataFrame, checks: DataFrame, rules: DataFrame) -> DataFrame:
    """id, issues, issue_count, unresolved, blocking of documents with a repair: the titles of their status's rules, of their
    reasons, and of the open checks (latest first), each once. Of a repair's checks, as many are collected as have a title of their own."""
    names = F.broadcast(rules.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "rule_type", "code"), "title"))).alias("_t")))  # a small table, one row
    open_ = checks.where(~F.col("is_resolved"))
    counts = open_.groupBy("repair_id").agg(F.count("*").alias("unresolved"), F.count_if(F.col("severity").isin("suspicious", "error")).alias("blocking"))
    titles = open_.groupBy("repair_id", "title").agg(F.max(F.struct("created_at", "id")).alias("at")).groupBy("repair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "title")), asc=False), lambda x: x["title"]).alias("_c"))
    r = repairs.select(F.col("id").alias("_r"), F.col("status").alias("_rs"))
    d = documents.join(r, documents["repair_id"] == r["_r"]).join(names).join(counts, "repair_id", "left").join(titles, "repair_id", "left")
    rule = lambda kind, code: F.try_element_at("_t", F.concat(F.lit(kind + ":"), code))
    reason = lambda c: F.coalesce(rule("manual_review_reason", c), F.replace(c, F.lit("_"), F.lit(" ")))
    own = F.array(rule("document_status", F.col("status")), rule("repair_status", F.col("_rs")), *[F.when(F.col(c).isNotNull(), reason(F.col(c))) for c in ("reason_1", "reason_2")])
    issues = F.array_distinct(F.array_compact(F.concat(own, F.coalesce("_c", F.array().cast("array<string>")))))
    return d.select("id", F.array_join(issues, ";").alias("issues"), F.size(issues).alias("issue_count"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"), F.coalesce("blocking", F.lit(0)).alias("blocking"))


def history(audit: DataFrame, entity: str, ids: DataFrame, users: DataFrame) -> DataFrame:
    """Audit rows about the entities of ids (id), with the user's name."""
    k = ids.select(F.col("id").cast("string").alias("entity_id"), F.col("id").alias("of")).distinct()
    u = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("user_name"))
    return audit.where(F.col("entity_type") == entity).join(k, "entity_id").join(u, "user_id", "left").select("of", "id", "created_at", "action_type", "user_name")


def storage_keys(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """repair_id, key: of documents and of their versions, each once."""
    v = versions.join(documents.select(F.col("id").alias("document_id"), "repair_id"), "document_id").select("repair_id", F.col("source_path").alias("key"))
    return documents.select("repair_id", F.col("original_filename").alias("key")).union(v).where("key is not null").distinct()


def resolved_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """New snapshot of conflicts: decisions (id, status: resolved or ignored, comment) take effect, unknown statuses don't."""
    d = decisions.select("id", F.lower(F.trim("status")).alias("_s"), F.nullif(F.trim(F.coalesce("comment", F.lit(""))), F.lit("")).alias("_c")).where(F.col("_s").isin("resolved", "ignored"))
    return conflicts.join(d, "id", "left").withColumn("status", F.coalesce("_s", "status")).withColumn("comment", F.col("_c")).drop("_s", "_c")


def finished_jobs(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """New snapshot of jobs: results (id, error, summary: a map) end them: failed with an error, completed without; the
    summary's entries replace those that were there."""
    r = results.select("id", F.lit(True).alias("_done"), "error", F.col("summary").alias("_new"))
    both = jobs.join(r, "id", "left")
    stage = F.create_map(F.lit("stage"), F.when(F.col("error").isNull(), "completed").otherwise("failed"))
    new = F.map_concat(F.coalesce("_new", F.create_map().cast("map<string,string>")), stage)
    merged = F.map_concat(F.map_filter(F.col("summary"), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return both.withColumn("status", F.when(F.col("_done"), F.when(F.col("error").isNull(), "completed").otherwise("failed")).otherwise(F.col("status"))).withColumn("error_message", F.when(F.col("_done"), F.col("error"))).withColumn("summary", F.when(F.col("_done"), merged).otherwise(F.col("summary"))).drop("_done", "error", "_new")


def relinked(repairs: DataFrame, documents: DataFrame, matches: DataFrame, vehicles: DataFrame, placeholder: str) -> DataFrame:
    """repairs of the placeholder vehicle with the vehicle that their document's plate or VIN finds (matches: id of the document, vehicle_id)."""
    stand_in = vehicles.where(F.col("external_id") == placeholder).select(F.col("id").alias("_p"))
    m = documents.select("id", "repair_id").join(matches.where("vehicle_id is not null"), "id").groupBy("repair_id").agg(F.min_by("vehicle_id", "id").alias("_v"))
    both = repairs.join(F.broadcast(stand_in), repairs["vehicle_id"] == F.col("_p"), "left").join(m.withColumnRenamed("repair_id", "_r"), repairs["id"] == F.col("_r"), "left")
    return both.withColumn("vehicle_id", F.when(F.col("_p").isNotNull(), F.coalesce("_v", "vehicle_id")).otherwise(F.col("vehicle_id"))).drop("_p", "_v", "_r")


def primary_switched(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """New snapshot of documents: the chosen one (id) of a repair is its only primary one."""
    c = documents.join(chosen.select("id"), "id", "left_semi").groupBy("repair_id").agg(F.max("id").alias("_c"))
    return documents.join(c, "repair_id", "left").withColumn("is_primary", F.when(F.col("_c").isNotNull(), F.col("id") == F.col("_c")).otherwise(F.col("is_primary"))).drop("_c")


def service_assigned(checks: DataFrame, repairs: DataFrame) -> DataFrame:
    """New snapshot of checks after services were set or cleared (repairs: repair_id, service_id): "not found" is settled
    either way, "missing" by a service only; a repair without one gets the check if it hasn't it."""
    r = repairs.select("repair_id", F.col("service_id").isNotNull().alias("_s"))
    own = F.col("check_type").isin("ocr_service_not_found", "ocr_service_missing")
    out = checks.join(r, "repair_id", "left").withColumn("is_resolved", F.when(own & F.col("_s").isNotNull(), F.col("_s") | (F.col("check_type") == "ocr_service_not_found")).otherwise(F.col("is_resolved"))).drop("_s")
    has = checks.where("check_type = 'ocr_service_missing'").select("repair_id").distinct()
    new = r.where(~F.col("_s")).join(has, "repair_id", "left_anti").select("repair_id", F.lit("ocr_service_missing").alias("check_type"), F.lit("warning").alias("severity"), F.lit(False).alias("is_resolved"), F.lit(REASON_TITLES["service_name_missing"]).alias("title"))
    return out.unionByName(new, allowMissingColumns=True)
