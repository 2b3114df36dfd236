"""Review queue, scores, categories, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

CATEGORIES = ("all", "suspicious", "ocr_error", "partial_recognition", "employee_confirmation", "manual_review")
BUCKETS = ("review", "critical", "suspicious")


def ordinal(c: Column, of: tuple[str, ...]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in of]), c), F.lit(0)) - 1, F.lit(0)).cast("int")  # unknown ones are the first


def open_checks(checks: DataFrame) -> DataFrame:
    """Numbers of a repair's open checks, and their distinct titles, which are brought together before they are collected."""
    each = checks.where(~F.col("is_resolved")).groupBy("repair_id", "title").agg(F.count_if(F.col("severity") == "suspicious").alias("s"), F.count_if(F.col("severity") == "error").alias("e"), F.count("*").alias("n"))
    return each.groupBy("repair_id").agg(F.sum("s").alias("open_suspicious"), F.sum("e").alias("open_errors"), F.sum("n").alias("open_checks"), F.array_join(F.array_sort(F.collect_list("title")), ";").alias("titles"))


def priority(documents: DataFrame, repairs: DataFrame, checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Score, bucket and category of each document with a repair. The rules are a small table, pivoted into one row of weights
    and one of buckets, and looked up as maps."""
    maps = rules.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "rule_type", "code"), F.col("weight")))).alias("w"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "rule_type", "code"), F.coalesce(F.col("bucket_override"), F.lit("review"))))).alias("o"))
    r = repairs.select(F.col("id").alias("_r"), F.col("status").alias("repair_status"), "is_partially_recognized")
    d = documents.join(r, documents["repair_id"] == r["_r"]).drop("_r").join(open_checks(checks), "repair_id", "left").join(F.broadcast(maps))
    weight = lambda kind, code: F.coalesce(F.try_element_at("w", F.concat(F.lit(kind + ":"), code)), F.lit(0))
    level = lambda kind, code: ordinal(F.coalesce(F.try_element_at("o", F.concat(F.lit(kind + ":"), code)), F.lit("review")), BUCKETS)
    on = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(F.lit(0))
    failed = (F.col("status") == "ocr_error") | (F.col("repair_status") == "ocr_error")
    reasons = F.filter(F.array("reason_1", "reason_2"), lambda x: x.isNotNull())
    terms = [  # (applies, kind, code)
        (F.col("repair_status") == "suspicious", "repair_status", F.lit("suspicious")), (F.col("open_suspicious") > 0, "check_severity", F.lit("suspicious")), (F.col("open_errors") > 0, "check_severity", F.lit("error")),
        (failed, "document_status", F.lit("ocr_error")), (F.col("status") != "ocr_error", "document_status", F.col("status")), (F.col("repair_status").isin("in_review", "employee_confirmed"), "repair_status", F.col("repair_status")),
        (F.col("is_partially_recognized"), "signal", F.lit("repair_partial")),
    ]
    score = F.col("review_queue_priority")
    for test, kind, code in terms:
        score = score + on(test, weight(kind, code))
    of_reasons = F.least(F.aggregate(reasons, F.lit(0), lambda a, x: a + weight("manual_review_reason", x)), weight("signal", F.lit("manual_review_cap")))
    of_confidence = on(F.col("ocr_confidence").isNotNull(), F.greatest(F.lit(0), F.bround((1 - F.col("ocr_confidence")) * weight("signal", F.lit("low_ocr_confidence")), 0).cast("int")))
    bucket = F.greatest(*[on(test, level(kind, code)) for test, kind, code in terms], F.array_max(F.transform(F.concat(F.array(F.lit("-")), reasons), lambda x: level("manual_review_reason", x))))
    category = F.when((F.col("repair_status") == "suspicious") | (F.coalesce(F.col("open_suspicious") + F.col("open_errors"), F.lit(0)) > 0), "suspicious").when(failed, "ocr_error").when(F.col("repair_status") == "employee_confirmed", "employee_confirmation").when((F.col("status") == "partially_recognized") | F.col("is_partially_recognized"), "partial_recognition").otherwise("manual_review")
    return d.select("*", (score + of_reasons + of_confidence).cast("long").alias("score"), F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), bucket + 1).alias("bucket"), category.alias("category")).drop("w", "o")


def category_counts(scored: DataFrame) -> DataFrame:
    """A row for each category, and for all, also where there are none."""
    spark = scored.sparkSession
    counts = scored.groupBy("category").agg(F.count("*").alias("n")).unionByName(scored.agg(F.count("*").alias("n")).withColumn("category", F.lit("all")))
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string").join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def queue(scored: DataFrame, category: str = "all", offset: int = 0, limit: int = 100) -> DataFrame:
    rows = scored if category == "all" else scored.where(F.col("category") == category)
    return rows.orderBy(F.desc("score"), F.desc(F.coalesce("open_suspicious", F.lit(0))), F.desc("id")).offset(offset).limit(limit)


# --- the executive report

LEVELS = ("low", "medium", "high")
#: Names of the report's zones, by section.
ZONES = {"catalogs": "Справочники и идентификация", "labor_norms": "Нормо-часы", "amounts": "Суммы и структура", "history": "История и аномалии", "ocr": "Документ и OCR"}
#: Findings of known check types: title, level (None: the check's), zone, recommendation.
TEMPLATES = {
    "ocr_expected_total_exceeded": ("Стоимость ремонта выше ожидаемой по истории", "high", "Сопоставление с историей", "Запросить расшифровку, за счет каких строк стоимость вышла выше исторического ориентира."),
    "ocr_work_reference_price_deviation": ("Цена работы отклоняется от накопленной практики", None, "Сопоставление с историей", "Проверить, чем сервис обосновывает отклонение цены по этой работе относительно накопленной практики."),
    "ocr_repeat_repair_detected": ("Выявлен повторный ремонт по той же работе", "high", "Повторяемость ремонтов", "Поднять предыдущий заказ-наряд и проверить, была ли устранена причина первого ремонта или проблема повторяется."),
    "ocr_duplicate_work_lines": ("Есть признаки задвоения строк в заказ-наряде", "high", "Суммы и структура", "Проверить, не включены ли в счет одни и те же позиции повторно."),
    "ocr_duplicate_part_lines": ("Есть признаки задвоения строк в заказ-наряде", "high", "Суммы и структура", "Проверить, не включены ли в счет одни и те же позиции повторно."),
    "ocr_work_reference_mileage_outlier": ("Работа нетипична для текущего пробега", "medium", "Сопоставление с историей", "Уточнить, почему работа выполнена на этом пробеге и есть ли подтверждающая дефектовка."),
    "ocr_work_reference_missing": ("Работа не подтверждается накопленной практикой", "medium", "Сопоставление с историей", "Проверить работу вручную и по возможности пополнить справочник подтвержденных операций после закрытия ремонта."),
}
#: What is recommended for any other check, by a part of its type, in the order in which they are asked.
ADVICE = (
    ("vehicle", "Проверить привязку техники и убедиться, что документ относится к нужной карточке ТС."),
    ("service", "Подтвердить сервис по справочнику и снять предупреждение только после ручной проверки."),
    ("standard_hours", "Сверить работу с каталогом нормо-часов и подтвердить допустимость отклонения."),
    ("duplicate", "Проверить, не задвоены ли работы или материалы в заказ-наряде."),
    ("total", "Пересчитать стоимость работ и материалов по строкам до закрытия заказ-наряда."),
    ("^ocr_", "Проверить спорные поля вручную и зафиксировать корректные значения перед подтверждением."),
)
#: Symptoms in a repair's reason, and what its lines name if they are dealt with: (zone, symptoms, terms).
SIGNALS = (
    ("ABS", ("abs", "абс"), ("abs", "абс", "датчик", "модулятор", "проводк", "блок abs")),
    ("пневматика", ("утечк", "воздух", "пневм", "компрессор"), ("утечк", "воздух", "пневм", "компрессор", "трубк", "шланг", "клапан")),
    ("тормозная система", ("тормоз", "колод", "суппорт", "диск"), ("тормоз", "колод", "суппорт", "диск")),
)
DIAGNOSTICS = ("диагност", "tech tool", "тех тул", "скан", "компьютер")
_FINDING = ("repair_id", "turn", "place", "title", "level", "zone", "recommendation")


def _plain(c: Column) -> Column:
    return F.trim(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё\n\t", "е  "))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def _found(df: DataFrame, turn: int, place: Column, title: Column | str, level: Column | str, zone: Column | str, advice: Column | str) -> DataFrame:
    of = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("repair_id", F.lit(turn).alias("turn"), place.cast("long").alias("place"), of(title).alias("title"), of(level).alias("level"), of(zone).alias("zone"), of(advice).alias("recommendation"))


def check_findings(checks: DataFrame) -> DataFrame:
    """A finding for each open check: of its type's template, or else by its severity, section and title."""
    t = F.col("check_type")
    own = F.when(F.col("severity").isin("error", "suspicious"), "high").when(F.col("severity") == "normal", "low").otherwise("medium")
    section = text.report_section(t)
    title, level, zone, advice = F.col("title"), own, F.lit(ZONES["ocr"]), F.lit(None).cast("string")
    for s, name in ZONES.items():
        zone = F.when(section == s, name).otherwise(zone)
    for part, words in reversed(ADVICE):
        advice = F.when(t.rlike(part), words).otherwise(advice)
    for kind, (title_, level_, zone_, advice_) in TEMPLATES.items():
        title, level, zone, advice = F.when(t == kind, title_).otherwise(title), F.when(t == kind, F.lit(level_) if level_ else own).otherwise(level), F.when(t == kind, zone_).otherwise(zone), F.when(t == kind, advice_).otherwise(advice)
    return _found(checks.where(~F.col("is_resolved")), 1, F.col("id"), title, level, zone, advice)


def main_documents(documents: DataFrame, repairs: DataFrame) -> DataFrame:
    """repair_id, ocr_confidence, reasons of each repair's source document, else of a primary one, else of the first."""
    d = documents.join(repairs.select(F.col("id").alias("repair_id"), "source_document_id"), "repair_id")
    return d.groupBy("repair_id").agg(F.max_by(F.struct("ocr_confidence", F.array_compact(F.array("reason_1", "reason_2")).alias("reasons")), F.struct((F.col("id") == F.coalesce("source_document_id", F.lit(-1))).alias("s"), F.col("is_primary"), -F.col("id"))).alias("d")).select("repair_id", "d.*")


def findings(checks: DataFrame, repairs: DataFrame, lines: DataFrame, documents: DataFrame, shares: DataFrame) -> DataFrame:
    """Findings of all generators (_FINDING), each title once a repair: the first generator's, and there the first one. shares:
    top_parts() of the lines."""
    said = F.concat_ws(" ", F.nullif(F.col("reason"), F.lit("")), F.nullif(F.col("employee_comment"), F.lit(""))) if "employee_comment" in repairs.columns else F.col("reason")
    r = repairs.select(F.col("id").alias("repair_id"), _plain(said).alias("why"), _plain(F.col("reason")).alias("reason_alone"))
    parts = [check_findings(checks)]
    # what a repair's lines name, reduced to flags of those lines that name anything before they are joined
    name = _plain(F.col("name"))
    terms = tuple(dict.fromkeys(x for _, _, of in SIGNALS for x in of)) + DIAGNOSTICS
    flags = lines.where(_any(name, terms)).groupBy("repair_id").agg(*(F.max(_any(name, terms)).alias(f"t{i}") for i, (_, _, terms) in enumerate(SIGNALS)), F.count_if((F.col("kind") == "work") & _any(name, DIAGNOSTICS)).alias("diagnostics"))
    both = r.join(flags, "repair_id", "full")
    told = []  # of the repair itself and its flags: all in one pass
    tell = lambda here, turn, place, title, level, zone, advice: told.append(F.when(here, F.struct(F.lit(turn).alias("turn"), F.lit(place).cast("long").alias("place"), *(F.lit(x).alias(c) for x, c in ((title, "title"), (level, "level"), (zone, "zone"), (advice, "recommendation"))))))
    for i, (zone, symptoms, _) in enumerate(SIGNALS):
        tell((F.col("why") != "") & _any(F.col("why"), symptoms) & ~F.coalesce(F.col(f"t{i}"), F.lit(False)), 2, i, f"Нет прозрачного ремонта по зоне «{zone}»", "high" if zone == "ABS" else "medium", "Соответствие дефекта и ремонта", f"Запросить у сервиса расшифровку, какие действия по зоне «{zone}» были выполнены и чем подтверждено устранение неисправности.")
    tell(F.contains("reason_alone", F.lit("проч")), 3, 0, "Причина ремонта оформлена слишком размыто", "medium", "Прозрачность ремонта", "Ввести правило: не закрывать заказ-наряды с причиной «прочее» без расшифровки конкретного дефекта.")
    tell(F.col("diagnostics") >= 2, 4, 0, "В заказ-наряде несколько диагностических работ", "medium", "Суммы и структура", "Запросить у сервиса, чем отличаются диагностические позиции и почему они тарифицировались отдельно.")
    parts.append(both.select("repair_id", F.inline(F.array_compact(F.array(*told)))))
    part = _plain(F.col("name"))
    related = F.lit(False)
    for _, symptoms, terms in SIGNALS:
        related = related | (_any(F.col("why"), symptoms) & _any(part, terms))
    parts.append(_found(shares.where("line_total > 0").join(r, "repair_id").where((F.col("why") != "") & ~related), 5, F.col("rank"), "Дорогая запчасть слабо связана с причиной обращения", "medium", "Состав ремонта", "Запросить дефектовку или пояснение, почему эта запчасть была заменена именно в рамках данного обращения."))
    main = main_documents(documents, repairs)
    parts.append(_found(main.where("ocr_confidence < 0.75"), 6, F.lit(0), "Низкая уверенность OCR по основному документу", "medium", ZONES["ocr"], "Проверить ключевые поля вручную и запросить у сервиса более качественную копию документа при необходимости."))
    level = F.when(F.exists("reasons", lambda x: x.isin("text_not_found", "repair_date_invalid")), "medium").otherwise("low")
    parts.append(_found(main.where(F.size("reasons") > 0), 7, F.lit(0), "Документ содержит признаки неполного или спорного распознавания", level, ZONES["ocr"], "До подтверждения ремонта проверить вручную все поля, отмеченные системой как спорные или отсутствующие."))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    w = Window.partitionBy("repair_id", "title").orderBy("turn", "place", F.desc(ordinal(F.col("level"), LEVELS)))
    return every.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def risk_matrix(found: DataFrame) -> DataFrame:
    """repair_id, zone, level: the worst level of each zone that a repair's findings name."""
    worst = found.groupBy("repair_id", "zone").agg(F.max(ordinal(F.col("level"), LEVELS)).alias("_n"), F.count("*").alias("findings"))
    return worst.select("repair_id", "zone", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_n") + 1).alias("level"), "findings")


def report(repairs: DataFrame, lines: DataFrame, checks: DataFrame, found: DataFrame) -> DataFrame:
    """For each repair its risk, the number of findings, up to five highlights (its total, its lines, its open checks, then
    the worst findings by title) and up to six recommendations in the findings' order. Of a repair's findings only those
    that are shown are collected."""
    rows = found.withColumn("_n", ordinal(F.col("level"), LEVELS))
    sums = rows.groupBy("repair_id").agg(F.max("_n").alias("_risk"), F.count("*").alias("findings"))
    by = Window.partitionBy("repair_id").orderBy(F.desc("_n"), "title")
    titles = rows.withColumn("rank", F.row_number().over(by)).where("rank <= 2").groupBy("repair_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title"))).alias("titles"))
    advice = rows.where("recommendation is not null").groupBy("repair_id", "recommendation").agg(F.max(F.struct("_n", F.lit(0))).alias("_x"), F.min_by(F.struct((-F.col("_n")).alias("worst"), "title"), F.struct(-F.col("_n"), "title")).alias("first"))
    advice = advice.withColumn("rank", F.row_number().over(Window.partitionBy("repair_id").orderBy("first"))).where("rank <= 6").groupBy("repair_id").agg(F.sort_array(F.collect_list(F.struct("rank", "recommendation"))).alias("advice"))
    counts = lines.groupBy("repair_id").agg(F.count_if(F.col("kind") == "work").alias("works"), F.count_if(F.col("kind") == "part").alias("parts"))
    open_ = checks.where(~F.col("is_resolved")).groupBy("repair_id").agg(F.count("*").alias("open"))
    out = repairs.select(F.col("id").alias("repair_id"), "grand_total")
    for t in (sums, titles, advice, counts, open_):
        out = out.join(t, "repair_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    head = F.array(F.concat(F.lit("Сумма заказ-наряда: "), text.money(F.col("grand_total"))), F.concat(F.lit("Работ: "), n("works"), F.lit(" · запчастей: "), n("parts")), F.concat(F.lit("Открытых проверок: "), n("open")))
    listed = lambda c, f: F.coalesce(F.transform(c, lambda x: x[f]), F.array().cast("array<string>"))
    return out.select("repair_id", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce("_risk", F.lit(0)) + 1).alias("risk"), F.coalesce("findings", F.lit(0)).alias("findings"), F.array_join(F.concat(head, listed("titles", "title")), ";").alias("highlights"), F.array_join(listed("advice", "recommendation"), ";").alias("recommendations"))


def status_after_processing(fields: Column, blocking: Column) -> Column:
    return F.when(fields == 0, "ocr_error").when(blocking, "suspicious").otherwise("in_review")


def report_status(repairs: DataFrame, documents: DataFrame, checks: DataFrame) -> DataFrame:
    """repair_id, status: a document in the queue, blocking checks, open checks, or nothing left to do."""
    waiting = documents.where("status = 'uploaded'").select("repair_id").distinct().withColumn("_waiting", F.lit(True))
    left = checks.where(~F.col("is_resolved")).groupBy("repair_id").agg(F.max(F.col("severity").isin("suspicious", "error")).alias("_blocking"))
    both = repairs.select(F.col("id").alias("repair_id")).join(waiting, "repair_id", "left").join(left, "repair_id", "left")
    return both.select("repair_id", F.when(F.col("_waiting"), "ocr_queue").when(F.col("_blocking"), "critical_mismatch").when(~F.col("_blocking"), "needs_review").otherwise("ready").alias("status"))


def status_after_check_edit(repairs: DataFrame, checks: DataFrame, admin: bool) -> DataFrame:
    """repair_id, status: by the checks that are still open, and by who closed the last one."""
    left = checks.where(~F.col("is_resolved")).groupBy("repair_id").agg(F.max(F.col("severity").isin("suspicious", "error")).alias("_blocking"))
    both = repairs.select(F.col("id").alias("repair_id")).join(left, "repair_id", "left")
    return both.select("repair_id", F.when(F.col("_blocking"), "suspicious").when(F.col("_blocking").isNotNull() | F.lit(admin), "in_review").otherwise("employee_confirmed").alias("status"))


def document_after_processing(fields: Column, source_type: Column) -> Column:
    """struct<status, priority> by the number of fields that were read."""
    status = F.when(fields >= 4, "recognized").when(fields > 0, "partially_recognized").when(source_type == "pdf", "ocr_error").otherwise("needs_review")
    return F.struct(status.alias("status"), F.when(status == "recognized", 20).otherwise(100).alias("priority"))


def missing_fields(repairs: DataFrame, vehicles: DataFrame, placeholder: str) -> DataFrame:
    """repair_id, missing: what a repair lacks for a confirmation: vehicle, order number, date, service, mileage, total."""
    v = vehicles.select(F.col("id").alias("vehicle_id"), (F.col("external_id") != placeholder).alias("_known"))
    none = {
        "vehicle": ~F.coalesce("_known", F.lit(False)), "order_number": F.coalesce(F.col("order_number"), F.lit("")) == "", "repair_date": F.col("repair_date").isNull(), "service": F.col("service_id").isNull(),
        "mileage": F.coalesce(F.col("mileage") <= 0, F.lit(True)), "grand_total": F.coalesce(F.col("grand_total") <= 0, F.lit(True)),
    }
    missing = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in none.items()]))
    return repairs.join(v, "vehicle_id", "left").select(F.col("id").alias("repair_id"), missing.alias("missing")).where(F.size("missing") > 0)


#: What a review action makes of a document, its repair, its place in the queue and its open checks, and who may take it.
ACTIONS = {"employee_confirm": ("confirmed", "employee_confirmed", 60, True, "employee"), "confirm": ("confirmed", "confirmed", 20, True, "admin"), "send_to_review": ("needs_review", "in_review", 120, False, None)}


def review_action(role: Column, action: Column) -> Column:
    """struct<document_status, repair_status, priority, resolves>; NULL for an unknown action, or where the role may not act so."""
    out = F.lit(None)
    for name, (d, r, p, c, who) in ACTIONS.items():
        made = F.struct(F.lit(d).alias("document_status"), F.lit(r).alias("repair_status"), F.lit(p).alias("priority"), F.lit(c).alias("resolves"))
        out = F.when((action == name) & ((role == who) if who else F.lit(True)), made).otherwise(out)
    return out
