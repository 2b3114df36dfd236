"""What a repair's report says beside its findings: summaries, rationales, evidence, the headline, comments on zones, and the
repair with all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources import scratch
from . import review

#: Summary and rationale of findings of known check types.
OF_CHECKS = {
    "ocr_expected_total_exceeded": ("Итоговая стоимость ремонта заметно превышает ориентир по истории аналогичных работ.", "Это может быть нормальным только при наличии понятного объяснения по составу работ, пробегу или сервису."),
    "ocr_work_reference_price_deviation": ("По конкретной работе цена заметно отличается от медианы по накопленной базе аналогичных ремонтов.", "Такой сигнал полезен для выявления завышения, нетипичного тарифа или ошибки в смете."),
    "ocr_repeat_repair_detected": ("По этой машине уже был похожий ремонт в недавнем прошлом, что повышает риск неустраненной первопричины.", "Для парка это один из ключевых сигналов: повторяемость обычно говорит о слабой диагностике, низком качестве ремонта или неправильной эксплуатации."),
    "ocr_duplicate_work_lines": ("Система нашла повторяющиеся строки работ или запчастей с одинаковыми параметрами.", "Это типичный источник переплаты или ошибки при составлении заказ-наряда."),
    "ocr_duplicate_part_lines": ("Система нашла повторяющиеся строки работ или запчастей с одинаковыми параметрами.", "Это типичный источник переплаты или ошибки при составлении заказ-наряда."),
    "ocr_work_reference_mileage_outlier": ("Для такой работы пробег машины выглядит нетипичным относительно накопленной практики.", "Это не означает ошибку автоматически, но требует проверки: работа могла быть навязана, ошибочно классифицирована или связана с иным дефектом."),
    "ocr_work_reference_missing": ("Для этой работы в системе пока нет подтвержденной истории, на которую можно опереться при проверке.", "Такие позиции требуют повышенного внимания, особенно если они дорогие или слабо связаны с причиной обращения."),
}
#: Summary of any other check without details, and rationales by a part of its type, in the order in which they are asked.
OTHER_CHECK = "Выявлено несоответствие, требующее ручной проверки."
RATIONALES = (("^ocr_", "Несоответствие выявлено автоматической сверкой документа с данными ремонта и справочниками."), ("standard_hours", "Отклонение найдено при сравнении работ с каталогом нормо-часов."), ("repeat_repair|duplicate", "Сигнал собран на основе повторяющихся или аномально похожих операций."))
#: Summary and rationale of the other findings, by turn.
OF_TURNS = {
    2: ("В описании обращения есть проблема по конкретной системе, но в заказ-наряде не видно прямых работ по ее устранению.", "Есть риск формального закрытия обращения диагностикой или сопутствующими работами."),
    3: ("Заказ-наряд закрыт с общей формулировкой причины, что ухудшает управляемость и претензионную работу.", "При формулировке вроде «прочее» сложно доказать, какой именно дефект должен был быть устранен."),
    4: ("Есть риск дублирования диагностики или раздельного биллинга одной и той же операции.", "Для управленческого контроля такие работы нужно разделять только при явном различии этапов или систем."),
    5: ("В заказ-наряде есть крупная по сумме запчасть, но ее связь с заявленной причиной ремонта неочевидна.", "Это может быть нормой, но без дефектовки или пояснения от сервиса такой блок выглядит как потенциальная допродажа."),
    6: ("Распознавание прошло с пониженной уверенностью, поэтому часть выводов требует дополнительной ручной проверки.", "Чем хуже исходный документ, тем выше риск ошибок в шапке, суммах и составе работ."),
    7: ("Часть полей система не смогла уверенно извлечь автоматически.", "Это повышает риск ручных правок и управленческих ошибок при закрытии ремонта."),
}
#: Evidence of known check types after the check's details: text, kind of the values, their keys in the payload.
EVIDENCE = {
    "ocr_expected_total_exceeded": (("Фактическая сумма: {}", "money", ("actual_total",)), ("Ожидаемая сумма: {}", "money", ("expected_total",))),
    "ocr_work_reference_price_deviation": (("Текущая цена: {}", "money", ("current_price",)), ("Медианная цена: {}", "money", ("median_price",)), ("Источник сравнения: {}", "text", ("comparison_source_label",))),
    "ocr_repeat_repair_detected": (("Предыдущий заказ-наряд: {}", "text", ("previous_order_number",)), ("Дата прошлого ремонта: {}", "text", ("previous_repair_date",)), ("Интервал между ремонтами: {} дн.", "int", ("days_since_previous",))),
    "ocr_duplicate_work_lines": (("Совпадающих строк: {}", "int", ("duplicate_count",)),),
    "ocr_duplicate_part_lines": (("Совпадающих строк: {}", "int", ("duplicate_count",)),),
    "ocr_work_reference_mileage_outlier": (("Пробег в ремонте: {} км", "int", ("repair_mileage",)), ("Исторический диапазон: {}-{} км", "int", ("min_mileage", "max_mileage"))),
    "ocr_work_reference_missing": (),
}
EXCEEDED = "Обнаружено превышение ожидаемой стоимости."
#: Keys of any other check's payload that are evidence, with their names, in order.
KEYS = (
    ("document_plate_number", "Госномер в документе"), ("vehicle_plate_number", "Госномер в карточке"), ("lines_total", "Сумма строк"), ("header_total", "Итог по шапке"), ("expected_total", "Ожидаемая сумма"), ("actual_total", "Фактическая сумма"),
    ("work_name", "Работа"), ("part_name", "Запчасть"), ("catalog_name", "Каталог"), ("standard_hours", "Нормо-часы"), ("actual_hours", "Фактические часы"),
)
#: Names of the levels of risk, and what is said about a zone at each of them.
LEVEL_NAMES = {"low": "низкий", "medium": "средний", "high": "высокий"}
COMMENTS = {"high": ("По зоне «", "» есть признаки, требующие отдельного управленческого контроля."), "medium": ("По зоне «", "» есть спорные моменты, которые стоит уточнить до закрытия ремонта."), "low": ("По зоне «", "» значимых рисков не выявлено.")}
CALM, ALERT = "Серьезных управленческих рисков не найдено", "Есть сигналы для управленческого контроля"


def _filled(pattern: str, kind: str, keys: tuple[str, ...]) -> Column:
    """The pattern with values of the payload, empty where one is missing or of another kind."""
    raw = [F.col("payload")[k] for k in keys]
    shown = {"money": lambda c: text.money(c.try_cast("double")), "int": lambda c: c.try_cast("long").cast("string"), "text": lambda c: F.nullif(c, F.lit(""))}[kind]
    pieces = pattern.split("{}")
    parts = [F.lit(pieces[0])]
    for value, after in zip(raw, pieces[1:], strict=True):
        parts += [shown(value), F.lit(after)]
    return F.coalesce(F.concat(*parts), F.lit(""))


def _of_checks(checks: DataFrame) -> DataFrame:
    """checks: id, repair_id, check_type, is_resolved, details, payload (map of texts)."""
    kind, details = F.col("check_type"), F.nullif(F.col("details"), F.lit(""))
    summary, rationale = F.coalesce(details, F.lit(OTHER_CHECK)), F.lit(None).cast("string")
    for part, words in reversed(RATIONALES):
        rationale = F.when(kind.rlike(part), words).otherwise(rationale)
    work, total = F.col("payload")["line_breakdown.work_name"], F.col("payload")["line_breakdown.expected_line_total"].try_cast("double")
    sample = F.concat(F.lit("Пример строки для сравнения: "), F.nullif(work, F.lit("")), F.coalesce(F.concat(F.lit(" · ожидаемо "), text.money(total)), F.lit("")))
    evidence = F.slice(F.array_compact(F.array(details, *(F.concat(F.lit(f"{label}: "), F.col("payload")[key]) for key, label in KEYS), sample)), 1, 5)
    for name, (summary_, rationale_) in OF_CHECKS.items():
        first = F.coalesce(details, F.lit(EXCEEDED if name == "ocr_expected_total_exceeded" else ""))
        evidence = F.when(kind == name, F.array(first, *(_filled(*e) for e in EVIDENCE[name]))).otherwise(evidence)
        summary, rationale = F.when(kind == name, summary_).otherwise(summary), F.when(kind == name, rationale_).otherwise(rationale)
    return checks.where(~F.col("is_resolved")).select("repair_id", F.lit(1).alias("turn"), F.col("id").cast("long").alias("place"), summary.alias("summary"), rationale.alias("rationale"), evidence.alias("evidence"))


def _first_names(works: DataFrame, most: int, name: str) -> DataFrame:
    """repair_id and the names of its first works, `most` at most, joined."""
    w = Window.partitionBy("repair_id").orderBy("line_no", "part_id", "name")
    few = works.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return few.groupBy("repair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias(name))


def explained(found: DataFrame, checks: DataFrame, repairs: DataFrame, lines: DataFrame, documents: DataFrame, shares: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """findings() with summary, rationale and evidence (an array of texts). checks have details and payload besides; shares is
    top_parts(); labels: names of the reasons for a manual review. Findings are written first, so that names are only looked up for
    repairs that show them, and only those that are shown are collected."""
    found = scratch.save(found, "findings")
    having = lambda df, turn: df.join(found.where(F.col("turn") == turn).select("repair_id").distinct(), "repair_id", "left_semi")
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.nullif(F.col("employee_comment"), F.lit("")) if "employee_comment" in repairs.columns else F.lit(None), F.lit("не указано"))
    r = repairs.select(F.col("id").alias("repair_id"), reason.alias("said"), F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("не указана")).alias("why"), "source_document_id", "grand_total")
    works = lines.where("kind = 'work'")
    six = having(r, 2).join(_first_names(having(works, 2), 6, "names"), "repair_id", "left")
    rows = {
        2: six.select("repair_id", F.lit(None).cast("long").alias("place"), F.array(F.concat(F.lit("Описание обращения: "), "said"), F.coalesce(F.concat(F.lit("Работы в заказ-наряде: "), "names"), F.lit("Работы по этой зоне не выделены."))).alias("evidence")),
        3: having(r, 3).select("repair_id", F.lit(None).cast("long").alias("place"), F.array(F.concat(F.lit("Причина ремонта: "), "why")).alias("evidence")),
        4: _first_names(having(works.where(review._any(review._plain(F.col("name")), review.DIAGNOSTICS)), 4), 4, "names").select("repair_id", F.lit(None).cast("long").alias("place"), F.array(F.concat(F.lit("Диагностические позиции: "), "names")).alias("evidence")),
        5: shares.join(r, "repair_id").select(
            "repair_id", F.col("rank").cast("long").alias("place"),
            F.array(F.concat(F.lit("Причина обращения: "), "said"), F.concat(F.lit("Запчасть: "), "name", F.lit(" · сумма "), text.money(F.col("line_total"))), F.concat(F.lit("Доля в заказ-наряде: "), F.bround(F.col("line_total") / F.col("grand_total") * 100, 0).cast("long").cast("string"), F.lit("%"))).alias("evidence"),
        ),
    }
    main = review.main_documents(documents, repairs)
    named = F.col("code")
    for code, label in (labels or {}).items():
        named = F.when(F.col("code") == code, label).otherwise(named)
    rows[6] = main.where("ocr_confidence is not null").select("repair_id", F.lit(None).cast("long").alias("place"), F.array(F.concat(F.lit("OCR confidence: "), F.bround(F.col("ocr_confidence") * 100, 0).cast("long").cast("string"), F.lit("%"))).alias("evidence"))
    listed = main.select("repair_id", F.posexplode(F.slice("reasons", 1, 5)).alias("at", "code")).groupBy("repair_id").agg(F.array_sort(F.collect_list(F.struct("at", named.alias("name")))).alias("x"))
    rows[7] = listed.select("repair_id", F.lit(None).cast("long").alias("place"), F.array(F.concat(F.lit("Причины ручной проверки: "), F.array_join(F.transform("x", lambda x: x["name"]), ", "))).alias("evidence"))
    every = _of_checks(checks)
    for turn, df in rows.items():
        every = every.unionByName(df.select("repair_id", F.lit(turn).alias("turn"), "place", F.lit(OF_TURNS[turn][0]).alias("summary"), F.lit(OF_TURNS[turn][1]).alias("rationale"), "evidence"))
    # only findings of checks and of parts have several places in a repair
    at = F.when(F.col("turn").isin(1, 5), F.col("place"))
    return found.withColumn("_at", F.coalesce(at, F.lit(-1))).join(every.withColumn("_at", F.coalesce(at, F.lit(-1))).drop("place"), ["repair_id", "turn", "_at"]).drop("_at")


def zone_comments(matrix: DataFrame) -> DataFrame:
    """risk_matrix() with a comment on each zone."""
    comment = F.lit(None).cast("string")
    for level, (before, after) in COMMENTS.items():
        comment = F.when(F.col("level") == level, F.concat(F.lit(before), "zone", F.lit(after))).otherwise(comment)
    return matrix.withColumn("comment", comment)


def headlines(repairs: DataFrame, found: DataFrame) -> DataFrame:
    """repair_id, headline, summary, risk_label."""
    of = found.groupBy("repair_id").agg(F.count("*").alias("_n"), F.max(review.ordinal(F.col("level"), review.LEVELS)).alias("_risk"))
    both = repairs.select(F.col("id").alias("repair_id"), "order_number", "grand_total").join(of, "repair_id", "left")
    label = F.element_at(F.array(*[F.lit(LEVEL_NAMES[x]) for x in review.LEVELS]), F.coalesce("_risk", F.lit(0)) + 1)
    order = F.coalesce(F.nullif(F.col("order_number"), F.lit("")), F.concat(F.lit("#"), F.col("repair_id").cast("string")))
    head = F.concat(F.lit("Заказ-наряд "), order, F.lit(" на сумму "), text.money(F.coalesce("grand_total", F.lit(0.0))))
    calm = F.concat(head, F.lit(" проверен. Критичных несоответствий, требующих отдельного контроля, не выявлено."))
    alert = F.concat(head, F.lit(" содержит "), F.col("_n").cast("string"), F.lit(" значимых сигналов. Общий уровень риска: "), label, F.lit("."))
    some = F.col("_n") > 0
    return both.select("repair_id", F.when(some, ALERT).otherwise(CALM).alias("headline"), F.when(some, alert).otherwise(calm).alias("summary"), label.alias("risk_label"))


def _struct(df: DataFrame, columns: list[str]) -> str:
    return df.select(F.struct(*columns).alias("x")).schema["x"].dataType.simpleString()


def repair_detail(repairs: DataFrame, vehicles: DataFrame, services: DataFrame, lines: DataFrame, documents: DataFrame, checks: DataFrame, found: DataFrame) -> DataFrame:
    """A repair with its vehicle and service, the report's headline, and arrays of its works, parts, checks, documents, findings
    (explained(), worst first; written once) and zones. Each child is brought together before it is joined, so that none multiplies another;
    an array is as long as a repair has children, so this is for a page of repairs: restrict `repairs` first."""
    page = repairs.select(F.col("id").alias("repair_id"), "order_number", "repair_date", "mileage", "reason", "status", "grand_total", "vehicle_id", "service_id")
    own = lambda df: df.join(page.select("repair_id"), "repair_id", "left_semi")
    found = scratch.save(own(found), "told-findings")
    worst = -review.ordinal(F.col("level"), review.LEVELS)
    children = {
        "checks": own(checks).select("repair_id", "is_resolved", "created_at", "id", "check_type", "severity", "title"), "documents": own(documents).select("repair_id", "id", "original_filename", "kind", "status", "is_primary"),
        "findings": found.select("repair_id", worst.alias("worst"), "title", "level", "zone", "summary", "rationale", "evidence", "recommendation"), "zones": zone_comments(review.risk_matrix(found)).select("repair_id", worst.alias("worst"), "zone", "level", "comment"),
    }
    line = F.struct("line_no", "part_id", "code", "name", "quantity", "unit", "price", "line_total")
    both = own(lines).groupBy("repair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, line))).alias(name) for kind, name in (("work", "works"), ("part", "parts"))))
    out = page.join(vehicles.select(F.col("id").alias("vehicle_id"), "plate_number", "vehicle_type", "brand", "model"), "vehicle_id", "left").join(services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name")), "service_id", "left")
    out = out.join(headlines(repairs, found), "repair_id").join(both, "repair_id", "left")
    for name in ("works", "parts"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(both.schema[name].dataType)))
    for name, child in children.items():
        rest = [c for c in child.columns if c != "repair_id"]
        out = out.join(child.groupBy("repair_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), "repair_id", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{_struct(child, rest)}>")))
    return out
