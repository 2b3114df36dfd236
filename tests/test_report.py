"""The report's texts, spelled out for one repair."""

from __future__ import annotations

import datetime as dt

from wrenchfield.operators import history, report, review

DAY = dt.date(2024, 1, 1)


def test_report_of_a_repair(spark):
    repairs = spark.createDataFrame([(1, "ZN-1", DAY, 10, 5, 1000, "Не работает ABS", "и утечка воздуха", 1, 2000.0, "in_review"), (2, None, DAY, 10, None, 0, None, None, None, 1234567.5, "confirmed")], "id long, order_number string, repair_date date, vehicle_id long, service_id long, mileage long, reason string, employee_comment string, source_document_id long, grand_total double, status string")
    lines = spark.createDataFrame([(1, "work", None, f"мойка {i}", 1.0, "шт", 1.0, 1.0, 7, i) for i in range(8)] + [(1, "work", None, "Диагностика", 1.0, "шт", 1.0, 1.0, 7, 20), (1, "work", None, "Сканирование", 1.0, "шт", 1.0, 1.0, 7, 21), (1, "part", "A1", "Кабина", 1.0, "шт", 900.0, 900.0, 7, 30)], "repair_id long, kind string, code string, name string, quantity double, unit string, price double, line_total double, part_id long, line_no int")
    checks = spark.createDataFrame(
        [
            (1, 1, "ocr_work_reference_mileage_outlier", "warning", False, "t1", DAY, "мало", {"repair_mileage": "1000", "min_mileage": "5000", "max_mileage": "9000"}), (2, 1, "ocr_vehicle_plate_mismatch", "warning", False, "Номер", DAY, None, {"document_plate_number": "А1", "vehicle_plate_number": "В2", "other": "x"}),
            (3, 1, "ocr_expected_total_exceeded", "suspicious", False, "t3", DAY, None, {"actual_total": "2000", "expected_total": "none"}), (4, 1, "standard_hours_exceeded", "error", False, "Часы", DAY, "д", None), (5, 1, "ocr_duplicate_part_lines", "error", True, "t5", DAY, None, None),
        ],
        "id long, repair_id long, check_type string, severity string, is_resolved boolean, title string, created_at date, details string, payload map<string,string>",
    )
    documents = spark.createDataFrame([(1, 1, "a.pdf", "order", "recognized", True, 0.5, "text_not_found", "mileage_missing"), (2, 1, "b.pdf", "order", "recognized", True, 0.9, None, None)], "id long, repair_id long, original_filename string, kind string, status string, is_primary boolean, ocr_confidence double, reason_1 string, reason_2 string")
    vehicles, services = spark.createDataFrame([(10, "P1", "truck", "МАЗ", "M")], "id long, plate_number string, vehicle_type string, brand string, model string"), spark.createDataFrame([(5, "СТО")], "id long, name string")
    shares = history.top_parts(lines, repairs)
    found = review.findings(checks, repairs, lines, documents, shares)
    told = report.explained(found, checks, repairs, lines, documents, shares, {"mileage_missing": "нет пробега"})
    assert told.count() == found.count() == 10
    got = {r["title"]: r for r in told.collect()}
    assert got["Работа нетипична для текущего пробега"]["evidence"] == ["мало", "Пробег в ремонте: 1000 км", "Исторический диапазон: 5000-9000 км"]
    assert got["Номер"]["evidence"] == ["Госномер в документе: А1", "Госномер в карточке: В2"] and got["Номер"]["summary"] == "Выявлено несоответствие, требующее ручной проверки."
    assert got["Стоимость ремонта выше ожидаемой по истории"]["evidence"] == ["Обнаружено превышение ожидаемой стоимости.", "Фактическая сумма: 2 000,00 ₽", ""]
    assert (got["Часы"]["summary"], got["Часы"]["evidence"], got["Часы"]["rationale"]) == ("д", ["д"], "Отклонение найдено при сравнении работ с каталогом нормо-часов.")
    assert got["Нет прозрачного ремонта по зоне «ABS»"]["evidence"] == ["Описание обращения: Не работает ABS", "Работы в заказ-наряде: мойка 0, мойка 1, мойка 2, мойка 3, мойка 4, мойка 5"]
    assert got["Нет прозрачного ремонта по зоне «пневматика»"]["level"] == "medium"  # from the employee's comment
    assert got["В заказ-наряде несколько диагностических работ"]["evidence"] == ["Диагностические позиции: Диагностика, Сканирование"]
    assert got["Дорогая запчасть слабо связана с причиной обращения"]["evidence"] == ["Причина обращения: Не работает ABS", "Запчасть: Кабина · сумма 900,00 ₽", "Доля в заказ-наряде: 45%"]
    assert got["Низкая уверенность OCR по основному документу"]["evidence"] == ["OCR confidence: 50%"]
    assert got["Документ содержит признаки неполного или спорного распознавания"]["evidence"] == ["Причины ручной проверки: text_not_found, нет пробега"]
    detail = {r["repair_id"]: r for r in report.repair_detail(repairs, vehicles, services, lines, documents, checks, told).collect()}
    one, two = detail[1], detail[2]
    assert one["headline"] == "Есть сигналы для управленческого контроля" and one["summary"] == "Заказ-наряд ZN-1 на сумму 2 000,00 ₽ содержит 10 значимых сигналов. Общий уровень риска: высокий."
    assert two["headline"] == "Серьезных управленческих рисков не найдено" and two["summary"].startswith("Заказ-наряд #2 на сумму 1 234 567,50 ₽ проверен.")
    assert [len(one[c]) for c in ("works", "parts", "checks", "documents", "findings")] == [10, 1, 5, 2, 10] and [two[c] for c in ("works", "parts", "checks", "documents", "findings", "zones")] == [[]] * 6
    assert [r["level"] for r in one["findings"]] == ["high"] * 3 + ["medium"] * 7 and one["findings"][0]["evidence"] and one["service_name"] == "СТО" and two["service_name"] is None
    assert {r["zone"]: r["comment"] for r in one["zones"]}["Нормо-часы"] == "По зоне «Нормо-часы» есть признаки, требующие отдельного управленческого контроля."
