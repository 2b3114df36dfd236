"""Normalisers and extraction on written-out cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wrenchfield.functions import document, extract, text


def one(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(expression(F.col("c"))).collect()]


@pytest.mark.parametrize(
    ("rule", "given", "wanted"),
    [
        (text.parse_amount, ["1 234,50", "12.5", "n/a", None, "", "1 000,00"], [1234.5, 12.5, None, None, None, 1000.0]),
        (text.parse_date, ["15.01.2025", "1/2/70", "31-12-68", "2024-03-05", "5 марта 2024", "31.02.2024", "x", None, "1.2-2024", "выдан 5  Марта 2024 г."], [dt.date(2025, 1, 15), dt.date(1970, 2, 1), dt.date(2068, 12, 31), dt.date(2024, 3, 5), dt.date(2024, 3, 5), None, None, None, None, dt.date(2024, 3, 5)]),
        (text.identifier, ["a 123-bc", "№ 7/ж", None], ["A123BC", "7Ж", None]),
        (text.parse_mileage, ["120 000 км", "0", "none"], [120000, None, None]),
        (text.normalized_name, ["Oil filter, OIL", "a b", None], ["filter oil", "", ""]),
        (text.service_key, ["ООО Альфа-Сервис", "LLC Beta #1", "Общество с ограниченной ответственностью «Ёж»", None], ["альфасервис", "llcbeta1", "еж", ""]),
        (text.unit, ["ШТ.", "pcs", "H/ч", "к-т", "", None], ["шт", "pcs", "нч", "компл", None, None]),
        (text.service_of_folder, ["/a/Заказ наряды Альфа_Трак/x.pdf", "/a/Бета/x.pdf", "x.pdf", "/x.pdf", None], ["Альфа Трак", "Бета", None, None, None]),
        (text.registry_cell, ["12.0", " x ", "", "1.50"], ["12", "x", None, "1.50"]),
        (text.collapse, ["  a \t b ", None], ["a b", None]),
        (text.clean_lines, ["a\r\n\r\n  b  c \rd"], ["a\nb c\nd"]),
        (text.vin_candidates, ["vin XTA12345678901234 and XTA12345678901234"], [["XTA12345678901234"]]),
        (text.quantity, ["2.5", "-1", "x", None], [2.5, 1.0, 1.0, 1.0]),
        (text.safe_filename, ["a b/c.pdf", "..", None], ["a_b_c.pdf", "file", "file"]),
        (text.vehicle_kind_of_plate, ["А123ВС116", "AB123456"], ["truck", "trailer"]),
        (text.plausible_order_number, ["ZN-1", "ab", "abc", None], [True, False, False, False]),
    ],
)
def test_rule(spark, rule, given, wanted):
    assert one(spark, rule, *given) == wanted


ORDER = "Заказ-наряд № ЗН-77 от 15.01.2025\nПробег: 120 000\nРаботы\nF12 Замена фильтра 1 шт 1 000,00 1 000,00\nЗапчасти\nФильтр масляный 2 шт 250,50 501,00\nИтого к оплате: 1501,00\n"


def test_lines_and_header(spark):
    d = spark.createDataFrame([(1, ORDER), (2, ""), (3, None)], "id long, text string")
    rows = extract.line_items(d).orderBy("line").collect()
    assert [(r["kind"], r["code"], r["quantity"], r["price"], r["line_total"]) for r in rows] == [("work", "F12", 1.0, 1000.0, 1000.0), ("part", None, 2.0, 250.5, 501.0)]
    got = {r["id"]: r for r in document.parsed(d).collect()}
    h = got[1]
    assert (h["order_number"], h["repair_date"], h["mileage"], h["grand_total"], h["plate_number"]) == ("ЗН-77", dt.date(2025, 1, 15), 120000, 1501.0, None)
    assert (h["confidence"], h["reasons"]) == ({"order_number": 0.74, "repair_date": 0.7, "mileage": 0.9, "grand_total": 0.8, "service_name": 0.58}, []) or h["service_name"] is None
    assert all((got[i]["order_number"], got[i]["reasons"]) == (None, ["order_number_missing", "repair_date_missing", "mileage_missing"]) for i in (2, 3))


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Зaкa3-нaряд N ЗН-7 oт 01.02.2024", {"order_number": "ЗН-7", "repair_date": dt.date(2024, 2, 1)}),
        ("Акт выполненных работ № 55-А\nДата закрытия: 5 марта 2024\nдата 01.01.2020", {"order_number": "55-А", "repair_date": dt.date(2024, 3, 5)}),
        ("Наряд-заказ ZN/1\nДата 45.01.2024 и 01.01.2020", {"order_number": "ZN/1", "repair_date": None}),
        ("Документ AB-123", {"order_number": "AB-123"}),
        ("Пробег, км: 123 456", {"mileage": 123456}),
        ("Одометр (км) 77 000\nАвтомобиль КАМАЗ\nпробег\n123 456 закрыт\nЗаказчик", {"mileage": 123456}),
        ("Автомобиль Х\nг/н: В 777 ВВ 77 VIN XTA12345678901234\nВладелец\nгосномер А 111 АА 11", {"plate_number": "В777ВВ77", "vin": "XTA12345678901234"}),
        ("прицеп АВ 1234 77 рядом", {"plate_number": "АВ123477"}),
        ("Стоимость работ: 1 000,50\nСтоимость запчастей 2 000\nНДС 20% 500,10\nВсего 3 500,60", {"work_total": 1000.5, "parts_total": 2000.0, "vat_total": None, "grand_total": 3500.6}),
        ("Исполнитель: ООО Альфа Сервис ИНН 77", {"service_name": "ООО Альфа Сервис"}),
        ("Исполнитель: 123456 итого", {"service_name": None}),
    ],
)
def test_forms_of_headers(spark, given, wanted):
    r = document.parsed(spark.createDataFrame([(1, given)], "id long, text string")).first()
    assert {k: r[k] for k in wanted} == wanted


def test_rules_go_before_patterns(spark):
    d = spark.createDataFrame([(1, ORDER + "Номер клиента: Q-1\nпробег неизвестен")], "id long, text string")
    r = document.parsed(d, [("order_number", r"клиента:\s*(\S+)", "raw", 1, 0.99), ("mileage", r"пробег\s+(неизвестен)", "digits_int", 1, 0.5), ("grand_total", "(нет такого)", "amount", 1)]).first()
    assert (r["order_number"], r["confidence"]["order_number"], r["mileage"], r["grand_total"]) == ("Q-1", 0.99, 120000, 1501.0)


def test_totals_are_reconciled_with_lines(spark):
    conf, none = {"grand_total": 0.8}, []
    rows = [(1, None, None, None, 30.0, conf, none, none), (2, 11.0, 21.0, None, 30.0, conf, none, none), (3, 11.0, 21.0, None, 32.0, conf, none, none), (4, 11.0, None, None, None, conf, none, none)]
    p = spark.createDataFrame(rows, "id long, work_total double, parts_total double, vat_total double, grand_total double, confidence map<string,double>, reasons array<string>, notes array<string>")
    sums = spark.createDataFrame([(1, 10.0, None), (2, 10.0, 20.0), (3, 10.0, 20.0), (4, None, 5.0)], "id long, works double, parts double")
    got = {r["id"]: r for r in document.reconciled(p, sums).collect()}
    assert {i: (r["work_total"], r["parts_total"]) for i, r in got.items()} == {1: (10.0, None), 2: (10.0, 20.0), 3: (11.0, 21.0), 4: (11.0, 5.0)}
    assert got[2]["notes"] == ["work_total_aligned_with_lines", "parts_total_aligned_with_lines"] and got[1]["confidence"]["work_total"] == 0.68


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Запчасти\nБолт 4 штук 10,00 40,00", [("part", "Болт", 4.0, "штук", 40.0)]),
        ("Работы\nПромывка 2 час 10,00 20,00\nСход 1,5 н/ч 10 15", [("work", "Промывка", 2.0, "ч", 20.0), ("work", "Сход", 1.5, "нч", 15.0)]),
        ("Материалы\nМасло 4 литр 10 40\nРемни 1 к-т 5 5\nСалфетки 1 упак. 7 7\nХомут 2 3 6", [("part", "Масло", 4.0, "литр", 40.0), ("part", "Ремни", 1.0, "компл", 5.0), ("part", "Салфетки", 1.0, "упак", 7.0), ("part", "Хомут", 2.0, None, 6.0)]),
        ("Запчасти\nБолт 1 шт 1 1\nОказанные услуги\nМойка 1 усл 9 9\nСварочные работы 1 ч 8 8", [("part", "Болт", 1.0, "шт", 1.0), ("work", "Мойка", 1.0, "усл", 9.0), ("work", "Сварочные работы", 1.0, "ч", 8.0)]),
        ("Работа: Замена 1 ч 1 000,00 1 000,00\nЗапчасть: Болт 2 шт 5 10", [("work", "Замена", 1.0, "ч", 1000.0), ("part", "Болт", 2.0, "шт", 10.0)]),
        ("Работы\nМойка 1 ч 9 9\nИтого работ 9\nСушка 1 ч 8 8\nЗапчасти\nTotal Quartz 4 л 5 20\nTotal 3 1 3\nРаботы итого 1 000 000,00", [("work", "Мойка", 1.0, "ч", 9.0), ("work", "Сушка", 1.0, "ч", 8.0), ("part", "Total Quartz", 4.0, "л", 20.0)]),
        ("Заказ 7 Работы: Мойка 1 ч 9,00 9,00 Замена запчасти 2 ч 1 000,00 2 000,00 Запчасти Болт\n2 шт 5 10 Гайка 1 шт 3 3 Итого к оплате 5 000 000,00", [("work", "Мойка", 1.0, "ч", 9.0), ("work", "Замена запчасти", 2.0, "ч", 2000.0), ("part", "Болт", 2.0, "шт", 10.0), ("part", "Гайка", 1.0, "шт", 3.0)]),
        ("Работы: Мойка 1 ч 9 9\nЗапчасти: Болт 2 шт 5 10", [("work", "Мойка", 1.0, "ч", 9.0), ("part", "Болт", 2.0, "шт", 10.0)]),
        ("Работа Мойка 1 ч 9 9 Запчасть Болт 2 шт 5 10", [("work", "Мойка", 1.0, "ч", 9.0), ("part", "Болт", 2.0, "шт", 10.0)]),
        ("Пробег 5 км 6 7", []),
    ],
)
def test_forms_of_lines(given, wanted):
    got = extract.parse_lines(given)
    assert [(x["kind"], x["name"], x["quantity"], x["unit"], x["line_total"]) for x in got] == wanted
    assert [x["line"] for x in got] == list(range(1, len(got) + 1))


def test_total_after_long_bodies(spark):
    body = "".join(f"Деталь {i} 2 шт 250,50 501,00\n" for i in range(400))
    assert len(body) > 10_000
    long = "Заказ-наряд № ЗН-78 от 16.01.2025\nЗапчасти\n" + body + "Пробег: 99\nИтого к оплате: 200 400,00\n"
    h = document.parsed(spark.createDataFrame([(1, long)], "id long, text string")).first()
    assert (h["order_number"], h["grand_total"], h["confidence"]["grand_total"]) == ("ЗН-78", 200400.0, 0.8)
    assert h["mileage"] is None  # the window of the other fields stays


def test_rules_of_users(spark):
    d = spark.createDataFrame([(1, ORDER), (2, None)], "id long, text string")
    got = {r["field"]: r["value"] for r in extract.rule_matches(d, [("total", r"оплате:\s*([\d,]+)", "amount", 2), ("total", r"Пробег", "amount", 1), ("bad", "([", "raw", 1), ("day", r"от\s+(\S+)", "date", 1)]).collect()}
    assert got == {"total": None, "day": "2025-01-15"}  # the first match decides, readable or not


def test_mojibake(spark):
    bad = "заказ-наряд".encode().decode("latin-1")
    assert one(spark, extract.repaired, bad, "fine", None) == ["заказ-наряд", "fine", None]
