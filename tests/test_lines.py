"""Orders' lines as rows against whole texts; a long order in little memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from wrenchfield.functions import extract

PIECES = ["Работы:", "Запчасти", "Замена масла 1 шт 100,00 100,00", "AB-12 Фильтр 2 шт 1 000,50 2 001,00", "Работа: диагностика 1,5 нч 1000 1500", "просто строка", "Итого: 3 500,00", "Услуги: мойка 1 шт 500 500, покраска 2 ч 10 20", "", "Исполнитель ООО Трак", "Parts", "Запчасть: болт 4 10,00 40,00", "ЗИП 1 2"]


def test_rows_give_the_items_of_texts(spark):
    rng = np.random.default_rng(3)
    orders = {i: [PIECES[j] for j in rng.integers(0, len(PIECES), int(rng.integers(0, 14)))] for i in range(120)}
    orders[500] = ["работы: мойка 1 шт 500 500", "и сушка 1 шт 5 5 запчасти: болт 4 шт 10 40"]
    rows = [(i, n, line) for i, lines in orders.items() for n, line in enumerate(lines)] + [(None, 1, "Работы:"), (None, 2, "мойка 1 шт 500 500"), (7_000, 1, None), (7_001, 1, "Работы:\nмойка 1 шт 500 500")]
    got = extract.line_items_of_rows(spark.createDataFrame(rows, "id long, line_no int, text string").repartition(5)).collect()
    want = [(i, *x.values()) for i, lines in [*orders.items(), (None, ["Работы:", "мойка 1 шт 500 500"]), (7_001, ["Работы:\nмойка 1 шт 500 500"])] for x in extract.parse_lines("\n".join(lines))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(want) > 200
    assert extract.line_items_of_rows(spark.createDataFrame([], "id long, line_no int, text string")).count() == 0


def test_an_order_of_many_lines_is_never_held():
    tracemalloc.start()
    order = extract.Order()
    order.read("Работы:")
    n = sum(len(order.read(f"мойка номер {i} 1 шт 500 500")) for i in range(50_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == order.count == 50_000 and not order.unread and peak < 1_000_000


def test_a_hot_order(spark):
    lines = spark.range(200_000).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, "Работы:").otherwise(F.format_string("мойка %d 1 шт 500 500", "id")).alias("text"))
    out = extract.line_items_of_rows(lines)
    assert out.agg(F.count("*"), F.max("line"), F.count_distinct("name")).first() == (199_999, 199_999, 199_999)


def test_lines_that_orders_share_are_judged_once():
    extract._signs.cache_clear()
    for _ in range(50):
        assert [x["name"] for x in extract.parse_lines("Работы:\nмойка 1 шт 500 500\nИтого работ 1 шт 100,00 100,00\nЗапчасти и материалы\nболт 4 шт 10 40\nИтого: 3 500,00")] == ["мойка", "болт"]
    assert extract._signs.cache_info().misses == 4


def test_every_sign_has_a_root():
    """Letters that only case folding makes alike, too."""
    lines = ["Partſ", "ᲂплате", "К ᲂПЛАТЕ", "итᲂгᲂ", "LABOR", "materıals", "ЗАПАСНЫЕ ЧАСТИ", "всего", "Grand Total", "total parts", "Запчасть:", "1) работа: x", "Услуги: x", "WORKS"]
    for line in lines:
        assert not any(extract._signs(line)) or extract._ROOTS.search(line.casefold()), line
    assert any(any(extract._signs(line)) for line in lines)
