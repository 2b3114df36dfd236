"""Operators on a few rows written out: null joins, ties, upserts, transitions, the streaming queue, files in and out."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from wrenchfield.operators import checks, dashboard, filters, history, latest, mutations, resolve, review
from wrenchfield.sources import files
from wrenchfield.streaming import queue

DAY = dt.date(2025, 2, 1)


def test_visibility_of_placeholder_and_assignment(spark):
    repairs = spark.createDataFrame([(1, 10, 5), (2, 20, 5), (3, 99, 5), (4, 99, 6), (5, None, 5)], "id long, vehicle_id long, created_by_user_id long")
    vehicles = spark.createDataFrame([(10, "truck-1"), (20, "truck-2"), (99, filters.PLACEHOLDER)], "id long, external_id string")
    assigned = spark.createDataFrame([(5, 10, dt.date(2025, 1, 1), None), (5, 20, dt.date(2024, 1, 1), dt.date(2025, 1, 31)), (5, 10, dt.date(2025, 1, 5), DAY)], "user_id long, vehicle_id long, starts_at date, ends_at date")
    seen = lambda **k: sorted(r["id"] for r in filters.visible_repairs(repairs, assigned, vehicles, 5, DAY, **k).collect())
    assert seen() == [1, 3]
    assert seen(own=False) == [1]
    assert seen(admin=True) == [1, 2, 3, 4, 5]


def test_vehicle_resolution(spark):
    vehicles = spark.createDataFrame([(1, "V1", "A123BC116"), (2, "V2", "B777BB77"), (3, None, "B777BB77"), (4, None, "C001CC")], "id long, vin string, plate_number string")
    asked = spark.createDataFrame([(1, "V1", None), (2, None, "b777bb77"), (3, None, "C001CC99"), (4, None, "zz"), (5, None, None)], "id long, vin string, plate string")
    got = {r["id"]: (r["vehicle_id"], r["exact_hits"]) for r in resolve.vehicle_by_vin_or_plate(asked, vehicles).collect()}
    assert got == {1: (1, 1), 2: (None, 2), 3: (4, 0), 4: (None, 0), 5: (None, 0)}


def test_upsert_keeps_what_null_would_erase(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "code string, hours double, category string")
    new = spark.createDataFrame([("a", 5.0, None, 1), ("a", 3.0, None, 2), ("c", None, "z", 1), ("b", 2.0, "y", 1)], "code string, hours double, category string, row int")
    got = mutations.upsert(old, new, ["code"], "row")
    assert {tuple(r) for r in got.collect()} == {("a", 3.0, "x", "updated"), ("b", 2.0, "y", "kept"), ("c", None, "z", "created")}
    assert tuple(mutations.outcomes(got).first()) == (1, 1, 1)


def test_history_headers():
    class Frame:
        columns = ["plate"]

    with pytest.raises(ValueError):
        mutations.check_headers(Frame())


def test_latest_and_ties(spark):
    v = spark.createDataFrame([(1, 7, 1, "p"), (2, 7, 2, "q"), (3, 7, 2, "r")], "id long, document_id long, version_number int, profile string")
    assert [r["profile"] for r in latest.latest_version(v).collect()] == ["r"]


def test_report_collects_few_findings_of_a_hot_repair(spark):
    found = spark.range(20_000).select(F.when(F.col("id") % 100 > 0, 1).otherwise(2).cast("long").alias("repair_id"), F.when(F.col("id") == 7, "high").otherwise("medium").alias("level"), F.format_string("t%05d", "id").alias("title"), F.format_string("r%d", F.col("id") % 9).alias("recommendation"))
    repairs = spark.createDataFrame([(1, 1234.5), (2, 0.0), (3, 10.0)], "id long, grand_total double")
    lines = spark.createDataFrame([(1, "work"), (1, "work"), (1, "part")], "repair_id long, kind string")
    checks = spark.createDataFrame([(2, False), (2, True)], "repair_id long, is_resolved boolean")
    got = {r["repair_id"]: r for r in review.report(repairs, lines, checks, found).collect()}
    assert (got[1]["risk"], got[1]["findings"], got[1]["highlights"], got[1]["recommendations"]) == ("high", 19_800, "Сумма заказ-наряда: 1 234,50 ₽;Работ: 2 · запчастей: 1;Открытых проверок: 0;t00007;t00001", "r7;r1;r2;r3;r4;r5")
    assert (got[2]["risk"], got[2]["findings"]) == ("medium", 200) and "Открытых проверок: 1;t00000;t00100" in got[2]["highlights"]
    assert (got[3]["risk"], got[3]["findings"], got[3]["recommendations"]) == ("low", 0, "")
    assert "WindowGroupLimit" in review.report(repairs, lines, checks, found)._jdf.queryExecution().optimizedPlan().toString()  # before anything is collected


def test_findings_name_symptoms_without_a_repair(spark):
    repairs = spark.createDataFrame([(1, "Горит ABS, прочее", None), (2, "Скрип тормозов", None), (3, None, None)], "id long, reason string, source_document_id long")
    lines = spark.createDataFrame([(1, "work", "Тех тул"), (1, "work", "Диагностика"), (2, "part", "Колодки тормозные"), (2, "part", "Фара"), (3, "part", "Фара")], "repair_id long, kind string, name string")
    checks = spark.createDataFrame([(1, 1, "ocr_duplicate_work_lines", "warning", False, "a"), (2, 1, "ocr_duplicate_part_lines", "warning", False, "b"), (3, 2, "ocr_vehicle_missing", "error", False, "c"), (4, 2, "x", "normal", True, "d")], "id long, repair_id long, check_type string, severity string, is_resolved boolean, title string")
    documents = spark.createDataFrame([(9, 3, False, 0.5, "text_not_found", None), (8, 3, True, 0.9, "mileage_missing", None)], "id long, repair_id long, is_primary boolean, ocr_confidence double, reason_1 string, reason_2 string")
    shares = spark.createDataFrame([(2, "Колодки тормозные", 50.0, 1), (2, "Фара", 40.0, 2), (3, "Фара", 9.0, 1)], "repair_id long, name string, line_total double, rank int")
    got = sorted((r["repair_id"], r["turn"], r["level"]) for r in review.findings(checks, repairs, lines, documents, shares).collect())
    assert got == [(1, 1, "high"), (1, 2, "high"), (1, 3, "medium"), (1, 4, "medium"), (2, 1, "high"), (2, 5, "medium"), (3, 7, "low")]


@pytest.mark.parametrize(
    ("role", "action", "wanted"),
    [
        ("employee", "employee_confirm", ("confirmed", "employee_confirmed", 60, True)), ("admin", "employee_confirm", None), ("admin", "confirm", ("confirmed", "confirmed", 20, True)), ("employee", "confirm", None),
        ("employee", "send_to_review", ("needs_review", "in_review", 120, False)), ("admin", "archive", None),
    ],
)
def test_review_actions(spark, role, action, wanted):
    got = spark.range(1).select(review.review_action(F.lit(role), F.lit(action)).alias("x")).first()["x"]
    assert (tuple(got) if got else None) == wanted


def test_vehicle_resolution_variants(spark):
    v = spark.createDataFrame([(1, "t1", "XTA12345678901234", "A123BC116"), (2, "t2", None, "B777BB77"), (3, None, None, "B777BB77"), (4, "t4", None, "C001CC99"), (5, filters.PLACEHOLDER, None, "P000PP00"), (6, "t6", None, "D1"), (7, "t7", None, "D1"), (8, "t8", None, "D1")], "id long, external_id string, vin string, plate_number string")
    asked = spark.createDataFrame([(1, "xta12345678901234", "C001CC99"), (2, None, "b777 bb77"), (3, None, "P000PP00"), (4, None, None), (5, "XTA12345678901234", "A123BC116")], "id long, vin string, plate string")
    got = {r["id"]: (r["vehicle_id"], r["is_conflict"]) for r in resolve.vehicle_or_conflict(asked, v, filters.PLACEHOLDER).collect()}
    assert got == {1: (None, True), 2: (None, True), 3: (None, False), 4: (None, False), 5: (1, False)}
    files_ = spark.createDataFrame([(1, None, "zz", "C001CC99 order XTA12345678901234.pdf"), (2, None, "b777bb77", "C001CC99.pdf"), (3, None, None, "scan C001CC99.pdf"), (4, "nothing", None, None)], "id long, vin string, plate string, filename string")
    assert {r["id"]: r["vehicle_id"] for r in resolve.vehicle_of_file(files_, v, filters.PLACEHOLDER).collect()} == {1: 1, 2: 2, 3: 4, 4: None}
    plates = spark.createDataFrame([(1, "A123BC116"), (2, "B777BB77"), (3, "C001CC"), (4, "D1"), (5, "D1XXXX99"), (6, "C0"), (7, None)], "id long, plate string")
    assert {r["id"]: r["vehicle_id"] for r in resolve.vehicle_of_import(plates, v).collect()} == {1: 1, 2: None, 3: 4, 4: 8, 5: None, 6: None, 7: None}


def test_services_by_folder(spark):
    services = spark.createDataFrame([("ООО «Альфа Трак Сервис»", None, "confirmed"), ("Бета", 7, "confirmed"), ("Гамма", 7, "archived")], "name string, created_by_user_id long, status string")
    names = spark.createDataFrame([(1, "альфа трак-сервис"), (2, "АТС"), (3, "бета"), (4, "гамма"), (5, None)], "id long, name string")
    assert {r["id"]: r["service"] for r in resolve.service_by_alias(names, services).collect()} == {1: "ООО «Альфа Трак Сервис»", 2: "ООО «Альфа Трак Сервис»", 3: "Бета", 4: None, 5: None}
    repairs = spark.createDataFrame([(1, 11), (2, None), (3, None)], "id long, source_document_id long")
    documents = spark.createDataFrame([(10, 1, True), (11, 1, False), (20, 2, False), (21, 2, True), (30, 3, True)], "id long, repair_id long, is_primary boolean")
    versions = spark.createDataFrame([(10, 1, "/in/Бета/a.pdf"), (11, 1, "/in/x/a.pdf"), (11, 2, "/in/Заказ наряды АТС/a.pdf"), (20, 1, "/in/Заказ-наряды_АТС/b.pdf"), (21, 1, "/in/nobody/b.pdf"), (30, 1, "c.pdf")], "document_id long, version_number int, source_path string")
    assert {r["repair_id"]: r["service"] for r in resolve.service_backfill(repairs, documents, versions, services).collect()} == {1: "ООО «Альфа Трак Сервис»", 2: "ООО «Альфа Трак Сервис»"}


def test_enqueue_reuses_and_retries(spark):
    asked = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "document_id long, retry boolean")
    last = spark.createDataFrame([(1, 11, "queued"), (2, 12, "failed"), (3, 13, "failed")], "document_id long, id long, status string")
    assert {tuple(r) for r in mutations.enqueued(asked, last).collect()} == {(1, 11, "reused"), (2, 12, "retried"), (3, None, "created"), (4, None, "created")}


def test_children_do_not_multiply(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id long, a string")
    b = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "id long, b int")
    got = {r["id"]: r for r in dashboard.nested(p, "id", works=a, parts=b).collect()}
    assert (len(got[1]["works"]), len(got[1]["parts"]), got[2]["works"]) == (2, 3, None)


def test_stream_of_jobs(spark, tmp_path):
    spark.createDataFrame([(1, "queued"), (2, "done")], "id long, status string").write.parquet(f"{tmp_path}/in")
    stream = queue.arrivals(spark, f"{tmp_path}/in", "id long, status string")
    for _ in range(2):  # what has been worked on is not taken again
        queue.process(stream, lambda b: b.where("status = 'queued'"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]


def test_stream_of_actions(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 1, 3), "a"), (dt.datetime(2025, 1, 1, 9), "a"), (dt.datetime(2025, 1, 2, 1), "b")]
    spark.createDataFrame(rows, "created_at timestamp, action_type string").write.parquet(f"{tmp_path}/in")
    stream = queue.daily_actions(spark.readStream.schema("created_at timestamp, action_type string").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("daily_actions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    q.awaitTermination()
    assert sorted((r["action_type"], r["n"]) for r in spark.table("daily_actions").collect()) == [("a", 2), ("b", 1)]


def test_files(spark, tmp_path):
    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(rb"(Order \(7\)) Tj") + b"\nendstream"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(pdf)
    (tmp_path / "in/b.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "in/notes.txt").write_bytes(b"x")
    got = {r["name"]: r for r in files.folder(spark, f"{tmp_path}/in").withColumn("text", files.pdf_text("content")).collect()}
    assert {n: r["kind"] for n, r in got.items()} == {"a.pdf": "pdf", "b.png": "png"}
    assert got["a.pdf"]["text"] == "Order (7)"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Service Alpha</w:t></w:r></w:p><w:p><w:r><w:t>Адрес: Kazan 1</w:t></w:r></w:p></w:document>')
    d = spark.createDataFrame([(bytearray(held.getvalue()),), (bytearray(b"no zip"),)], "content binary").select(files.docx_text("content").alias("t"))
    cards = d.select(files.service_card(F.col("t")).alias("c")).select("c.name", "c.address").collect()
    assert tuple(cards[0]) == ("Service Alpha", "Kazan 1")
    assert cards[1]["address"] is None


def test_norm_list(spark, tmp_path):
    (tmp_path / "n.csv").write_text("﻿code,category,source_sheet,name_ru,name_ru_alt,name_cn,name_en,standard_hours\nA1,engine,,Замена масла,,,Oil change,\"1,5\"\nA2,engine,s,,,,,2\n", encoding="utf-8")
    rows = files.norm_csv(spark, f"{tmp_path}/n.csv").collect()
    assert [(r["code"], r["source_sheet"], r["standard_hours"]) for r in rows] == [("A1", "engine", 1.5)]


def test_snapshot_round_trip(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1, dt.date(2025, 1, 1), None)], "id long, d date, s string"), "b": spark.createDataFrame([], "id long")}
    assert files.snapshot(t, f"{tmp_path}/s").count() == 2
    back = files.restored(spark, f"{tmp_path}/s")
    for n, df in t.items():
        assert back[n].schema == df.schema
        assert back[n].collect() == df.collect()


def test_bars_and_changes(spark):
    row = spark.range(1).select(dashboard.bars(F.lit(5), F.lit(0), F.lit(2)).alias("b"), dashboard.changed_fields(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(3))).alias("c")).first()
    assert [tuple(x) for x in row["b"]] == [("confirmed", 3), ("suspicious", 2)]
    assert row["c"] == ["b", "c"]


def test_relinking_and_primary_documents(spark):
    repairs = spark.createDataFrame([(1, 9), (2, 9), (3, 5)], "id long, vehicle_id long")
    vehicles = spark.createDataFrame([(9, filters.PLACEHOLDER), (5, "t5"), (6, "t6")], "id long, external_id string")
    documents = spark.createDataFrame([(10, 1, True), (11, 1, False), (12, 2, True), (13, 3, True)], "id long, repair_id long, is_primary boolean")
    matches = spark.createDataFrame([(11, 6), (10, None), (13, 6)], "id long, vehicle_id long")
    assert {r["id"]: r["vehicle_id"] for r in checks.relinked(repairs, documents, matches, vehicles, filters.PLACEHOLDER).collect()} == {1: 6, 2: 9, 3: 5}
    chosen = spark.createDataFrame([(11,)], "id long")
    assert {r["id"]: r["is_primary"] for r in checks.primary_switched(documents, chosen).collect()} == {10: False, 11: True, 12: True, 13: True}


def test_assigning_a_service_settles_checks(spark):
    rows = [(1, 1, "ocr_service_not_found", False), (2, 1, "ocr_service_missing", False), (3, 2, "ocr_service_not_found", False), (4, 3, "ocr_service_missing", True), (5, 4, "x", False)]
    now = spark.createDataFrame(rows, "id long, repair_id long, check_type string, is_resolved boolean")
    repairs = spark.createDataFrame([(1, 7), (2, None), (3, None)], "repair_id long, service_id long")
    got = {(r["repair_id"], r["check_type"]): r["is_resolved"] for r in checks.service_assigned(now, repairs).collect()}
    assert got == {(1, "ocr_service_not_found"): True, (1, "ocr_service_missing"): True, (2, "ocr_service_not_found"): True, (2, "ocr_service_missing"): False, (3, "ocr_service_missing"): False, (4, "x"): False}


def test_catalogues_keep_what_is_not_set(spark):
    old = spark.createDataFrame([("a", "A", "fam", "truck", 1990, None, 5, False, "confirmed")], "scope string, catalog_name string, brand_family string, vehicle_type string, year_from int, year_to int, priority int, auto_match boolean, status string")
    norms = spark.createDataFrame([("a", "n1", "old", "old"), ("z", "n2", "kept", "kept")], "scope string, code string, catalog_name string, brand_family string")
    new, synced = mutations.upserted_catalogues(old, {"a": {"year_from": None, "brand_family": None}, "b": {"priority": 7}}, norms)
    assert {tuple(r) for r in new.collect()} == {("a", "A", None, "truck", None, None, 5, False, "confirmed"), ("b", "b", None, None, None, None, 7, True, "confirmed")}
    assert {tuple(r) for r in synced.select("code", "catalog_name", "brand_family").collect()} == {("n1", "A", None), ("n2", "kept", "kept")}


def test_replaced_rows(spark):
    old = spark.createDataFrame([(1, "ocr_a"), (1, "by hand"), (2, "ocr_b")], "repair_id long, t string")
    new = spark.createDataFrame([(1, "ocr_c")], "repair_id long, t string")
    got = sorted(map(tuple, mutations.replaced(old, new, "repair_id", "t like 'ocr_%'").collect()))
    assert got == [(1, "by hand"), (1, "ocr_c"), (2, "ocr_b")]


def test_medians_without_own_values(spark):
    import statistics

    rows = [("a", float(v)) for v in (1, 1, 2, 3, 5, 8, 13, 13, 13, 21)] + [("b", -2.5), ("b", 0.0), ("b", 7.0), ("c", 4.0)]
    d = spark.createDataFrame(rows, "key string, value double").withColumn("n", F.lit(1))
    own = [("a", [13.0, 1.0]), ("a", []), ("a", [21.0, 13.0, 13.0]), ("b", [0.0]), ("b", [-2.5, 7.0]), ("c", [4.0]), ("c", [])]
    width = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "key string, wide int")
    asked = spark.createDataFrame([(i, *o) for i, o in enumerate(own)], "i int, key string, own array<double>")
    got = {r["i"]: r["m"] for r in asked.join(history.middles(d, ["key"], width), "key").select("i", history.median_without(F.col("size"), F.col("middle"), F.col("own")).alias("m")).collect()}
    for i, (key, gone) in enumerate(own):
        left = [v for k, v in rows if k == key]
        for g in gone:
            left.remove(g)
        assert got[i] == (statistics.median(left) if left else None)
