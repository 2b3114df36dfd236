"""The fleet domain over the star-schema tables: each view is one SQL text, read by Spark and by the oracle alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: In order of dependence.
VIEWS: dict[str, str] = {
    "vehicles": """SELECT CAST(c_custkey AS BIGINT) AS id, concat('unit-', CAST(c_custkey AS STRING)) AS external_id,
      CASE WHEN c_custkey % 3 = 0 THEN 'trailer' ELSE 'truck' END AS vehicle_type,
      CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('VIN', CAST(100000 + c_custkey % 997 AS STRING)) END AS vin,
      CASE WHEN c_custkey % 10 < 2 THEN concat('P', CAST(100000 + (c_custkey - c_custkey % 2) AS STRING)) WHEN c_custkey % 10 < 5 THEN concat('P', CAST(100002 + (c_custkey - c_custkey % 10) AS STRING))
        WHEN c_custkey % 10 = 6 THEN concat('P', CAST(100000 + c_custkey AS STRING), 'A') WHEN c_custkey % 10 = 7 THEN concat('P', CAST(99999 + c_custkey AS STRING)) ELSE concat('P', CAST(100000 + c_custkey AS STRING)) END AS plate_number, c_mktsegment AS brand,
      concat('M', CAST(c_nationkey AS STRING)) AS model, CAST(1990 + c_custkey % 35 AS INT) AS year, CAST(c_nationkey AS INT) AS column_no,
      CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS status, c_acctbal AS balance FROM customer""",
    "services": """SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, n_name AS city, CASE WHEN s_suppkey % 11 = 0 THEN 'archived' WHEN s_acctbal < 2000 THEN 'preliminary' ELSE 'confirmed' END AS status,
      CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 150 AS BIGINT) END AS created_by_user_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 7 AS BIGINT) END AS confirmed_by_user_id
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "repairs": """SELECT CAST(o_orderkey AS BIGINT) AS id, concat('ZN-', CAST(o_orderkey AS STRING)) AS order_number, CAST(o_orderdate AS DATE) AS repair_date, CAST(o_custkey AS BIGINT) AS vehicle_id,
      CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS BIGINT) END AS service_id, CAST(o_orderkey % 150 AS BIGINT) AS created_by_user_id, CAST((o_orderkey * 37) % 300000 AS BIGINT) AS mileage,
      CASE WHEN o_orderkey % 5 = 0 THEN concat('historical_import:', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 9 = 0 THEN 'diagnostics' WHEN o_orderkey % 7 = 0 THEN 'Утечка воздуха' WHEN o_orderkey % 11 = 0 THEN 'Не работает ABS' WHEN o_orderkey % 13 = 1 THEN 'Прочее' ELSE 'engine noise' END AS reason, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS BIGINT) END AS source_document_id,
      CAST(o_totalprice AS DOUBLE) AS grand_total, CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_totalprice * 10) AS DOUBLE) / 100 ELSE 0.0 END AS vat_total, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'in_review' ELSE 'suspicious' END AS status,
      o_orderkey % 6 = 0 AS is_partially_recognized, o_orderpriority AS priority FROM orders""",
    "repair_lines": """SELECT CAST(l_orderkey AS BIGINT) AS repair_id, CASE WHEN l_linenumber % 2 = 1 THEN 'work' ELSE 'part' END AS kind, CASE WHEN p_partkey % 4 = 0 OR l_orderkey % 97 = 0 THEN NULL ELSE p_brand END AS code,
      CASE WHEN l_orderkey % 97 = 0 THEN concat(p_name, ' of ', CAST(l_orderkey AS STRING), 'x', CAST(l_linenumber AS STRING)) WHEN l_partkey % 37 = 0 THEN concat(p_name, ' abs sensor') WHEN l_partkey % 41 = 0 THEN concat(p_name, ' tech tool scan') ELSE p_name END AS name, CAST(l_quantity AS DOUBLE) AS quantity, CASE WHEN l_partkey % 3 = 0 THEN 'нч' ELSE 'шт' END AS unit,
      CAST(l_extendedprice / l_quantity AS DOUBLE) AS price, CAST(l_extendedprice AS DOUBLE) AS line_total, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS standard_hours,
      CASE WHEN l_partkey % 3 = 0 THEN CAST(l_quantity AS DOUBLE) / 2 ELSE NULL END AS actual_hours, CAST(l_partkey AS BIGINT) AS part_id, CAST(l_linenumber + 100 * again AS INT) AS line_no
      FROM lineitem JOIN part ON l_partkey = p_partkey CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1 AS again) x WHERE again = 0 OR (l_orderkey * 7 + l_linenumber) % 101 = 0""",
    "documents_d": """SELECT CAST(doc_id AS BIGINT) AS id, CAST(doc_id AS BIGINT) AS repair_id, concat(source, '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.pdf' END) AS original_filename, source,
      CASE doc_id % 6 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'recognized' WHEN 2 THEN 'partially_recognized' WHEN 3 THEN 'needs_review' WHEN 4 THEN 'ocr_error' ELSE 'confirmed' END AS status,
      CASE doc_id % 4 WHEN 0 THEN 'order' WHEN 1 THEN 'repeat_scan' WHEN 2 THEN 'attachment' ELSE 'order' END AS kind, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE CAST(n_chars % 100 AS DOUBLE) / 100 END AS ocr_confidence,
      doc_id % 2 = 0 AS is_primary, CAST(CASE WHEN doc_id % 5 = 0 THEN 20 ELSE 100 END AS BIGINT) AS review_queue_priority, CAST(n_chars AS BIGINT) AS n_chars, CAST(doc_id % 150 AS BIGINT) AS uploaded_by_user_id,
      CASE doc_id % 5 WHEN 0 THEN 'order_number_missing' WHEN 1 THEN 'text_not_found' WHEN 2 THEN 'unknown_reason' ELSE NULL END AS reason_1, CASE WHEN doc_id % 3 = 0 THEN 'pdf_ocr_unavailable' WHEN doc_id % 3 = 1 THEN 'mileage_missing' ELSE NULL END AS reason_2 FROM documents""",
    "extracted": """SELECT d.id AS document_id, d.repair_id, CASE d.id % 4 WHEN 0 THEN NULL WHEN 1 THEN r.order_number ELSE concat(r.order_number, 'X') END AS order_number, CASE WHEN d.id % 3 = 0 THEN NULL ELSE r.repair_date END AS repair_date, CASE WHEN d.id % 5 = 0 THEN NULL ELSE r.mileage + d.id % 2 END AS mileage,
      CASE WHEN d.id % 7 = 0 THEN NULL ELSE s.name END AS service_name, CASE WHEN d.id % 3 = 1 THEN NULL ELSE CAST(d.id % 900 AS DOUBLE) + 0.5 END AS work_total, CASE WHEN d.id % 6 = 2 THEN NULL ELSE CAST(d.id % 700 AS DOUBLE) + 0.25 END AS parts_total, r.vat_total, CASE WHEN d.id % 2 = 0 THEN r.grand_total ELSE NULL END AS grand_total,
      CASE d.id % 4 WHEN 0 THEN concat('р ', substr(v.plate_number, 2)) WHEN 1 THEN 'X000XX00' WHEN 2 THEN NULL ELSE v.plate_number END AS plate_number FROM documents_d d JOIN repairs r ON r.id = d.repair_id JOIN vehicles v ON v.id = r.vehicle_id LEFT JOIN services s ON s.id = r.service_id""",
    "document_versions": """SELECT CAST(doc_id * 10 + v AS BIGINT) AS id, CAST(doc_id AS BIGINT) AS document_id, CAST(v AS INT) AS version_number, CASE WHEN (doc_id + v) % 3 = 0 THEN '' ELSE concat('/in/', source, '/', CAST(v AS STRING)) END AS source_path,
      concat('profile', CAST((doc_id * v) % 4 AS STRING)) AS profile, CAST((doc_id * 31 + v * 7) % 5000 AS DOUBLE) AS grand_total, CASE WHEN (doc_id + v) % 4 = 0 THEN NULL ELSE concat('ZN-', CAST(doc_id % 50 * v AS STRING)) END AS order_number
      FROM documents CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v UNION ALL SELECT 3 AS v) x WHERE v <= 1 + doc_id % 3""",
    "import_jobs": """SELECT CAST(doc_id * 4 + v AS BIGINT) AS id, CAST(doc_id AS BIGINT) AS document_id, CASE (doc_id + v) % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' WHEN 2 THEN 'retry' WHEN 3 THEN 'processing' ELSE 'completed' END AS status, CAST(doc_id % 3 AS INT) AS attempts
      FROM documents CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) x WHERE v <= 1 + doc_id % 2""",
    "import_conflicts": """SELECT CAST(id * 3 AS BIGINT) AS id, id AS import_job_id, CASE WHEN id % 2 = 0 THEN 'vehicle' ELSE 'repair' END AS entity_type, concat('k', CAST(id % 40 AS STRING)) AS conflict_key, CASE WHEN id % 3 = 0 THEN 'resolved' ELSE 'pending' END AS status
      FROM import_jobs WHERE status IN ('failed', 'retry')""",
    "repair_checks": """SELECT CAST(doc_id * 2 + k AS BIGINT) AS id, CAST(doc_id AS BIGINT) AS repair_id, CASE (doc_id + 5 * k) % 10 WHEN 0 THEN 'ocr_total_mismatch' WHEN 1 THEN 'ocr_work_reference_missing' WHEN 2 THEN 'ocr_repeat_repair_detected' WHEN 3 THEN 'ocr_vehicle_missing' WHEN 4 THEN 'ocr_expected_total_exceeded'
        WHEN 5 THEN 'ocr_work_reference_price_deviation' WHEN 6 THEN 'ocr_duplicate_work_lines' WHEN 7 THEN 'ocr_service_not_found' WHEN 8 THEN 'ocr_standard_hours_exceeded' ELSE 'ocr_text_not_found' END AS check_type,
      CASE WHEN k = 0 AND toxic = 1 THEN 'suspicious' WHEN k = 1 AND quality = 0 THEN 'error' ELSE 'warning' END AS severity, (doc_id + k) % 4 = 0 AS is_resolved, concat('check ', CAST((doc_id + k) % 6 AS STRING)) AS title, CAST('2024-01-01' AS DATE) + CAST(doc_id * 3 % 7 + k AS INT) AS created_at
      FROM labels CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x""",
    "audit_log": """SELECT CAST(event_id AS BIGINT) AS id, ts AS created_at, CAST(user_id AS BIGINT) AS user_id, event_type AS action_type, CASE event_id % 3 WHEN 0 THEN 'repair' WHEN 1 THEN 'document' ELSE 'vehicle' END AS entity_type,
      CAST(user_id AS STRING) AS entity_id, props AS new_value, CAST(value AS DOUBLE) AS value FROM events""",
    "users": """SELECT CAST(user_id AS BIGINT) AS id, concat('User ', CAST(user_id AS STRING)) AS full_name, concat(CASE WHEN user_id % 10 = 0 THEN 'TEAM' ELSE concat('u', CAST(user_id AS STRING)) END, '@Example.com') AS email, CASE WHEN user_id % 20 = 0 THEN 'admin' ELSE 'employee' END AS role, user_id % 9 <> 0 AS is_active
      FROM (SELECT DISTINCT user_id FROM events) e""",
    "assignments": """SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS vehicle_id, CAST(c_custkey % 150 AS BIGINT) AS user_id, CAST('1996-01-01' AS DATE) + CAST(c_custkey % 900 AS INT) AS starts_at,
      CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST('1996-01-01' AS DATE) + CAST(c_custkey % 900 + 200 + c_custkey % 300 AS INT) END AS ends_at FROM customer
      UNION ALL SELECT CAST(c_custkey + 10000000 AS BIGINT), CAST(c_custkey AS BIGINT), CAST(c_custkey % 150 AS BIGINT), CAST('1997-06-01' AS DATE) + CAST(c_custkey % 400 AS INT), CAST('1997-06-01' AS DATE) + CAST(c_custkey % 400 + 90 AS INT) FROM customer WHERE c_custkey % 4 = 1""",
    "vehicle_links": """SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey AS BIGINT) AS left_vehicle_id, CAST(c_custkey + 1 AS BIGINT) AS right_vehicle_id, CAST('1996-01-01' AS DATE) + CAST(c_custkey % 500 AS INT) AS starts_at, CASE WHEN c_custkey % 4 = 1 THEN CAST('1998-01-01' AS DATE) ELSE NULL END AS ends_at FROM customer WHERE c_custkey % 2 = 1""",
    "labor_norms": """SELECT p_brand AS code, p_name AS name, CAST(CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN 'heavy' ELSE 'light' END AS STRING) AS scope, CAST(min(p_size) AS DOUBLE) AS standard_hours, CASE WHEN p_brand = 'Brand#13' THEN 'archived' ELSE 'active' END AS status, min(p_type) AS category
      FROM part GROUP BY p_brand, p_name""",
    "catalogs": """SELECT * FROM (VALUES ('building', 'BUILDING|building site', NULL, NULL, 'truck', 1995, 2015, 10, 'confirmed', TRUE), ('building_all', 'BUILDING', NULL, NULL, NULL, NULL, NULL, 20, 'confirmed', TRUE), ('machinery', 'MACHINERY', NULL, NULL, NULL, NULL, NULL, 10, 'confirmed', TRUE),
      ('machinery_2', 'machinery', NULL, NULL, NULL, NULL, NULL, 10, 'confirmed', TRUE), ('machinery_m1', 'MACHINERY', 'm1|m2', NULL, NULL, NULL, NULL, 10, 'confirmed', TRUE), ('vins', NULL, NULL, 'VIN1000|vin-1001', NULL, NULL, NULL, 40, 'confirmed', TRUE), ('trailers', NULL, NULL, NULL, 'trailer', NULL, NULL, 30, 'confirmed', TRUE),
      ('young', 'AUTOMOBILE', NULL, NULL, NULL, 2005, NULL, 10, 'confirmed', TRUE), ('gone', 'FURNITURE', NULL, NULL, NULL, NULL, NULL, 1, 'archived', TRUE), ('by_hand', 'FURNITURE', NULL, NULL, NULL, NULL, NULL, 1, 'confirmed', FALSE))
      t (scope, brand_keywords, model_keywords, vin_prefixes, vehicle_type, year_from, year_to, priority, status, auto_match)""",
    "review_rules": """SELECT t.*, concat(replace(code, '_', ' '), ' (', rule_type, ')') AS title FROM (VALUES ('manual_review_reason', 'order_number_missing', 8, NULL), ('manual_review_reason', 'repair_date_missing', 8, NULL), ('manual_review_reason', 'repair_date_invalid', 8, NULL), ('manual_review_reason', 'mileage_missing', 8, NULL),
      ('manual_review_reason', 'service_name_suspicious', 8, NULL), ('manual_review_reason', 'text_not_found', 12, 'critical'), ('manual_review_reason', 'image_text_not_found', 12, 'critical'), ('manual_review_reason', 'pdf_text_not_found', 12, 'critical'),
      ('manual_review_reason', 'pdf_ocr_unavailable', 16, 'critical'), ('manual_review_reason', 'image_ocr_unavailable', 16, 'critical'), ('document_status', 'uploaded', 50, NULL), ('document_status', 'partially_recognized', 80, NULL),
      ('document_status', 'needs_review', 70, NULL), ('document_status', 'ocr_error', 130, 'critical'), ('repair_status', 'in_review', 40, NULL), ('repair_status', 'employee_confirmed', 60, NULL), ('repair_status', 'suspicious', 200, 'suspicious'),
      ('repair_status', 'ocr_error', 130, 'critical'), ('check_severity', 'error', 140, 'critical'), ('check_severity', 'suspicious', 180, 'suspicious'), ('signal', 'repair_partial', 25, NULL), ('signal', 'low_ocr_confidence', 40, NULL), ('signal', 'manual_review_cap', 32, NULL))
      t (rule_type, code, weight, bucket_override)""",
}


def needed(sql: str) -> list[str]:
    """The views that a text names, and those that they name, in order."""
    found: set[str] = set()
    left = [sql]
    while left:
        text = left.pop()
        for v in VIEWS:
            if v not in found and re.search(rf"\b{v}\b", text):
                found.add(v)
                left.append(VIEWS[v])
    return [v for v in VIEWS if v in found]


def with_views(sql: str) -> str:
    """sql with the views that it needs as common table expressions."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in needed(sql)]
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"


class Tables:
    """The base tables of a folder and the views over them, as DataFrames: tables("repairs")."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name]
                uses = [n for n in (*BASE, *VIEWS) if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
                text = sql.replace("{", "{{").replace("}", "}}")
                for n in uses:
                    text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
                self._made[name] = self.spark.sql(text, **{n: self(n) for n in uses})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """A text over the base tables and views."""
        uses = [n for n in (*BASE, *VIEWS) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]
        for n in uses:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: self(n) for n in uses})
