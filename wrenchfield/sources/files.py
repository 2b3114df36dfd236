"""Files in and out: folders of documents, norm lists, service cards, PDF text, snapshots."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

SUFFIXES = ("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif", "heic")
#: First bytes (hexadecimal) of the kinds of files that are taken.
MAGIC = (("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("zip", "504B0304"))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, key (SHA-1 of the content), kind of all documents below a folder; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join([*SUFFIXES, *(s.upper() for s in SUFFIXES)]) + "}").load(path)
    return files.where(~F.col("path").rlike(r"/\.[^/]+")).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha1("content").alias("key"), sniffed(F.col("content")).alias("kind"), "content")


def sniffed(content: Column) -> Column:
    out = F.when((F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp").when(F.hex(F.substring(content, 5, 4)) == "66747970", "heic")
    for kind, head in MAGIC:
        out = out.when(F.hex(F.substring(content, 1, len(head) // 2)) == head, kind)
    return out


def upload_error(content: Column, limit: int = 25 << 20) -> Column:
    return F.when(F.length(content) == 0, "empty").when(F.length(content) > limit, "too_large").when(sniffed(content).isNull(), "unknown_type")


def norm_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labour norms of CSV files with a header; a byte-order mark is no part of it. The sheet defaults to the category."""
    schema = "code string, category string, source_sheet string, name_ru string, name_ru_alt string, name_cn string, name_en string, standard_hours string"
    rows = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)
    hours = text.parse_amount(F.col("standard_hours"))
    rows = rows.withColumn("standard_hours", hours).withColumn("source_sheet", F.coalesce(F.nullif(F.trim("source_sheet"), F.lit("")), F.col("category")))
    return rows.where(F.col("code").isNotNull() & F.col("name_ru").isNotNull() & F.col("standard_hours").isNotNull()).withColumn("normalized_name", text.normalized_name(F.col("name_ru"), F.col("name_ru_alt"))).withColumn("search_text", text.search_text(F.col("code"), F.col("name_ru"), F.col("name_en")))


def _paragraphs(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    return content.map(_paragraphs)


#: Labels of a service card.
CARD_LABELS = {"address": "Адрес", "inn_kpp": "ИНН/КПП", "ogrn": "ОГРН", "bank": "Банк", "bik": "БИК", "phone": "Телефон", "email": "Email", "director": "Директор"}


def service_card(t: Column) -> Column:
    """struct of a card's first line and its labelled lines."""
    get = lambda label: F.nullif(F.trim(F.regexp_extract(t, rf"(?imu)^\s*{re.escape(label)}\s*:\s*(.+)$", 1)), F.lit(""))
    return F.struct(F.trim(F.element_at(F.split(F.trim(t), "\n"), 1)).alias("name"), *[get(v).alias(k) for k, v in CARD_LABELS.items()])


def _literals(content: bytes) -> str:
    """Text literals of a PDF's streams."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", content, re.S):
        raw = m[1]
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")", raw):
            out.append(re.sub(rb"\\([()\\])", rb"\1", s).decode("utf-8", "replace"))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    return content.map(_literals)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table as Parquet, and a manifest row for each beside them."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count(), df.schema.json()))
    out = spark.createDataFrame(rows, "name string, rows long, schema string").withColumn("snapshot_id", F.lit(uuid.uuid4().hex))
    out.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return out


def restored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, with the schemas that they had."""
    from pyspark.sql.types import StructType

    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r['schema']))).parquet(f"{path}/{r['name']}") for r in spark.read.json(f"{path}/_manifest").collect()}


def listed(manifests: DataFrame, archives: DataFrame) -> DataFrame:
    """Snapshots, newest first; those without an archive are missing."""
    there = archives.select("snapshot_id").distinct().withColumn("_there", F.lit(True))
    return manifests.join(there, "snapshot_id", "left").withColumn("status", F.when(F.col("_there"), "ready").otherwise("missing")).drop("_there").orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def exported(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV files for each sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
