"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import re
import zlib
from pathlib import Path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASHES = (
    "score", "label", "size", "taken", "id", "n", "comp", "token", "row", "batch", "bucket", "ids", "spans", "base", "rank", "target", "rate", "held_out", "whole", "part", "cut", "anchors", "edited", "previous", "kept",
    "key", "state", "n_tokens", "stat_log_words", "group", "seq", "source_size", "component_id", "floor", "bin", "d", "value", "feature", "spoken", "want", "head",
)


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def texts() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with every odd case."""
    long_ = " ".join(f"word{i % 977} item{i * 7 % 1013}" for i in range(40_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    near = [f"near{i}" for i in range(120)]
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "web"), (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "web"), (3, None, "en", "web"), (4, "", None, None), (5, "   \n\t ", "de", "books"),
        (6, long_, "en", "books"), (7, "start " + passage + " finish", "en", None), (8, "other begin " + passage + " other end", "en", "web"), (9, " ".join(near), "en", "web"), (10, " ".join([*near[:-1], "changed"]), "fr", "news"),
        (11, "one", "en", "web"), (12, "One two", None, "web"), (13, "ONE TWO", "en", "a"), (14, "mail me at jane.doe@example.org or +1 (555) 123-4567, ip 10.0.0.1 card 4111 1111 1111 1111", "en", "a"),
        (15, "Ärger über die Straße 東京 🙂 naïve", "de", "a"), (16, "x" * 5000, "en", "a"), (17, passage + " " + passage, "en", "b"), (None, "a row without an id " + passage, "en", "b"), (None, None, None, None),
        (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "web"), (18, "a  b\x0bc\x0cd\re\nf\x00g\x1fh", "en", "b"), (19, "the quick brown fox jumps over the lazy dog and runs off", "es", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def write(spark, folder: Path, docs: list[tuple] | None = None, labels: list[tuple] = (), vectors: list[tuple] = (), clash: bool = False) -> str:
    """A folder of tables, and its path."""
    df = spark.createDataFrame(texts() if docs is None else docs, DOC)
    if clash:
        from pyspark.sql import functions as F

        for i, c in enumerate(CLASHES):
            df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(f"extra {i}"))
    df.repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


LABELS = [(1, 1, 0), (2, 0, 1), (7, 1, 0), (8, 0, 1), (9, 1, 0), (12, 0, 1), (14, 1, 0), (15, None, None), (None, 1, 1), (999, 1, 1), (19, 1, 0), (10, 0, 1)]
VECTORS = [
    (0, [0.5, -0.25, 1.0], 1), (50, [0.1, 0.2, 0.3], 1), (1, [0.5, -0.25, 1.0], None), (2, [0.5, -0.25, 1.0], 0), (3, None, 0), (4, [float("nan"), 0.0, 0.0], 0), (5, [float("inf"), 0.0, 0.0], 0), (6, [None, 1.0, 1.0], 0),
    (7, [-1.0, -1.0, -1.0], 0), (8, [0.0, 0.0, 0.0], 0), (9, [], 0), (None, [1.0, 1.0, 1.0], 0), (1, [0.5, -0.25, 1.0], None), (100, [2.0, 2.0, 2.0], 1),
]
