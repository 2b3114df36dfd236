"""The corpus pipeline: toxicity, near copies, personal data, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchfield.llm import jaccard, mixing, packing, pii, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The classifier learns from all labelled documents of the tables
    (a bounded sample of them); labels never decide about a document themselves. Null and empty texts have the score of the
    intercept; rows without a doc_id are scored like all others; repeated rows stay or go together; an empty table stays
    empty; further columns are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(shared.documents(spark, sf_dir), labels)
    name = shared.fresh("score", docs.columns)
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id (five-word shingles, Jaccard index
    0.8 or more), once. Different texts under one doc_id are different documents. Rows without a doc_id, and null and empty
    texts, are in no group and stay (once for each doc_id); an empty table stays empty; further columns are kept, those of
    the row that stays."""
    node, keep = (shared.fresh(c, docs.columns) for c in ("near_node", "near_kept"))
    told = jaccard.told_apart(docs, node)
    linked = jaccard.groups(told.select("doc_id", "text", F.col(node).alias("node")), 5, 80, 100).where(F.col("doc_id").isNotNull())
    first = linked.groupBy("component").agg(F.min(F.struct("doc_id", "node"))["node"].alias(keep)).select(keep)
    stay = told.where(F.col(node).isNotNull()).join(first, F.col(node) == F.col(keep), "left_semi")
    # repeated rows of one text: the least of them stays
    stay = stay.groupBy(node).agg(F.min(F.struct(*docs.columns)).alias("d")).select("d.*")
    return stay.select(docs.columns).unionByName(told.where(F.col(node).isNull()).select(docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds, as <email>; n_chars follows. Null and empty texts stay as they are; every row
    is kept, also without a doc_id or repeated; an empty table stays empty; further columns are kept."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its whole copies, and the first words (joined by single spaces) of one more
    where it takes a part; n_chars follows. Texts without words (null ones, too) are taken once, as they take nothing of a
    target; a null source is a source; rows without a doc_id are taken like all others, repeated rows alike; an empty table
    stays empty; further columns are kept."""
    taken = mixing.mix(docs.select("doc_id", "source", "text"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    # 0 is a whole copy, n the first n words
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.filter(F.array(part), lambda n: n > 0))
    doc, source, size, every, cut = (shared.fresh(c, docs.columns) for c in ("mix_doc", "mix_source", "mix_size", "mix_copies", "mix_cut"))
    rows = taken.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), copies.alias(every)).distinct()
    out = docs.join(rows, docs["doc_id"].eqNullSafe(F.col(doc)) & docs["source"].eqNullSafe(F.col(source)) & (mixing.size() == F.col(size))).withColumn(cut, F.explode(every))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(mixing.WORD), 0), F.lit(1), F.col(cut)), " ")
    out = out.withColumn("text", F.when(F.col(cut) > 0, head).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids. A null or empty text is one end id; a null doc_id is kept; repeated rows are
    packed each; an empty table gives no rows; further columns are left out."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage's model, graph or rounding can be written in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = shared.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = shared.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            shared.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
