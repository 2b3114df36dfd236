"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into units (runs of up to 8 characters that aren't white space; longer runs are cut), whose hashes are the
inner substrings. Of each `k` consecutive units, those whose least hash stands first or last are closed syncmers: whether
a k-mer is one depends on nothing around it, so an edit changes only the anchors that it touches. k - 1 marks that are
never least stand before a text, so that its first units, and texts of fewer than k units, have anchors, too. The
fingerprint is the anchors' 24-bit hashes in order of their places, six hexadecimal digits each; equal texts have equal ones.
Two fingerprints are matched by place: an anchor counts with the one that follows it, so that what both texts have must stand
in the same order. Likeness is the Jaccard index of these steps (the first begins at the text's start; 1 if both have none).

The next document by doc_id is found on (doc_id, length) rows alone, ranked range by range; of the next document's text
only as much travels as is needed.

Defined results: a null text is empty and has an empty fingerprint; rows without a doc_id stand after all others and
have the first document for next, as the last has; repeated rows of a doc_id have the same next document, and stand as the text with the least hash where they are the next;
the next document of a table's only one is itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

BITS = 24
UNIT = r"[^\x20\x09-\x0D]{1,8}"


def anchors(text: Column, k: int = 3) -> Column:
    """Hashes (BITS bits) of the closed syncmers of text, in order of their places."""
    pad = F.array_repeat(F.lit(2**31 - 1).cast("int"), k - 1)
    units = F.concat(pad, F.transform(F.regexp_extract_all(text, F.lit(UNIT), 0), lambda u: F.hash(u)))
    return _closed(units, k)


def _closed(units: Column, k: int) -> Column:
    def one(i: int):
        return lambda a, n: F.element_at(a, n + i)

    def kmer(holder: Column):
        a, n = holder, F.size(holder) - (k - 1)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

        def anchor(i: Column) -> Column:
            inner = [one(j)(a, i) for j in range(k)]
            edge = F.least(inner[0], inner[-1])
            return F.when(edge <= F.least(*inner[1:-1], edge), F.hash(*inner).bitwiseAND(F.lit((1 << BITS) - 1)))

        return F.filter(F.transform(at, anchor), lambda x: x.isNotNull())

    # a one-element array holds the units, so that they are worked out once
    return F.element_at(F.transform(F.array(units), kmer), 1)


def written(anchors_: Column) -> Column:
    return F.array_join(F.transform(anchors_, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")


def steps(anchors_: Column) -> Column:
    """Each anchor with the one before it (-1 at the start), as one number."""
    return F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(anchors_, 1, F.greatest(F.size(anchors_) - 1, F.lit(0)))), anchors_, lambda a, b: F.when(b.isNotNull(), a.cast("long") * (1 << BITS) + b))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints' steps; NULLs are what pads an empty fingerprint."""
    a, b = (F.array_compact(steps(x)) for x in (a, b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(1.0)


def following(docs: DataFrame) -> DataFrame:
    """doc_id, previous: for each document that has an id, the ids of those that it follows, and how much of its text they want.
    The first document follows the last, and all rows without an id."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 4)).alias("want"))
    parts = shared.save(ids.repartitionByRange(shared.shuffle_partitions(docs.sparkSession), "doc_id").withColumn("part", F.spark_partition_id()), "fp-order")
    w = Window.partitionBy("part").orderBy("doc_id")
    inner = parts.select("doc_id", F.lag("doc_id").over(w).alias("previous"), F.lag("want").over(w).alias("want"), "part")
    ends = parts.groupBy("part").agg(F.max_by(F.struct("doc_id", "want"), "doc_id").alias("last"))  # a row for each range
    whole = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("last").over(whole), F.last("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    joined = inner.join(F.broadcast(ends), "part")
    return joined.select("doc_id", F.coalesce("previous", "last.doc_id").alias("previous"), F.coalesce("want", F.when(F.col("previous").isNull(), F.col("last.want"))).alias("want"))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, text, n_chars, anchors, and the same of the edited text and the next document's anchors."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = following(docs)
    lone = docs.where(F.col("doc_id").isNull()).agg(F.max(F.floor(F.char_length("text") / 4)).alias("lone"))
    first = order.agg(F.min("doc_id").alias("first"))
    known = docs.where(F.col("doc_id").isNotNull())
    beheaded = lambda n: [F.xxhash64("text").alias("least"), F.left("text", F.col(n).cast("int")).alias("head"), anchors(F.col("text"), k).alias("next_anchors")]
    ahead = known.join(order, "doc_id").select(F.col("previous").alias("doc_id"), *beheaded("want")).groupBy("doc_id").agg(F.min(F.struct("least", "head", "next_anchors")).alias("x")).select("doc_id", "x.head", "x.next_anchors")
    with_next = known.join(ahead, "doc_id", "left")
    # the rows without an id all look at the first document: one row
    top = known.join(F.broadcast(first), F.col("doc_id") == F.col("first")).join(F.broadcast(lone)).select(*beheaded("lone")).agg(F.min(F.struct("least", "head", "next_anchors")).alias("x")).select("x.head", "x.next_anchors")
    without = docs.where(F.col("doc_id").isNull()).join(F.broadcast(top), F.lit(True), "left")
    every = with_next.unionByName(without).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - cut).cast("int")), F.left(F.coalesce("head", F.lit("")), cut))
    return every.withColumn("edited", edited).withColumn("anchors", anchors(F.col("text"), k)).withColumn("edited_anchors", anchors(F.col("edited"), k)).withColumn("next_anchors", F.coalesce("next_anchors", "anchors")).drop("head")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(shared.documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("anchors")).alias("fingerprint"), written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
