"""Mixing sources to target weights by entropy balancing.

Of all non-negative document weights that give every source its target of words, the ones nearest to 1 in entropy
(each weight between 0 and `most`, prior most / 2) are an exponential tilt in the constraint's own variable, the
document's size: rate = most / (1 + exp(-lambda_source * size / mean size)). The lambdas solve a convex dual, whose
gradient and curvature are sums over documents; Newton iterations take them by source from a histogram of (source,
size), a row for each size that occurs. Rates are rounded into copies: a hash of the document decides about the
fraction, a cut on (fraction - hash) per source is refined until the copies' words meet the target, and the documents
that lie on the cut itself take the remaining words in equal parts, so that a source misses by a word a document at most.

Targets: sources in order of their code points (null last) weigh `weights` in turn, and share `share` of all words;
no target exceeds `most` times its source's words; what is above is shared again by weight among the rest.

Defined results: a null text has size 0 and takes 0 words; a null source is a source; a null doc_id is kept; repeated
rows are taken alike; an empty table gives no rows; further columns are ignored. If no source can take more (all words
times `most` are fewer than asked for), every document is taken `most` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WORD = r"[^\x20\x09-\x0D]+"


def size() -> Column:
    """Words of the column text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target of `sizes` (source, source_size). Each pass fills up the sources that are above."""
    every = F.create_map(*[x for i, w in enumerate(weights) for x in (F.lit(i).cast("long"), F.lit(float(w)))])
    ranks = shared.save(shared.ranked(sizes, "source").withColumn("weight", every[F.col("rank") % len(weights)]), "mix-targets")
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    level, filled = None, -1
    while True:  # each pass fills a source at least, or ends
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("source_size") * most
        got = ranks.agg(F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))).first()
        if not got[1] or got[2] == filled:
            break
        filled, level = got[2], (total - got[0]) / got[1]
    target = F.col("source_size") * most if level is None or not got[1] else F.least(F.col("weight") * level, F.col("source_size") * most)
    return ranks.select("source", "source_size", target.cast("double").alias("target"))


def _rate(most: float) -> Column:
    return most / (1 + F.exp(-F.col("lambda") * F.col("size") / F.col("mean")))


def tilt(histogram: DataFrame, goal: DataFrame, most: float, rounds: int = 40, near: float = 1e-6) -> DataFrame:
    """goal with lambda: damped Newton on each source's dual; null where the source is taken whole (target at the limit)."""
    state = goal.withColumn("lambda", F.lit(0.0)).withColumn("whole", F.col("target") >= F.col("source_size") * most)
    same = histogram["source"].eqNullSafe
    for i in range(rounds):
        rate, z = _rate(most), F.col("size") / F.col("mean")
        sums = histogram.join(state.where(~F.col("whole") & (F.col("mean") > 0)).select(F.col("source").alias("of"), "lambda", "mean"), same(F.col("of"))).groupBy("of").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.col("n") * F.col("size") * z * rate * (1 - rate / most)).alias("slope")
        )
        step = (F.col("target") - F.col("words")) / F.greatest(F.col("slope"), F.lit(1e-12) * F.col("target") + 1e-300)
        was = state
        state = shared.save(
            state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
            .withColumn("off", F.coalesce(F.abs(F.col("words") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0)))
            .withColumn("lambda", F.col("lambda") + F.coalesce(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step)), F.lit(0.0)))
            .drop("of", "words", "slope"),
            "mix-newton",
        )
        if i:
            shared.drop(was)
        if not (state.agg(F.max("off")).first()[0] or 0) > near:
            break
        state = state.drop("off")
    return state.drop("off")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and taken of docs (doc_id, source, text). taken depends on the first three alone."""
    docs = shared.save(docs.select("doc_id", "source", size().alias("size")), "mix-sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    goal = targets(sizes.select("source", "source_size", "mean").drop("mean"), weights, share, most)
    goal = goal.join(sizes.select(F.col("source").alias("of"), "mean"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    histogram = shared.save(docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    solved = tilt(histogram, goal, most).withColumnRenamed("source", "of")
    rate = F.when(F.col("whole"), F.lit(most)).when(F.col("mean") > 0, _rate(most)).otherwise(0.0)
    rated = docs.join(solved, docs["source"].eqNullSafe(solved["of"])).drop("of").withColumn("rate", rate)
    hashed = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rated = rated.withColumn("floor", F.least(F.floor("rate"), F.lit(int(most)))).withColumn("key", F.when(F.col("floor") >= most, F.lit(-1.0)).otherwise(F.col("rate") - F.col("floor") - hashed))
    rated = shared.save(rated.drop("lambda", "mean", "whole"), "mix-rates")
    for t in (docs, histogram):
        shared.drop(t)
    edge = _edges(rated, most).withColumnRenamed("source", "of")
    out = rated.join(edge, rated["source"].eqNullSafe(edge["of"]), "left").drop("of")
    extra = F.when(F.col("floor") >= most, 0).when(F.col("bin") > F.col("cut"), 1.0).when(F.col("bin") == F.col("cut"), F.col("part")).otherwise(0.0)
    taken = F.col("size") * F.col("floor") + F.floor(F.col("size") * F.coalesce(extra, F.lit(0.0)) + 1e-9)
    return out.withColumn("bin", _bin(24)).withColumn("taken", F.least(taken, F.floor(F.col("size") * most)).cast("long")).drop("floor", "key", "bin", "cut", "part")


def _bin(bits: int) -> Column:
    """key, between -1 and 1, cut into 2**bits bins."""
    return F.floor((F.col("key") + 1) / 2 * (1 << bits)).cast("long")


def _edges(rated: DataFrame, most: float) -> DataFrame:
    """source, cut, part: documents with bins above the cut take one copy more, those in it a part of one.
    The cut is found in two passes, over 2**12 bins a source and then over 2**12 bins in the one that holds it."""
    from pyspark.sql.window import Window

    live = rated.where((F.col("floor") < most) & (F.col("size") > 0))
    base = rated.groupBy(F.col("source").alias("b")).agg((F.max("target") - F.sum(F.col("size") * F.col("floor"))).alias("left"))
    by = Window.partitionBy("source").orderBy(F.desc("at"))

    def holding(bins: DataFrame, need: DataFrame) -> DataFrame:
        """The bin of each source in which the words from above pass what is needed."""
        run = bins.withColumn("above", F.sum("w").over(by) - F.col("w")).join(need, F.col("source").eqNullSafe(F.col("b"))).drop("b")
        best = run.where(F.col("above") <= F.greatest(F.col("left"), F.lit(0.0))).groupBy("source").agg(F.min_by(F.struct("at", "w", "above", "left"), F.col("at")).alias("x"))
        return best.select("source", "x.*")

    coarse = holding(live.groupBy("source", _bin(12).alias("at")).agg(F.sum("size").alias("w")), base)
    inner = coarse.select(F.col("source").alias("b"), F.col("at").alias("in"), (F.col("left") - F.col("above")).alias("left"))
    fine = live.withColumn("at", _bin(24)).join(inner.select("b", "in"), F.col("source").eqNullSafe(F.col("b")) & (_bin(12) == F.col("in"))).groupBy("source", "at").agg(F.sum("size").alias("w"))
    edge = holding(fine, inner.drop("in"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("left") - F.col("above")) / F.col("w")))
    return shared.save(edge.select("source", F.col("at").alias("cut"), part.alias("part")), "mix-cuts")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
