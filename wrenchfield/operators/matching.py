"""Many patterns in one pass over texts: an Aho-Corasick automaton, in rounds of bounded size."""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occurrences(texts: DataFrame, patterns: DataFrame, most: int = 200_000) -> DataFrame:
    """id, pattern of texts (id, text) and patterns (pattern): each pattern that a text contains, once a text. Every text is
    read once for `most` patterns, whose automaton is all that a task holds. Nulls, empty texts and empty patterns match
    nothing; repeated patterns count once, repeated ids give rows of their own."""
    spark = texts.sparkSession
    distinct = patterns.where("pattern <> ''").select("pattern").distinct()
    rounds = max(1, math.ceil(distinct.count() / most))
    kind = texts.schema["id"].dataType.simpleString()
    texts = texts.select("id", "text").where("text <> ''")
    found = None
    for i in range(rounds):
        own = distinct if rounds == 1 else distinct.where(F.pmod(F.xxhash64("pattern"), F.lit(rounds)) == i)
        held = spark.sparkContext.broadcast(own.toArrow()["pattern"].to_pylist())  # about `most`

        def run(batches, held=held):
            automaton = ahocorasick.Automaton()
            for p in held.value:
                automaton.add_word(p, p)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                at, hits = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    here = {p for _, p in automaton.iter(text)}
                    at += [row] * len(here)
                    hits += here
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=["id", "pattern"])

        part = texts.mapInArrow(run, f"id {kind}, pattern string")
        found = part if found is None else found.unionByName(part)
    return found
