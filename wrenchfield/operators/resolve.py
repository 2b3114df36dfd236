"""Entity resolution: vehicles, services, norms, catalogues, links."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .filters import valid_at
from .matching import occurrences

PREFIX = 6
FEW = 200_000  # rows that are broadcast


def _vehicles_with(asked: DataFrame, vehicles: DataFrame) -> DataFrame:
    """asked (id, a_vin, a_plate) with n, v: how many vehicles (vehicle_id, v_vin, v_plate) have its VIN or plate, and the least of
    them. Vehicles are counted by VIN, by plate and by both; those of either are the first two less the third, so no vehicle
    meets a question. An id is one row of either table (repeated ones count once)."""
    rows, out = vehicles.distinct(), asked
    for kind, key in (("vin", ["vin"]), ("plate", ["plate"]), ("both", ["vin", "plate"])):
        of = rows.groupBy(*(F.col(f"v_{k}").alias(f"a_{k}") for k in key)).agg(F.count("*").alias(f"n_{kind}"), F.min("vehicle_id").alias(f"v_{kind}"))
        out = out.join(of.where(" AND ".join(f"a_{k} IS NOT NULL" for k in key)), [f"a_{k}" for k in key], "left")
    n = F.coalesce("n_vin", F.lit(0)) + F.coalesce("n_plate", F.lit(0)) - F.coalesce("n_both", F.lit(0))
    return out.select("id", "a_vin", "a_plate", n.alias("n"), F.least("v_vin", "v_plate").alias("v"))


def _begun(asked: DataFrame, vehicles: DataFrame, least: int) -> DataFrame:
    """asked (id, a_plate) with p_hits, p_vehicle: how many vehicles (vehicle_id, v_plate, of `least` characters or more) have a
    plate that begins the asked one (of PREFIX characters or more) or is begun by it, and the least of them. Vehicles are
    counted by plate and by its beginnings, which each asked plate, once, and its own beginnings look up: no vehicle meets a
    question. Beginnings of lengths that no plate has are not made: all plates share the shortest ones, which would meet in one task."""
    rows = vehicles.select("vehicle_id", "v_plate").where(F.length("v_plate") >= least).distinct()
    heads = F.transform(F.when(F.length("v_plate") >= PREFIX, F.sequence(F.lit(PREFIX), F.length("v_plate"))), lambda i: F.left("v_plate", i))
    counts = [F.count("*").alias("n"), F.min("vehicle_id").alias("v")]
    begun = rows.select("vehicle_id", F.explode(heads).alias("k")).groupBy("k").agg(*counts)
    whole = rows.groupBy(F.col("v_plate").alias("k")).agg(*counts)
    ids = asked.select("id", "a_plate").where(F.length("a_plate") >= PREFIX).distinct()
    a = ids.select("a_plate").distinct()
    lengths = F.broadcast(rows.select(F.length("v_plate").alias("length")).distinct())  # a row for each length of a plate
    shorter = a.join(lengths, F.col("length") < F.length("a_plate")).select("a_plate", F.left("a_plate", F.col("length")).alias("k"))
    hits = a.select("a_plate", F.col("a_plate").alias("k")).join(begun, "k").unionByName(shorter.join(whole, "k"))
    return ids.join(hits.groupBy("a_plate").agg(F.sum("n").alias("p_hits"), F.min("v").alias("p_vehicle")), "a_plate").drop("a_plate")


def vehicle_by_vin_or_plate(asked: DataFrame, vehicles: DataFrame) -> DataFrame:
    """asked (id, vin, plate): the only vehicle with its VIN or plate, else, if there is none, the only one whose plate begins
    the asked plate or is begun by it, from 6 characters on. Vehicles are counted, never paired with what is asked."""
    v = vehicles.select(F.col("id").alias("vehicle_id"), F.col("vin").alias("v_vin"), text.identifier(F.col("plate_number")).alias("v_plate"))
    a = _vehicles_with(asked.select("id", F.col("vin").alias("a_vin"), text.identifier(F.col("plate")).alias("a_plate")), v)
    out = a.join(_begun(a, v, PREFIX), "id", "left")
    return out.select("id", F.when(F.col("n") == 1, F.col("v")).when((F.col("n") == 0) & (F.col("p_hits") == 1), F.col("p_vehicle")).alias("vehicle_id"), F.col("n").alias("exact_hits"))


def vehicle_of_plate_map(vehicles: DataFrame) -> DataFrame:
    """plate, vehicle_id of the history import: an odd number of vehicles with a plate gives the last, an even number none."""
    return vehicles.groupBy(text.identifier(F.col("plate_number")).alias("plate")).agg(F.when(F.count("*") % 2 == 1, F.max("id")).alias("vehicle_id"))


def service_in_text(texts: DataFrame, services: DataFrame) -> DataFrame:
    """texts (id, text): the service with the longest alias (4 characters or more) that the text's key contains. All aliases are
    looked for in one pass over the texts."""
    alias = services.select("name", F.explode(text.service_aliases(F.col("name"))).alias("alias")).withColumn("alias_key", text.service_key(F.col("alias"))).where(F.length("alias_key") >= 4)
    alias = alias.groupBy("alias_key").agg(F.max(F.struct((F.col("alias") == F.col("name")).cast("int").alias("own"), "name")).alias("of"))
    hits = occurrences(texts.select("id", text.service_key(F.col("text")).alias("text")), alias.select(F.col("alias_key").alias("pattern")))
    return hits.join(alias, F.col("pattern") == F.col("alias_key")).groupBy("id").agg(F.max_by("of.name", F.struct(F.length("alias_key"), F.col("of.own"), F.col("of.name"))).alias("service"))


def service_by_alias(names: DataFrame, services: DataFrame) -> DataFrame:
    """names (id, name): the service with an alias of the same key: first the catalogue's (those that nobody made), then those
    that users made and that aren't archived; the least name among equals."""
    rows = services.where(F.col("created_by_user_id").isNull() | (F.col("status") != "archived")).withColumn("rank", F.col("created_by_user_id").isNotNull().cast("int"))
    alias = rows.select("rank", F.col("name").alias("service"), F.explode(text.service_aliases(F.col("name"))).alias("a")).withColumn("key", text.service_key(F.col("a"))).where("key <> ''")
    alias = alias.groupBy("key").agg(F.min(F.struct("rank", "service"))["service"].alias("service"))
    return names.withColumn("key", text.service_key(F.col("name"))).join(alias, "key", "left").select("id", "name", "service")


def vehicle_or_conflict(asked: DataFrame, vehicles: DataFrame, placeholder: str) -> DataFrame:
    """asked (id, vin, plate): the vehicle with that VIN or plate; is_conflict, and no vehicle, where there are several."""
    v = vehicles.where(F.col("external_id").isNull() | (F.col("external_id") != placeholder)).select(F.col("id").alias("vehicle_id"), text.identifier(F.col("vin")).alias("v_vin"), text.identifier(F.col("plate_number")).alias("v_plate"))
    filled = lambda c: F.nullif(text.identifier(F.col(c)), F.lit(""))
    found = _vehicles_with(asked.select("id", filled("vin").alias("a_vin"), filled("plate").alias("a_plate")), v)
    return found.select("id", F.when(F.col("n") == 1, F.col("v")).alias("vehicle_id"), (F.col("n") > 1).alias("is_conflict"))


def vehicle_of_file(asked: DataFrame, vehicles: DataFrame, placeholder: str) -> DataFrame:
    """asked (id, vin, plate, filename): the first vehicle that a VIN finds, the read one before those in the file's name, or
    else the first that a plate finds. A VIN or plate means the vehicle with the least id."""
    v = vehicles.where(F.col("external_id") != placeholder)
    key = lambda c: text.identifier(F.col(c))
    of = {c: v.select(key(c).alias("key"), F.col("id").alias("v")).where("key <> ''").groupBy("key").agg(F.min("v").alias("v")) for c in ("vin", "plate_number")}
    every = [F.struct(F.lit(kind).alias("kind"), text.identifier(first).alias("read"), more.alias("more")) for kind, first, more in (("vin", F.col("vin"), text.vin_candidates(F.col("filename"))), ("plate_number", F.col("plate"), text.plate_candidates(F.col("filename"))))]
    rows = asked.select("id", F.inline(F.array(*every))).select("id", "kind", F.posexplode(F.concat(F.array("read"), F.coalesce("more", F.array().cast("array<string>")))).alias("at", "key")).where("key <> ''")
    hits = [rows.where(F.col("kind") == k).join(of[k], "key").select("id", F.struct(F.lit(i).alias("i"), "at", "v").alias("x")) for i, k in enumerate(of)]
    return asked.select("id").join(hits[0].union(hits[1]).groupBy("id").agg(F.min("x")["v"].alias("vehicle_id")), "id", "left")


def vehicle_of_import(plates: DataFrame, vehicles: DataFrame) -> DataFrame:
    """plates (id, plate): by the map of whole plates, else the only vehicle whose plate begins the asked one or is begun by it, from 6 characters on."""
    a = plates.select("id", text.identifier(F.col("plate")).alias("plate"))
    v = vehicles.select(F.col("id").alias("vehicle_id"), text.identifier(F.col("plate_number")).alias("v_plate"))
    asked = a.select("plate").distinct().select(F.col("plate").alias("id"), F.col("plate").alias("a_plate"))
    near = _begun(asked, v, 1).where("p_hits = 1").withColumnRenamed("id", "plate")
    return a.join(vehicle_of_plate_map(vehicles), "plate", "left").join(near, "plate", "left").select("id", F.coalesce("vehicle_id", "p_vehicle").alias("vehicle_id"))


def service_backfill(repairs: DataFrame, documents: DataFrame, versions: DataFrame, services: DataFrame) -> DataFrame:
    """repair_id, service of the repairs whose documents lie in a folder named after one: the source document first, then the
    primary ones, then the latest; the first whose folder's name is a service decides."""
    last = versions.where("trim(source_path) <> ''").groupBy("document_id").agg(F.max_by("source_path", "version_number").alias("path"))
    d = documents.join(last, documents["id"] == last["document_id"]).join(repairs.select(F.col("id").alias("_r"), "source_document_id"), F.col("repair_id") == F.col("_r"))
    hints = d.select(F.col("id"), "repair_id", (F.col("id") == F.coalesce("source_document_id", F.lit(-1))).alias("is_source"), "is_primary", text.service_of_folder(F.col("path")).alias("name")).where("name is not null")
    named = service_by_alias(hints.select("id", "name"), services.where("created_by_user_id is null")).where("service is not null").select("id", "service")
    return hints.join(named, "id").groupBy("repair_id").agg(F.max_by("service", F.struct("is_source", "is_primary", "id")).alias("service"))


def catalogue_matches(vehicles: DataFrame, catalogues: DataFrame) -> DataFrame:
    """Vehicle x catalogue by its rules: keywords of brand and model, beginnings of the VIN, years, type (catalogues: scope,
    brand_keywords, model_keywords, vin_prefixes: arrays, vehicle_type, year_from, year_to, priority, auto_match, status).
    A catalogue is met by the first of its rules: vehicles that have one of its keywords, which one pass finds for all
    catalogues, or one of its VINs' beginnings, or else its type; only such pairs are held against all rules."""
    v = vehicles.select(F.col("id").alias("vehicle_id"), "vehicle_type", text.vehicle_text(F.col("brand")).alias("brand_text"), text.vehicle_text(F.col("model")).alias("model_text"), F.regexp_replace(F.upper(F.trim(F.coalesce("vin", F.lit("")))), "[^A-Z0-9]+", "").alias("vin"), "year")
    none = F.array().cast("array<string>")
    c = catalogues.where((F.col("status") != "archived") & F.col("auto_match")).select(
        "scope", text.keywords(F.coalesce("brand_keywords", none)).alias("brands"), text.keywords(F.coalesce("model_keywords", none)).alias("models"),
        text.vin_prefixes(F.coalesce("vin_prefixes", none)).alias("prefixes"), F.col("vehicle_type").alias("c_type"), "year_from", "year_to", "priority",
    )
    has = lambda c: F.size(c) > 0
    brand, model, vin, years = has("brands"), has("models"), has("prefixes"), F.col("year_from").isNotNull() | F.col("year_to").isNotNull()
    first = F.when(brand, "brand").when(model, "model").when(vin, "vin").otherwise("type")
    of_first = F.when(brand, F.col("brands")).when(model, F.col("models")).when(vin, F.col("prefixes")).otherwise(F.array(F.coalesce("c_type", F.lit(""))))
    c = c.select("*", first.alias("by"), F.explode(F.array_distinct(of_first)).alias("term"))
    both = F.concat_ws(" ", "brand_text", "model_text")
    met = [occurrences(v.select(F.col("vehicle_id").alias("id"), t.alias("text")), c.where(F.col("by") == by).select(F.col("term").alias("pattern"))).select(F.col("id").alias("vehicle_id"), F.lit(by).alias("by"), F.col("pattern").alias("term")) for by, t in (("brand", both), ("model", F.col("model_text")))]
    heads = F.transform(F.sequence(F.lit(0), F.length("vin")), lambda n: F.left("vin", n))
    met += [v.select("vehicle_id", F.lit("vin").alias("by"), F.explode(heads).alias("term")), v.select("vehicle_id", F.lit("type").alias("by"), F.explode(F.array_distinct(F.array(F.coalesce("vehicle_type", F.lit("")), F.lit("")))).alias("term"))]
    terms = met[0].unionByName(met[1]).unionByName(met[2]).unionByName(met[3])
    of_brand = F.exists("brands", lambda k: F.contains(both, k))
    fits = (F.col("c_type").isNull() | (F.col("c_type") == F.col("vehicle_type"))) & (~brand | of_brand) & (~model | F.exists("models", lambda k: F.contains("model_text", k))) & (~vin | F.exists("prefixes", lambda k: F.startswith("vin", k)))
    fits = fits & (~years | (F.col("year").isNotNull() & (F.col("year") >= F.coalesce("year_from", "year")) & (F.col("year") <= F.coalesce("year_to", "year"))))
    n = lambda t, w: F.when(t, w).otherwise(0)
    out = terms.join(c, ["by", "term"]).join(v, "vehicle_id").where(fits).select("vehicle_id", "scope", "priority", (n(brand, 1) + n(model, 1) + n(vin, 1) + n(years, 1)).alias("matched_rules"), (n(brand, 4) + n(model, 3) + n(vin, 5) + n(years, 2) + n(F.col("c_type").isNotNull(), 1)).alias("score"), "brands", "models", "prefixes", "c_type", "year_from", "year_to")
    return out.distinct().select("vehicle_id", "scope", "priority", "matched_rules", "score")


def catalogue_choice(vehicles: DataFrame, matches: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """The best catalogue of each vehicle, or the reason why there is none. configured: the catalogues, to tell none at all
    from none that fits; a row of vehicles without an id is a repair without a vehicle."""
    w = Window.partitionBy("vehicle_id").orderBy(F.desc("matched_rules"), F.desc("score"), "priority", F.desc("scope"))
    key = F.struct("matched_rules", "score", "priority")
    best = matches.withColumn("n", F.row_number().over(w)).withColumn("tie", F.coalesce(F.lead(key).over(w) == key, F.lit(False))).where("n = 1")
    out = vehicles.select(F.col("id").alias("vehicle_id")).join(best, "vehicle_id", "left")
    some = F.lit(True) if configured is None else F.lit(not configured.where((F.col("status") != "archived") & F.col("auto_match")).isEmpty())
    reason = F.when(F.col("vehicle_id").isNull(), "vehicle_missing").when(~some, "catalogs_not_configured").when(F.col("scope").isNull(), "catalog_not_found").when(F.col("tie"), "catalog_ambiguous").otherwise("supported")
    return out.select("vehicle_id", F.when(reason == "supported", F.col("scope")).alias("scope"), reason.alias("reason_code"))


def norm_scores(works: DataFrame, norms: DataFrame, least: float = 0.55) -> DataFrame:
    """works (code, name, distinct) x norms by code, or by shared tokens: 0.75 coverage + 0.25 specificity. Candidates come from an
    inverted index of the norms' tokens, never from a product: a work meets a norm at the first token that they share, so that
    pairs need no grouping; an index of FEW rows at most is broadcast, so that works stay where they are, whatever they share.
    Norms of one normalised name are scored as one, and only names with a score of `least` or more lead to them."""
    n = norms.where("status <> 'archived'").select(F.col("scope").alias("n_scope"), F.col("code").alias("n_code"), F.col("name").alias("n_name"), "standard_hours", text.normalized_name(F.col("name")).alias("n_norm"))
    w = works.select("code", "name", text.folded_code(F.col("code")).alias("w_code"), F.array_distinct(text.tokens(F.col("name"))).alias("w_tokens"))
    coded = w.join(n.withColumn("f_code", text.folded_code(F.col("n_code"))), F.col("w_code") == F.col("f_code")).drop("f_code").select("code", "name", "n_scope", "n_code", "n_name", "standard_hours", F.lit(1.0).alias("score"), F.lit("code").alias("matched_by"))
    own = n.distinct()
    index = n.select("n_norm").distinct().withColumn("token", F.explode(F.split("n_norm", " ")))
    own, index = (F.broadcast(x) if x.count() <= FEW else x for x in (own, index))
    shared = F.array_intersect("w_tokens", F.split("n_norm", " "))
    spread = w.repartition(int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")), "code", "name")  # few works make many pairs
    near = spread.withColumn("token", F.explode("w_tokens")).join(index, "token").withColumn("shared", shared).where(F.col("shared")[0] == F.col("token")).withColumn("both", F.size("shared"))
    score = F.round(0.75 * F.col("both") / F.size("w_tokens") + 0.25 * F.col("both") / F.size(F.split("n_norm", " ")), 4)
    joined = F.array_join(F.array_sort("w_tokens"), " ")
    same, inside = joined == F.col("n_norm"), F.contains(joined, F.col("n_norm")) | F.contains(F.col("n_norm"), joined)
    near = near.withColumn("base", score).select("code", "name", "w_code", "n_norm", F.round(F.when(same, F.greatest("base", F.lit(0.94))).when(inside, F.least(F.lit(0.93), F.col("base") + 0.08)).otherwise(F.col("base")), 4).alias("score"), F.when(same, "normalized_name").when(inside, "name_contains").otherwise("name_tokens").alias("matched_by"))
    near = near.where(F.col("score") >= least).join(own, "n_norm").where(F.col("w_code").isNull() | (F.col("w_code") != text.folded_code(F.col("n_code"))))
    return coded.where(F.col("score") >= least).unionByName(near.select(*coded.columns))


def best_norm(scores: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The best norm of each work (within further columns, if asked for), unless its runner-up makes it doubtful."""
    w = Window.partitionBy("code", "name", *(within or [])).orderBy(F.desc("score"), F.desc("standard_hours"), F.desc("n_code"), F.desc("n_scope"), F.desc("n_name"))
    nxt = lambda c: F.lead(c).over(w)
    rows = scores.select("*", F.row_number().over(w).alias("n"), nxt("score").alias("r_score"), nxt("matched_by").alias("r_by"), nxt("n_code").alias("r_code"), nxt("n_scope").alias("r_scope"), nxt("n_name").alias("r_name")).where("n = 1")
    code = F.col("matched_by") == "code"
    doubt = code & (F.coalesce(F.col("r_by"), F.lit("")) == "code") & (F.col("r_code") == F.col("n_code")) & (F.col("r_scope") != F.col("n_scope"))
    twin = ~code & (F.abs(F.col("score") - F.col("r_score")) < 0.0001) & (F.col("n_scope") == F.col("r_scope")) & (F.col("n_name") == F.col("r_name"))
    near = F.coalesce(F.col("score") - F.col("r_score") < 0.12, F.lit(False))
    take = ~F.coalesce(doubt, F.lit(False)) & ~F.coalesce(twin, F.lit(False)) & (code | (F.col("score") >= 0.9) | (~near & (F.col("score") >= 0.68)))
    return rows.where(take).select("code", "name", "n_scope", "n_code", "n_name", "standard_hours", "score", "matched_by")


def overlapping(assignments: DataFrame) -> DataFrame:
    """Pairs of assignments of one user and vehicle that overlap; an open end lasts for ever."""
    last = F.lit(dt.date(9999, 12, 31))
    a, b = assignments.alias("a"), assignments.alias("b")
    meet = (F.col("a.starts_at") <= F.coalesce("b.ends_at", last)) & (F.col("b.starts_at") <= F.coalesce("a.ends_at", last))
    return a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.vehicle_id") == F.col("b.vehicle_id")) & (F.col("a.id") < F.col("b.id")) & meet).select(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"))


def linked_vehicles(links: DataFrame, day: dt.date) -> DataFrame:
    """vehicle_id, other_id of the links valid that day, either way round."""
    sides = F.array(F.struct(F.col("left_vehicle_id").alias("vehicle_id"), F.col("right_vehicle_id").alias("other_id")), F.struct(F.col("right_vehicle_id").alias("vehicle_id"), F.col("left_vehicle_id").alias("other_id")))
    return links.where(valid_at(day)).select(F.inline(sides))


def reconciled(active: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs to insert and to close, and those that stay."""
    a = active.select("left_vehicle_id", "right_vehicle_id").distinct().withColumn("a", F.lit(True))
    b = wanted.select("left_vehicle_id", "right_vehicle_id").distinct().withColumn("b", F.lit(True))
    both = a.join(b, ["left_vehicle_id", "right_vehicle_id"], "full")
    return both.select("left_vehicle_id", "right_vehicle_id", F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "close").otherwise("keep").alias("action"))


def or_equi(left: DataFrame, right: DataFrame, keys: list[str], on: str) -> DataFrame:
    """Pairs (left on, right on) alike in any of the keys: a union of equi-joins, each pair once. A join leaves out what an
    earlier one has, so that pairs need no shuffle, unless an id has several rows."""
    l, r = (df.select(F.col(on).alias(f"{name}_id"), *(F.col(k).alias(f"{name}_{k}") for k in keys)).distinct() for df, name in ((left, "left"), (right, "right")))  # noqa: E741
    same = lambda k: F.col(f"left_{k}") == F.col(f"right_{k}")
    out = None
    for i, k in enumerate(keys):
        fresh = same(k)
        for before in keys[:i]:
            fresh = fresh & ~F.coalesce(same(before), F.lit(False))
        part = l.join(r, fresh).select("left_id", "right_id")
        out = part if out is None else out.union(part)
    several = any(not df.groupBy(f"{name}_id").count().where("count > 1").isEmpty() for df, name in ((l, "left"), (r, "right")))
    return out.distinct() if several else out
