"""A whole work order out of its text, as column expressions: header fields with confidences, reasons for a manual review, and
notes. Recognised text mixes up letters, so labels match any letter that looks alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, text

#: Characters that recognition takes for each other.
CONFUSABLE = {
    "а": "аa4@", "б": "б6b", "в": "вb8", "г": "гgr", "д": "дdg", "е": "еe", "з": "з3", "и": "иu", "к": "кk", "м": "мm", "н": "нh", "о": "оo0", "п": "пnp", "р": "рpr", "с": "сc", "т": "тt", "у": "уy", "х": "хx",
}


def fuzzy(phrase: str) -> str:
    """A pattern for a phrase: look-alikes of each character, and words that run together or are cut by dashes."""
    return text.fuzzy_pattern(phrase, {c: f"[{re.escape(x)}]" for c, x in CONFUSABLE.items()})


def _either(*phrases: str) -> str:
    """A pattern for any of the phrases; most places are ruled out by their first characters."""
    return rf"(?={text.any_case(''.join(CONFUSABLE.get(p[0], p[0]) for p in phrases))})(?:{'|'.join(fuzzy(p) for p in phrases)})"


#: Labels and forms of a header's fields; patterns are asked in order, the first that matches decides.
ORDER, ACT = _either("заказ наряд", "наряд заказ"), _either("акт выполненных работ", "акт")
NUMBER, TOKEN = r"(?:№|N[Ooº°]?|#)", r"[A-Za-zА-Яа-я0-9/_-]"
DAY, WORD_DAY = r"(\d{2}[./-]\d{2}[./-]\d{2,4})", r"(\d{1,2}\s+[А-Яа-я]+\s+\d{4})"
MILEAGE = _either("пробег", "одометр")
SERVICE = _either("поставщик", "исполнитель", "подрядчик", "контрагент")
AFTER_SERVICE = r"инн|кпп|адрес|тел(?:ефон)?|заказчик|плательщик|автомобиль|шасси|vin|договор|документ|заказ[- ]наряд|акт"
SUM = r"\b[^\d\r\n]{0,20}(\d[\d\s]*(?:[.,]\d{2})?)"
_DATED = rf"(?:{ORDER}|{ACT}|{fuzzy('документ')})[^\n\r]{{0,80}}?(?:{fuzzy('от')})\s*[:№]?\s*"
_CLOSED = rf"(?:{_either('дата закрытия', 'дата окончания работ')})\s*[:№]?\s*"
_DATE = rf"(?:{_either('дата', 'от')})\s*[:№]?\s*"
PATTERNS = {
    "order_number": (rf"(?:{ORDER})\s*{NUMBER}?\s*({TOKEN}{{3,}})", rf"(?:{ACT})\s*{NUMBER}?\s*({TOKEN}{{3,}})", rf"\b{NUMBER}\s*({TOKEN}{{4,}})", r"\b([A-Z]{2,}[A-Z0-9/_-]*-\d{2,})\b"),
    "repair_date": (_DATED + DAY, _DATED + WORD_DAY, _CLOSED + DAY, _CLOSED + WORD_DAY, _DATE + DAY, _DATE + WORD_DAY, rf"\b{DAY}\b"),
    "mileage": (rf"(?:{MILEAGE})(?:\s*\([^)]*\))?\D{{0,40}}(\d[\d\s]{{1,}})",),
    "plate_number": (r"([А-ЯA-Z]\s*\d{3}\s*[А-ЯA-Z]{2}\s*\d{2,3})(?!\d)", r"(\d{3}\s*[А-ЯA-Z]{3}\s*\d{2,3})(?!\d)", r"([А-ЯA-Z]{2}\s*\d{4}\s*\d{2,3})(?!\d)", r"(\d{4}\s*[А-ЯA-Z]{2}\s*\d{2,3})(?!\d)"),
    "vin": (r"(?<![A-HJ-NPR-Z0-9])([A-HJ-NPR-Z0-9]{17})(?![A-HJ-NPR-Z0-9])",),
    "service_name": (rf"(?:{SERVICE})\b\s*[:№]?\s*(.+?)(?=(?:\b(?:{AFTER_SERVICE})\b)|$)",),
    "work_total": (rf"(?:{_either('работы итого', 'стоимость работ', 'итого работ')}){SUM}(?=\s*(?:запчаст|материал|ндс|итого|сервис|сто|$))",),
    "parts_total": (rf"(?:{_either('запчасти итого', 'материалы итого', 'стоимость запчастей', 'стоимость материалов', 'запчасти', 'материалы')}){SUM}(?=\s*(?:ндс|итого|сервис|сто|$))",),
    "vat_total": (rf"(?:{fuzzy('ндс')}){SUM}(?=\s*(?:итого|сервис|сто|$))",),
    "grand_total": (rf"(?:{_either('итого к оплате', 'к оплате', 'итого', 'всего')}){SUM}(?=\s*(?:сервис|сто|$))",),
}
CONFIDENCE = {"order_number": 0.74, "repair_date": 0.7, "mileage": 0.82, "plate_number": 0.77, "vin": 0.88, "service_name": 0.58, "work_total": 0.72, "parts_total": 0.72, "vat_total": 0.72, "grand_total": 0.8}
TOTALS = ("work_total", "parts_total", "vat_total", "grand_total")
SECTION_START = r"(?:TC|ТС|Автомобиль|ТРАНСПОРТНОЕ\s+СРЕДСТВО|Модель автомобиля|Марка:)\b"
SECTION_STOP = r"(?:^|\n)\s*(?:ВЛАДЕЛЕЦ|Заказчик|ПЛАТЕЛЬЩИК|Причина(?:\s+обращения)?|Вид ремонта|Выполненные работы|ДОГОВОР|Контактное\s+лицо)\b"
PLATE_LABEL = r"(?:гос\.?\s*(?:номер|ном\.?\s*знак)|госномер|г/н|г\.\s*н\.)\s*[:№]?\s*([^\n\r]{0,48})"
VIN_LABEL = r"vin\s*[:№]?\s*([A-HJ-NPR-Z0-9]{17})"
MILEAGE_LABEL = rf"(?:{MILEAGE})(?:\s*\([^)]*\))?\s*[:№]?\s*(\d[\d\s]{{0,}})"
MILEAGE_ROWS = (r"\b(\d{3}(?:\s\d{3}){0,3})\b(?=\s+(?:закрыт|открыт|rub|rur|руб|usd|eur)\b)", r"\b(\d{3}(?:\s\d{3}){0,3})\b(?=\s+(?:vin|вид\s+ремонта|дата\s+приема)\b)")
SERVICE_LINES = (
    rf"(?s)(?:^|\n)\s*(?:{SERVICE})\b\s*[:№]?\s*(.+?)(?=(?:\b(?:{AFTER_SERVICE})\b)|\z)",
    r"(?s)^(?:официальный\s+дилер[^\n\r]{0,80})?(.+?)(?=(?:\b(?:инн|кпп|адрес|тел(?:ефон)?|цех|заказ[- ]наряд|акт\s+выполненных\s+работ|документ)\b)|\z)",
)
FLAGS = "(?iumU)"  # letters of any script, and ^ and $ at each line


def _first(c: Column, pattern: str) -> Column:
    """The first group of the first match, blanks collapsed; NULL without one."""
    return text.filled(text.collapse(F.regexp_extract(c, FLAGS + pattern, 1)))


def first_match(c: Column, field: str) -> Column:
    return F.coalesce(*[_first(c, p) for p in PATTERNS[field]])


def vehicle_section(c: Column) -> Column:
    """From the first word that begins the vehicle's section (in the first 3,000 characters) to one that ends it, 1,800 characters at most."""
    start, end = ("(?iu)" + p.replace(r"\b", r"(?![\p{L}\p{N}_])") for p in (SECTION_START, SECTION_STOP))
    cut = lambda part: text.bound(F.regexp_instr(F.substring(part, F.lit(2), F.length(part)), F.lit(end)), lambda stop: F.when(stop > 0, F.left(part, stop)).otherwise(part))
    of = lambda head: text.bound(F.regexp_instr(head, F.lit(start)), lambda at: F.when(at > 0, text.bound(F.substring(head, at, F.lit(1800)), cut)).otherwise(F.left(head, F.lit(1800))))
    return text.bound(F.left(c, F.lit(3000)), of)


def plate_in(c: Column) -> Column:
    """The first plate in a text, as written or else with look-alike letters folded."""
    found = lambda v: F.coalesce(*[text.filled(text.identifier(_first(v, p))) for p in PATTERNS["plate_number"]])
    return text.bound(c, lambda x: F.coalesce(text.bound(text.collapse(x), found), text.bound(text.ocr_folded(x), found)))


def vin_in(c: Column) -> Column:
    return text.filled(text.identifier(_first(F.upper(text.ocr_folded(c)), PATTERNS["vin"][0])))


def section_mileage(section: Column) -> Column:
    """After its label, or else from a row of the section (with the next one, if it only has the label)."""
    lines = F.split(text.clean_lines(section), "\n")
    window = text.bound(lines, lambda all_: F.transform(all_, lambda x, i: F.when(x.rlike("(?iu)пробег|одометр"), F.concat_ws(" ", x, F.get(all_, i + 1))).otherwise(x)))
    row = F.transform(window, lambda x: F.coalesce(*[text.parse_mileage(_first(x, p)) for p in MILEAGE_ROWS]))
    return F.coalesce(text.parse_mileage(_first(section, MILEAGE_LABEL)), F.try_element_at(F.filter(row, lambda x: x.isNotNull()), F.lit(1)))


def service_candidate(c: Column) -> Column:
    """Of the first 2,000 characters: what follows a label, or else the first words, up to a label of something else."""
    head = F.left(c, F.lit(2000))
    bare = lambda x: text.filled(F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" -:;,")))
    found = F.coalesce(*[bare(F.regexp_extract(head, FLAGS + p, 1)) for p in SERVICE_LINES])
    cut = F.regexp_replace(found, rf"(?siuU)\b(?:{AFTER_SERVICE})\b.*", "")
    return text.filled(F.left(F.btrim(cut, F.lit(" ,.;:-")), F.lit(200)))


def acquired(source_type: Column, pdf_text: Column, ocr_text: Column, ocr: bool, renderer: bool) -> Column:
    """struct<text, extracted_from, failure>: images are recognised; a PDF's own text does if it has two keywords or six
    Cyrillic letters, or else the better of it and of what is recognised. ocr and renderer: whether there is an engine."""
    keywords = "(?iu)" + _either("заказ", "наряд", "дата", "госномер", "пробег", "работ", "запчаст", "итого", "сервис", "ндс")
    own, seen = F.coalesce(pdf_text, F.lit("")), F.coalesce(ocr_text, F.lit(""))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    score = lambda c: F.struct(count(c, keywords), count(c, "[А-Яа-я]"), count(c, "[А-Яа-яA-Za-z0-9]"))
    made = lambda t, f, why: F.struct(t.alias("text"), F.lit(f).alias("extracted_from") if isinstance(f, str) else f.alias("extracted_from"), (F.lit(why) if why is None or isinstance(why, str) else why).cast("string").alias("failure"))
    without = lambda reason: made(own, "pdf_text", F.when(own == "", reason))
    image = made(F.lit(""), "manual_review", "image_ocr_unavailable") if not ocr else made(seen, "image_ocr", F.when(seen == "", "image_text_not_found"))
    scanned = without("pdf_ocr_unavailable") if not ocr else without("pdf_renderer_unavailable") if not renderer else F.when(score(seen) > score(own), made(seen, "pdf_ocr", None)).otherwise(made(F.coalesce(F.nullif(own, F.lit("")), seen), F.when(own == "", "pdf_ocr").otherwise("pdf_text"), F.when((own == "") & (seen == ""), "pdf_text_not_found")))
    return F.when(source_type == "image", image).when((count(own, keywords) >= 2) | (count(own, "[А-Яа-я]") >= 6), made(own, "pdf_text", None)).otherwise(scanned)


def parsed(documents: DataFrame, rules: list[tuple] = (), digits: int = 6) -> DataFrame:
    """id, the fields of PATTERNS, confidence (a map), reasons, candidate of documents (id, text): header fields from the
    vehicle's section, or else from the first 2,500 characters; the service and the totals from the whole text. rules, as
    extract.rule_matches() takes them, go before the patterns: what such a rule can't read is invalid, and nothing else tried.
    A service's name with so many digits is suspicious."""
    c = F.col("text")
    signs = c
    for a, b in zip("¹–—«»", '№--""', strict=True):
        signs = F.replace(signs, F.lit(a), F.lit(b))
    d = documents.select("id", text.clean_lines(signs).alias("text"))
    given = lambda f: F.lit(None).cast("struct<value:string,confidence:double>")
    if rules:
        hits = extract.rule_matches(documents, rules).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "confidence")))).alias("given"))
        d = d.join(hits, "id", "left")
        given = lambda f: F.try_element_at("given", F.lit(f))
    section, head = F.col("section"), F.col("head")
    # what several columns name is a column of its own before them, so that it is worked out once
    d = d.withColumns({"head": F.left(c, F.lit(2500)), "section": vehicle_section(c)})
    d = d.withColumns({
        "order_number": first_match(head, "order_number"), "repair_date": first_match(head, "repair_date"), "service_name": first_match(c, "service_name"), **{f: text.parse_amount(first_match(c, f)) for f in TOTALS},
        "s_mileage": section_mileage(section), "s_plate": F.coalesce(plate_in(_first(section, PLATE_LABEL)), plate_in(section)), "s_vin": F.coalesce(vin_in(_first(section, VIN_LABEL)), vin_in(section)),
    })
    ruled = lambda f, value, kind: F.when(given(f).isNotNull(), given(f)["value"].try_cast(kind)).otherwise(value)
    sure = lambda f, own=None: F.when(given(f).isNotNull(), given(f)["confidence"]).otherwise(F.lit(CONFIDENCE[f] if own is None else own))
    either = lambda f: F.coalesce(first_match(section, f), first_match(head, f))
    without = lambda f, value: F.when(F.col(f).isNull(), value)
    same = lambda read, f: text.bound(ruled(f, either(f), "string"), lambda x: F.coalesce(read(x), text.filled(text.identifier(x))))
    named = text.collapse(F.regexp_replace(ruled("service_name", F.col("service_name"), "string"), r"\s+", " "))
    d = d.withColumns({"number": ruled("order_number", F.col("order_number"), "string"), "named": text.filled(F.btrim(named, F.lit(" -:;,")))})
    usable = F.col("named").isNotNull() & (text.service_key(F.col("named")) != "")
    of = {
        "order_number": F.when(text.plausible_order_number(F.col("number")), F.col("number")),
        "repair_date": ruled("repair_date", text.parse_date(F.col("repair_date")), "date"),
        "s_mileage": F.col("s_mileage"), "f_mileage": without("s_mileage", ruled("mileage", text.parse_digits(either("mileage")), "long")),
        "s_plate": F.col("s_plate"), "f_plate": without("s_plate", same(plate_in, "plate_number")),
        "s_vin": F.col("s_vin"), "f_vin": without("s_vin", same(vin_in, "vin")),
        "candidate": F.when(usable, F.col("named")).otherwise(F.coalesce(service_candidate(c), F.col("named"))),
        **{f: ruled(f, F.col(f), "double") for f in TOTALS},
        "dated": F.col("repair_date").isNotNull() | given("repair_date").isNotNull(),
        "sure": F.create_map(*[x for f in CONFIDENCE for x in (F.lit(f), sure(f))]),
    }
    d = d.select("id", *[v.alias(k) for k, v in of.items()])
    d = d.withColumn("doubtful", text.bound(F.col("candidate"), lambda x: text.suspicious_service(x, digits)))
    suspicious = F.col("doubtful")
    fields = {
        "order_number": F.col("order_number"), "repair_date": F.col("repair_date"), "mileage": F.coalesce("s_mileage", "f_mileage"), "plate_number": F.coalesce("s_plate", "f_plate"), "vin": F.coalesce("s_vin", "f_vin"),
        "service_name": F.when(F.col("candidate").isNotNull() & ~suspicious, F.left("candidate", F.lit(120))), **{f: F.col(f) for f in TOTALS},
    }
    fixed = {"mileage": ("s_mileage", 0.9), "plate_number": ("s_plate", 0.9), "vin": ("s_vin", 0.92)}
    level = {f: F.when(F.col(fixed[f][0]).isNotNull(), F.lit(fixed[f][1])).otherwise(F.col("sure")[f]) if f in fixed else F.col("sure")[f] for f in fields}
    confidence = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.when(v.isNotNull(), level[f]).alias("value")) for f, v in fields.items()]), lambda e: e["value"].isNotNull()))
    reasons = F.array_compact(F.array(
        F.when(fields["order_number"].isNull(), "order_number_missing"), F.when(fields["repair_date"].isNull(), F.when(F.col("dated"), "repair_date_invalid").otherwise("repair_date_missing")),
        F.when(fields["mileage"].isNull(), "mileage_missing"), F.when(F.col("candidate").isNotNull() & suspicious, "service_name_suspicious"),
    ))
    return d.select("id", *[v.alias(f) for f, v in fields.items()], confidence.alias("confidence"), reasons.alias("reasons"), F.array().cast("array<string>").alias("notes"))


def with_service(parsed_: DataFrame, found: DataFrame) -> DataFrame:
    """A service that the whole text names (found: id, service, as resolve.service_in_text() gives it) goes before any other."""
    p = parsed_.join(found.select("id", F.col("service").alias("_s")), "id", "left")
    known = F.col("_s").isNotNull()
    reasons = F.when(known, F.array_remove("reasons", "service_name_suspicious")).otherwise(F.col("reasons"))
    return p.withColumns({"service_name": F.coalesce("_s", "service_name"), "confidence": _put("confidence", "service_name", known, 0.92), "reasons": reasons, "notes": _note("notes", known, "service_found_in_text")}).drop("_s")


def _put(c: str, field: str, test: Column, value: float) -> Column:
    """The map with field at value, where test holds."""
    rest = F.map_filter(c, _but(field))
    return F.when(F.coalesce(test, F.lit(False)), F.map_concat(rest, F.create_map(F.lit(field), F.lit(value)))).otherwise(F.col(c))


def _note(c: str, test: Column, note: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array_append(c, F.lit(note))).otherwise(F.col(c))


def from_metadata(parsed_: DataFrame, files: DataFrame) -> DataFrame:
    """What the text doesn't say, from files (id, filename, source_path): plate, VIN, number and date out of the file's name
    and path, the service out of its folder's name."""
    folder = text.service_of_folder(F.col("source_path"))
    hint = F.concat_ws(" | ", *[F.nullif(F.trim(x), F.lit("")) for x in (F.col("filename"), F.col("source_path"), folder)])
    h = files.select("id", hint.alias("_h"), folder.alias("_f"))
    h = h.select("id", F.nullif(text.identifier(first_match(F.col("_h"), "plate_number")), F.lit("")).alias("_plate_number"), F.nullif(text.identifier(first_match(F.col("_h"), "vin")), F.lit("")).alias("_vin"), first_match(F.col("_h"), "order_number").alias("_order_number"), text.parse_date(first_match(F.col("_h"), "repair_date")).alias("_repair_date"), F.when(~text.suspicious_service(F.col("_f")), F.left("_f", F.lit(120))).alias("_service_name"))
    p = parsed_.join(h, "id", "left")
    for field, value, gone in (("plate_number", 0.55, ()), ("vin", 0.6, ()), ("order_number", 0.5, ("order_number_missing",)), ("repair_date", 0.48, ("repair_date_missing", "repair_date_invalid")), ("service_name", 0.45, ())):
        p = _filled(p, field, F.col(f"_{field}"), value, f"{field}_from_file_name", gone).drop(f"_{field}")
    return p


def _filled(p: DataFrame, field: str, by: Column, value: float, note: str, gone: tuple[str, ...] = ()) -> DataFrame:
    new = F.col(field).isNull() & by.isNotNull()
    reasons = F.when(new, F.filter("reasons", lambda r: ~r.isin(*gone))).otherwise(F.col("reasons")) if gone else F.col("reasons")
    return p.withColumns({field: F.coalesce(F.col(field), by), "confidence": _put("confidence", field, new, value), "reasons": reasons, "notes": _note("notes", new, note)})


def from_vehicle(parsed_: DataFrame, vehicles: DataFrame, value: float, note: str) -> DataFrame:
    """Plate and VIN of a vehicle (vehicles: id of the document, plate, vin), where the document has none: of the repair's own
    vehicle at .35, of one that the registry has for the other identifier at .4."""
    v = vehicles.select("id", F.nullif(text.identifier(F.col("plate")), F.lit("")).alias("_p"), F.nullif(text.identifier(F.col("vin")), F.lit("")).alias("_v"))
    p = parsed_.join(v, "id", "left")
    return _filled(_filled(p, "plate_number", F.col("_p"), value, f"plate_number_from_{note}"), "vin", F.col("_v"), value, f"vin_from_{note}").drop("_p", "_v")


def reconciled(parsed_: DataFrame, sums: DataFrame) -> DataFrame:
    """Totals against sums of lines (id, works, parts: NULL without lines): missing ones are filled in; those of works and
    parts that differ give way, if the sums and VAT make the grand total."""
    p = parsed_.join(sums.select("id", F.col("works").alias("_work_total"), F.col("parts").alias("_parts_total")), "id", "left")
    for f in ("work_total", "parts_total"):
        new = F.col(f).isNull() & F.col(f"_{f}").isNotNull()
        p = p.withColumns({f: F.coalesce(f, f"_{f}"), "confidence": _put("confidence", f, new, 0.68), "notes": _note("notes", new, f"{f}_restored_from_lines")})
    fits = F.round(F.col("_work_total") + F.col("_parts_total") + F.coalesce("vat_total", F.lit(0.0)), 2) == F.col("grand_total")
    for f in ("work_total", "parts_total"):
        off = F.coalesce(fits & (F.col(f) != F.col(f"_{f}")), F.lit(False))
        most = F.greatest(F.coalesce(F.try_element_at("confidence", F.lit(f)), F.lit(0.0)), F.lit(0.68))
        p = p.withColumns({"confidence": F.when(off, F.map_concat(F.map_filter("confidence", _but(f)), F.create_map(F.lit(f), most))).otherwise(F.col("confidence")), f: F.when(off, F.col(f"_{f}")).otherwise(F.col(f)), "notes": _note("notes", off, f"{f}_aligned_with_lines")})
    return p.drop("_work_total", "_parts_total")


def _but(field: str):
    return lambda k, v: k != F.lit(field)


def profile(documents: DataFrame, matchers: list[tuple], history: DataFrame) -> DataFrame:
    """id, profile, source of documents (id, source_type, filename, service_name, text). matchers: (priority, id, scope,
    source_type, filename, text, service patterns; None where any will do), lowest priority number first; where the two best
    differ in scope at one priority, or none fits, the profile of history (id, profile) holds, or else the default. A
    pattern that isn't one fits nothing."""
    fits = []
    for priority, number, scope, kind, *patterns in sorted(matchers, key=lambda m: (m[0], m[1])):
        test = F.lit(True) if kind is None else F.col("source_type") == kind
        for c, p in zip(("filename", "text", "service_name"), patterns, strict=True):
            if p is not None:
                try:
                    re.compile(p)
                except re.error:
                    test = F.lit(False)
                    continue
                test = test & F.coalesce(F.col(c), F.lit("")).rlike(FLAGS + p)
        fits.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(priority).alias("priority"), F.lit(scope).alias("scope"))))
    two = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<struct<priority:int,scope:string>>")
    d = documents.select("id", two.alias("m")).join(history.select("id", F.col("profile").alias("_h")), "id", "left")
    best, next_ = F.try_element_at("m", F.lit(1)), F.try_element_at("m", F.lit(2))
    tied = F.coalesce((best["priority"] == next_["priority"]) & (best["scope"] != next_["scope"]), F.lit(False))
    source = F.when(F.size("m") == 0, F.when(F.col("_h").isNotNull(), "history").otherwise("default")).when(tied, F.when(F.col("_h").isNotNull(), "history_fallback").otherwise("ambiguous_fallback")).otherwise("matcher")
    return d.select("id", F.when(source == "matcher", best["scope"]).otherwise(F.coalesce("_h", F.lit("default"))).alias("profile"), source.alias("source"))
