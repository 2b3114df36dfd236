"""Text normalisers as Spark column expressions: identifiers, names, amounts, dates, units, services, vehicles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(ch: str) -> str:
    """What Java compares where case doesn't matter."""
    up = ch.upper() if len(ch.upper()) == 1 else ch
    return up.lower() if len(up.lower()) == 1 else "i"


#: All characters of each fold; no letter that is looked for has one beyond these blocks.
_CASES: dict[str, str] = {}
for _ch in map(chr, [*range(0x2200), *range(0xA640, 0xA6A0)]):
    _CASES[_fold(_ch)] = _CASES.get(_fold(_ch), "") + _ch


def any_case(chars: str) -> str:
    """A class of characters in either case, written out in two parts: Java looks up Latin ones in a table, and the others only
    for a character that isn't."""
    every = sorted({y for x in chars for y in _CASES[_fold(x)]})
    latin, rest = (re.escape("".join(y for y in every if (y < "\u0100") == low)) for low in (True, False))
    return rf"(?-i:[{latin}[\u0100-\uffff&&[{rest}]]])" if rest else f"(?-i:[{latin}])"


#: Letters that look alike, Cyrillic to Latin, in one pass (so that a folded letter is not folded again).
LOOK_ALIKE_FROM = "ёЁОоАаВвЕеКкМмНнРрСсТтУуХхІі—–−‑/\\"
LOOK_ALIKE_TO = "еЕOoAaBbEeKkMmHhPpCcTtYyXxIi----  "
DASHES_FROM, DASHES_TO = "ёЁ—–−‑/\\", "еЕ----  "
#: Names of months.
MONTHS = {"января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12}
#: Letters that text recognition takes for each other, Cyrillic to Latin, and dashes.
OCR_FROM = "ОоАаВвЕеКкМмНнРрСсТтУуХхІі—–−‑"
OCR_TO = "OoAaBbEeKkMmHhPpCcTtYyXxIi----"
#: Units of measure as written, and as kept.
UNITS = {
    "шт": "шт", "шг": "шт", "шt": "шт", "ед": "ед", "компл": "компл", "к-т": "компл", "кт": "компл", "усл": "усл", "л": "л", "кг": "кг", "м": "м", "ч": "ч", "час": "ч", "часа": "ч", "часов": "ч", "нч": "нч", "н.ч": "нч", "н/ч": "нч",
    "hч": "нч", "h.ч": "нч", "h/ч": "нч",
}
#: Legal forms, and what a service's name doesn't hold.
LONG_FORM = r"общество\s*с\s*ограниченной\s*ответственностью"
LEGAL_FORMS = ("ооо", "ао", "пао", "зао", "ип")
NOT_SERVICES = ("стоимость", "работ", "запчаст", "материал", "ндс", "итого", "к оплате", "пробег", "госномер", "заказ", "наряд", "дата")
_FORMS = rf"(?iu)(?={any_case('аозпи')})(?<![\p{{L}}\p{{N}}_])(?:{LONG_FORM}|{'|'.join(LEGAL_FORMS)})(?![\p{{L}}\p{{N}}_])"  # by their first letters
#: [^0-9a-zа-я]+ as ranges: Java takes five times as long for a negated class of several.
OTHERS = r"[\x00-/:-`{-Яѐ-\x{10FFFF}]+"
#: Prefixes of folders that are named after a service.
FOLDER_PREFIXES = ("заказ наряды", "заказ-наряды", "заказ-наряд")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def filled(c: Column) -> Column:
    """c, worked out once; NULL if it is empty."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def _empty_null(c: Column) -> Column:
    return F.when(c != "", c)


def collapse(c: Column) -> Column:
    """Runs of spaces and tabs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t]{2,}|\t", " "))


def collapse_line(c: Column) -> Column:
    return collapse(F.translate(c, " ", " "))


def clean_lines(c: Column) -> Column:
    """One newline convention, lines collapsed, blank ones dropped."""
    once = lambda c, x: bound(c, lambda t: F.when(F.contains(t, F.lit(2 * x)), F.regexp_replace(t, x + "{2,}", x)).otherwise(t))
    for a, b in (("\u00a0", " "), ("\t", " "), ("\r", "\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = once(c, " ")
    for a in (" \n", "\n "):
        c = F.replace(c, F.lit(a), F.lit("\n"))
    return F.btrim(once(c, "\n"), F.lit(" \n"))


def parse_amount(c: Column) -> Column:
    """'1 234,50' -> 1234.5; NULL if it isn't a number."""
    return F.round(F.regexp_replace(F.regexp_replace(c, "[\\s ]", ""), ",", ".").try_cast("double"), 2)


def parse_digits(c: Column) -> Column:
    return filled(F.regexp_replace(c, "[^0-9]+", "")).try_cast("long")


def parse_mileage(c: Column) -> Column:
    return bound(parse_digits(c), lambda n: F.when(n >= 1, n))


def parse_date(c: Column) -> Column:
    """Numeric dates with dots, slashes or dashes (the same twice), day or year first, then 'd month yyyy' anywhere. Two-digit
    years from 69 on are 19xx."""
    return bound(F.lower(collapse(c)), _date)


def _date(c: Column) -> Column:
    num, iso = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})$", r"^(\d{4})([./-])(\d{1,2})\2(\d{1,2})$"
    part = lambda p, i: F.regexp_extract(c, p, i).try_cast("int")
    year = part(num, 4)
    full = F.when(F.length(F.regexp_extract(c, num, 4)) == 4, year).when(year >= 69, year + 1900).otherwise(year + 2000)
    dated = lambda y, m, d: F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")))
    word = r"(\d{1,2})\s+([а-я]+)\s+(\d{4})"
    month = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])[F.regexp_extract(c, word, 2)]
    return F.when(c.rlike(num), dated(full, part(num, 3), part(num, 1))).when(c.rlike(iso), dated(part(iso, 1), part(iso, 3), part(iso, 4))).when(month.isNotNull(), dated(part(word, 3), month, part(word, 1)))


def identifier(c: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-zА-Яа-я]", ""))


def plausible_order_number(c: Column) -> Column:
    return F.coalesce((F.length(F.trim(c)) >= 3) & c.rlike("[0-9]"), F.lit(False))


def fold(c: Column) -> Column:
    return F.translate(c, LOOK_ALIKE_FROM, LOOK_ALIKE_TO)


def folded_code(c: Column) -> Column:
    return _empty_null(F.regexp_replace(F.upper(fold(F.trim(c))), "[^A-Z0-9/_-]+", ""))


def tokens(c: Column) -> Column:
    """Folded, lower-cased words of more than one character."""
    words = F.split(F.regexp_replace(F.lower(fold(F.trim(F.coalesce(c, F.lit(""))))), "[^a-zа-я0-9]+", " "), " ")
    return F.filter(words, lambda x: F.length(x) > 1)


def normalized_name(*cs: Column) -> Column:
    """Distinct tokens of all values, sorted, joined. Stop words never match after folding, so there are none to drop."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[tokens(c) for c in cs]))), " ")


def vehicle_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(F.trim(F.coalesce(c, F.lit(""))), DASHES_FROM, DASHES_TO)), r"\s+", " ")


def scope(c: Column) -> Column:
    return F.when(c.isNotNull(), _empty_null(F.regexp_replace(F.regexp_replace(vehicle_text(c), "[^a-zа-я0-9]+", "_"), "^_+|_+$", "")))


def brand_family(c: Column) -> Column:
    return F.translate(scope(c), "_", "-")


def keywords(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, vehicle_text), lambda x: x != ""))


def vin_prefixes(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9]+", "")), lambda x: x != ""))


def search_text(*cs: Column) -> Column:
    return _empty_null(F.concat_ws(" | ", *[_empty_null(F.trim(c)) for c in cs]))


def ocr_folded(c: Column) -> Column:
    """Letters that recognition mixes up, as one of them; runs of blanks as one."""
    return F.translate(collapse(c), OCR_FROM, OCR_TO)


def compare_token(c: Column) -> Column:
    return _empty_null(identifier(ocr_folded(c)))


def unit(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    bare = F.replace(F.btrim(F.lower(c), F.lit(".,;:!?)(")), F.lit(" "), F.lit(""))
    return F.coalesce(known[bare], known[F.lower(ocr_folded(bare))], _empty_null(bare))


def split_article(c: Column) -> Column:
    """struct<article, name>: the first word is an article if it holds a letter and a digit."""
    head, rest = F.regexp_extract(c, r"^(\S+)\s+(.+)$", 1), F.regexp_extract(c, r"^(\S+)\s+(.+)$", 2)
    coded = head.rlike("[0-9]") & head.rlike(r"\p{L}") & (rest != "")
    return F.struct(F.when(coded, F.upper(fold(head))).alias("article"), F.when(coded, rest).otherwise(F.trim(c)).alias("name"))


def suspicious_service(c: Column, digits: int = 6) -> Column:
    """Nothing, a word that no service has, an amount, or so many digits."""
    low = F.lower(collapse_line(F.coalesce(c, F.lit(""))))
    return (low == "") | low.rlike("|".join(NOT_SERVICES)) | (F.length(F.regexp_replace(low, "[^0-9]", "")) >= digits) | low.rlike(r"\d[\d\s]*[.,]\d{2}")


def amounts_match(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def service_key(c: Column) -> Column:
    """Without legal forms and anything but letters and digits."""
    bare = F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е")), _FORMS, " ")
    return F.regexp_replace(bare, OTHERS, "")


def service_aliases(c: Column, stem: Column | None = None) -> Column:
    """The name, its card's file name, the name without its legal form, that without spaces, and its initials if there are three."""
    short = F.coalesce(_empty_null(F.trim(F.regexp_replace(F.translate(F.regexp_replace(c, _FORMS, " "), "«»\"", "   "), r"\s+", " "))), F.trim(c))
    initials = F.array_join(F.transform(F.split(short, " "), lambda w: F.upper(F.left(w, F.lit(1)))), "")
    every = [F.trim(c), short, *([] if stem is None else [F.trim(stem)]), F.replace(short, F.lit(" "), F.lit("")), F.when(F.length(initials) >= 3, initials)]
    return F.array_distinct(F.filter(F.array(*every), lambda x: x.isNotNull() & (x != "")))


def service_of_folder(path: Column) -> Column:
    """The name of the folder that a file lies in, without a prefix that says what is in it."""
    name = F.trim(F.replace(F.when(F.size(F.split(path, "/")) > 1, F.trim(F.try_element_at(F.split(path, "/"), F.lit(-2)))), F.lit("_"), F.lit(" ")))
    rest = F.btrim(F.regexp_replace(name, "(?iu)^(?:" + "|".join(FOLDER_PREFIXES) + ")", ""), F.lit(" -_"))
    return _empty_null(F.when(F.lower(name).rlike("^(?:" + "|".join(FOLDER_PREFIXES) + ")"), rest).otherwise(name))


def city(c: Column) -> Column:
    return _empty_null(F.trim(F.regexp_extract(c, r"(?iu)г\.\s*([^,]+)", 1)))


def order_number_of_registrar(c: Column) -> Column:
    return _empty_null(identifier(F.regexp_extract(c, r"(?iu)(?:заказ-наряд|заказ наряд)\s*([A-Za-zА-Яа-я0-9/_-]+)", 1)))


def source_key(*cs: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(_empty_null(F.trim(c.cast("string"))), F.lit("-")) for c in cs])


#: Keywords that tell works from parts, in the order in which they are asked: (what is looked at, keywords, kind).
LINE_KINDS = (
    ("expense", ("запчаст", "з/ч", "зч "), "part"),
    ("group", ("услуг", "работ", "ремонт", "обслужив", "шиномонтаж"), "work"),
    ("name", ("ремонт", "замен", "диагност", "мойк", "шиномонтаж", "балансиров", "свар", "буксиров", "эваку", "регулиров", "установк", "демонтаж", "монтаж"), "work"),
    ("expense", ("то и ремонт", "дополнительные расходы", "буксировка", "эвакуация", "комплектация", "предпродажная подготовка", "расходы"), "work"),
)


def line_kind(expense: Column, group: Column, name: Column) -> Column:
    """work or part of an imported line, by its expense item, its group and its name; part if none says so."""
    got = {n: F.lower(F.trim(F.coalesce(c, F.lit("")))) for n, c in (("expense", expense), ("group", group), ("name", name))}
    out = F.lit("part")
    for field, keywords, kind in reversed(LINE_KINDS):
        out = F.when(got[field].rlike("|".join(keywords)), F.lit(kind)).otherwise(out)
    return out


def quantity(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n > 0, n).otherwise(1.0)


def safe_filename(c: Column) -> Column:
    return F.coalesce(_empty_null(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^0-9\p{L}._-]+", "_"), "^[_.]+|_+$", "")), F.lit("file"))


def money(c: Column) -> Column:
    """1234.5 -> '1 234,50 ₽'"""
    return F.concat(F.translate(F.format_number(c, 2), ",.", " ,"), F.lit(" ₽"))


def shown(c: Column, kind: str) -> Column:
    return F.format_string("%.2f", c) if kind == "double" else c.cast("string")


def registry_cell(c: Column) -> Column:
    """'12.0' -> '12'; blank -> NULL"""
    return _empty_null(F.regexp_replace(F.trim(c), r"^(\d+)\.0+$", "$1"))


def registry_list(c: Column) -> Column:
    parts = F.split(F.coalesce(registry_cell(c), F.lit("")), "[,;\\n\\r]")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def registry_time(c: Column) -> Column:
    """Two forms of a date with a time; '#' is none."""
    x = registry_cell(c)
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss")])


def amount_or_zero(c: Column) -> Column:
    """A number of an imported row, two places; NULL and blank are 0."""
    return F.coalesce(F.round(c.try_cast("double"), 2), F.lit(0.0))


def imported_mileage(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.bround(c.try_cast("double"), 0).cast("long"), F.lit(0).cast("long")))


def imported_day(c: Column) -> Column:
    """A date, or a date with a time, in ISO form."""
    return F.try_to_timestamp(F.left(F.trim(c), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")


#: Sections of the report, and what check types belong there, in the order in which they are asked.
SECTIONS = (("catalogs", "vehicle|service"), ("labor_norms", "standard_hours"), ("amounts", "total|duplicate"), ("history", "repeat_repair"))


def report_section(check_type: Column) -> Column:
    out = F.lit("ocr")
    for section, words in reversed(SECTIONS):
        out = F.when(check_type.rlike(words), section).otherwise(out)
    return out


def compared(left: Column, right: Column, kind: str = "text") -> Column:
    """empty / missing / ocr_missing / match / mismatch of an entered and a read value: as text without case, as whole numbers
    (int), or with two places (money)."""
    if kind == "text":
        left, right = (_empty_null(F.lower(F.trim(x.cast("string")))) for x in (left, right))
    else:
        left, right = (F.round(F.replace(F.regexp_replace(x.cast("string"), r"\s+", ""), F.lit(","), F.lit(".")).try_cast("double"), 0 if kind == "int" else 2) for x in (left, right))
    return F.when(left.isNull() & right.isNull(), "empty").when(left.isNull(), "missing").when(right.isNull(), "ocr_missing").when(left == right, "match").otherwise("mismatch")


def readiness(statuses: Column) -> Column:
    """struct<missing, attention, ready, can_confirm> of the statuses of required fields."""
    n = lambda *of: F.size(F.filter(statuses, lambda x: x.isin(*of)))
    return F.struct(n("missing").alias("missing"), n("missing", "mismatch").alias("attention"), (F.size(statuses) - n("missing")).alias("ready"), (n("missing") == 0).alias("can_confirm"))


def date_in_filename(c: Column) -> Column:
    """Day first, or else in ISO form."""
    day, iso = r"(\d{2})[._-](\d{2})[._-](\d{4})", r"(\d{4})[._-](\d{2})[._-](\d{2})"
    of = lambda p, *at: F.try_to_timestamp(F.concat_ws("-", *[F.regexp_extract(c, p, i) for i in at]), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(c.rlike(day), of(day, 3, 2, 1)).when(c.rlike(iso), of(iso, 1, 2, 3))


def order_number_in_filename(c: Column) -> Column:
    marked = r"№\s*([A-Za-zА-Яа-я0-9\-/]+)"
    return F.coalesce(_empty_null(F.regexp_extract(c, marked, 1)), _empty_null(F.regexp_extract(c, r"(?iu)(?:заказ[\s_-]*наряд|зн)[^A-Za-z0-9_]{0,3}([A-Za-zА-Яа-я0-9\-/]+)", 1)))


def vehicle_kind_of_plate(c: Column) -> Column:
    """Trailers have two letters before four digits."""
    return F.when(F.regexp_replace(F.upper(fold(c)), "[^A-Z0-9]", "").rlike(r"^[A-Z]{2}[0-9]{6,7}$"), "trailer").otherwise("truck")


def humanised(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))


def plate_candidates(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(fold(c)), F.lit(r"(?<![A-Z0-9])([A-Z]\s?\d{3}\s?[A-Z]{2}\s?\d{2,3}|[A-Z]{2}\s?\d{4}\s?\d{2,3})(?![A-Z0-9])"), 1), lambda x: F.regexp_replace(x, r"\s", "")))


def vin_candidates(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(r"(?<![A-Z0-9])([A-HJ-NPR-Z0-9]{17})(?![A-Z0-9])"), 1))


def contains_any(q: str, *cs: Column) -> Column:
    """An empty query matches everything."""
    q = q.strip().lower()
    return F.lit(True) if not q else F.exists(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in cs]), lambda x: x.contains(q))


def fuzzy_pattern(phrase: str, classes: dict[str, str] | None = None) -> str:
    """A pattern in which each character stands for all that look like it, and words may run together."""
    classes = classes or {a.lower(): f"[{re.escape(a)}{re.escape(b)}]" for a, b in zip(LOOK_ALIKE_FROM[2:-6], LOOK_ALIKE_TO[2:-6], strict=True)}
    return r"[\s-]*".join("".join(classes.get(ch.lower(), re.escape(ch)) for ch in word) for word in phrase.split())


def mean_confidence(m: Column) -> Column:
    v = F.map_values(m)
    return F.when(F.size(v) > 0, F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), 2))
