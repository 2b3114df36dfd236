"""Work orders from text: header fields, and work and part lines. Regular expressions run in Arrow batches; rules that
users write are data, and a rule that doesn't compile is skipped."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

#: Any short word between quantity and price is a unit; it is normalised afterwards.
_UNIT = r"(?P<unit>[A-Za-zА-Яа-яЁё./-]{1,8})"
_NUM = r"\d{1,3}(?: \d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
_AMOUNTS = rf"(?P<qty>\d+(?:[.,]\d+)?)\s+(?:{_UNIT}\s+)?(?P<price>{_NUM})\s+(?P<total>{_NUM})"
_TAIL, _INLINE = re.compile(_AMOUNTS, re.I), re.compile(rf"\s*(?P<name>\S.*?)\s+{_AMOUNTS}[.,;]?(?!\S)", re.I)
_CODE = re.compile(r"^(?P<code>(?=\S*\d)(?=\S*[A-Za-zА-Яа-я])[\w./-]{2,})\s+(?P<rest>.+)$")
#: What begins the sections of an order, lines with a label of their own, and totals, which are no items. The
#: oil's name "Total" begins items too.
_WORKS, _PARTS = r"работы|услуги|работа(?=\s*:)", r"запчасти|запасные части|материалы|запчасть(?=\s*:)"
_HEAD = re.compile(rf"^\W*(?:(?P<work>works|labou?r)|(?P<part>parts|materials))\b|(?:(?P<works>{_WORKS})|(?P<parts>{_PARTS}))", re.I)
_LABEL = re.compile(r"^(?:\W*\d+[.)])?\W*(?:(?P<work>работа)|(?P<part>запчасть))\s*:\s*", re.I)
_LISTED = re.compile(r"^\W*(?:(?:выполненные )?работы|услуги|запчасти|запасные части|материалы|works|labou?r|parts|materials)\s*:", re.I)
_STOP = re.compile(r"^\W*(?:(?:работы|услуги|запчасти|материалы)\s+)?(?:итого|всего|к оплате|(?:grand )?total(?!\s+[^\W\d])|total\s+(?:due|parts|works|labou?r|materials))\b", re.I)
_SUMS = re.compile(r"\b(?:итого|к оплате)\b", re.I)
_FOOTER = r"стоимость (?:работ|запчастей|материалов)|(?:работы|услуги|запчасти|материалы) итого|итого|ндс|к оплате|всего|сервис|сто|исполнитель|подрядчик"
_MARK = re.compile(rf"\b(?:(?P<stop>{_FOOTER})|(?P<work>{_WORKS}|(?:works|labou?r)(?=\s*:))|(?P<part>{_PARTS}|(?:parts|materials)(?=\s*:)))\b\s*(?P<colon>:?)", re.I)
_BARE = re.compile(r"\b(работа|запчасть)\b(?!\s*:)", re.I)
#: Each match of _STOP, _LABEL, _LISTED, _HEAD and _SUMS holds one of them, once case is folded.
_ROOTS = re.compile("работ|услуг|запч|запас|матер|итого|всего|оплате|work|labo|part|mater|total")
_OCR = str.maketrans(text.OCR_FROM, text.OCR_TO)
PARSERS = ("raw", "date", "amount", "digits_int")
def _amount(s: str) -> float | None:
    try:
        return round(float(re.sub(r"[\s ]", "", s).replace(",", ".")), 2)
    except ValueError:
        return None


@functools.lru_cache(1024)
def _unit(s: str | None) -> str | None:
    bare = (s or "").lower().strip(".,;:!?)(")
    return text.UNITS.get(bare) or text.UNITS.get(bare.translate(_OCR).lower()) or bare or None


def _item(kind: str, name: str, m: re.Match) -> dict:
    name = name.lstrip(" :;-") or name
    coded = _CODE.match(name)
    return {"kind": kind, "code": coded["code"].upper() if coded else None, "name": coded["rest"] if coded else name, "quantity": _amount(m["qty"]), "unit": _unit(m["unit"]), "price": _amount(m["price"]), "line_total": _amount(m["total"])}


def _inline(flat: str) -> list[dict]:
    """Items that stand in one run of text, a section after the other. A marker without a colon inside an item's name begins
    no section."""
    bodies, kind, start = [], None, 0
    for m in _MARK.finditer(flat):
        to = next(k for k in ("stop", "work", "part") if m[k])
        if kind and to != "stop" and not m["colon"] and (to == kind or not m[to][0].isupper() and flat[: m.start()].rstrip()[-1:].isalpha()):
            continue
        bodies.append((kind, flat[start : m.start()]))
        kind, start = None if to == "stop" else to, m.end()
    out = []
    for kind, body in [*bodies, (kind, flat[start:])]:
        at = 0
        while kind and (m := _INLINE.match(body, at)):
            out.append(_item(kind, m["name"], m))
            at = m.end()
    return out


def _whole(line: str) -> tuple[str, re.Match] | None:
    """The shortest name that amounts follow up to the end of a line whose words are parted by one space each."""
    if not line[-1:].isdecimal():
        return None
    at = line.find(" ", 1)
    while at > 0:
        if line[at + 1].isdecimal() and (m := _TAIL.fullmatch(line, at + 1)):
            return line[:at], m
        at = line.find(" ", at + 1)
    return None


@functools.lru_cache(1024)
def _signs(line: str) -> tuple[bool, bool, str | None, int, bool, str | None]:
    """What a line is by its words: a sum, a total, a label's kind and where it ends, a list, a heading's kind. Orders share such lines."""
    label, head = _LABEL.match(line), _HEAD.search(line)
    kind = lambda m, *works: m and ("work" if any(m[w] for w in works) else "part")
    return bool(_SUMS.search(line)), bool(_STOP.match(line)), kind(label, "work"), label.end() if label else 0, bool(_LISTED.match(line)), kind(head, "work", "works")


class Order:
    """The lines of one order, one after the other. Only while no line has been an item is what was read kept, for the items
    that stand inside running text."""

    def __init__(self):
        self.section, self.count, self.unread = None, 0, []

    def _numbered(self, items: list[dict]) -> list[dict]:
        self.count += len(items)
        return [{"line": n, **x} for n, x in enumerate(items, self.count - len(items) + 1)]

    def read(self, raw: str | None) -> list[dict]:
        """The items of one line."""
        line = " ".join((raw or "").split())
        if not line:
            return []
        found = self._numbered(self._items(line))
        if not self.count:
            self.unread.append(line)
        elif self.unread:
            self.unread = []
        return found

    def _items(self, line: str) -> list[dict]:
        if not _ROOTS.search(line.casefold()):  # as most lines are: an item or nothing
            item = _whole(line) if self.section else None
            return [_item(self.section, *item)] if item else []
        sums, stops, label, end, lists, heads = (_signs if len(line) < 200 else _signs.__wrapped__)(line)
        if stops:
            return []
        item = None if sums and not label else _whole(line[end:])
        if label:
            self.section = label
        elif lists and (listed := _inline(line)):
            self.section = listed[-1]["kind"]
            return listed
        elif not (self.section and item) and heads:
            self.section = heads
            return []
        return [_item(self.section, *item)] if self.section and item else []

    def rest(self) -> list[dict]:
        """After the last line: the items inside the text, if no line was one."""
        if self.count:
            return []
        flat = " ".join(self.unread)
        return self._numbered(_inline(flat) or _inline(_BARE.sub(r"\1:", flat)))


def parse_lines(content: str | None) -> list[dict]:
    """Lines of the works and parts sections, and lines with labels of their own, in order; if there are none, the items that
    stand inside running text."""
    order = Order()
    return [x for line in (content or "").splitlines() for x in order.read(line)] + order.rest()


LINES = "id long, line int, kind string, code string, name string, quantity double, unit string, price double, line_total double"


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in LINES.split(", "))])


def _batch(items: list[tuple]) -> pa.RecordBatch:
    """Items (id, item) as rows of LINES."""
    columns = [[i for i, _ in items], *([x[name] for _, x in items] for name in _SCHEMA.names[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def line_items(documents: DataFrame) -> DataFrame:
    """A row for each line of documents (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(i, x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in parse_lines(t)])

    return documents.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, LINES)


def line_items_of_rows(lines: DataFrame) -> DataFrame:
    """The same of lines that are rows (id, line_no, text): an order's lines pass through one task in order, batch by batch,
    and are never one text. A null id is an order of its own kind; lines of one number come in the order of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, at, out = Order(), None, []

        def sent() -> pa.RecordBatch:
            made = _batch(out)
            out.clear()
            return made

        for batch in batches:
            for id_, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (id_,) != at:
                    out += [(at[0], x) for x in order.rest()] if at else []
                    order, at = Order(), (id_,)
                out += [(id_, x) for line in (content or "").splitlines() for x in order.read(line)]
            yield sent()
        out += [(at[0], x) for x in order.rest()] if at else []
        yield sent()

    ordered = lines.select(F.col("id").cast("long").alias("id"), "line_no", "text").repartition("id").sortWithinPartitions("id", "line_no", "text")
    return ordered.select("id", "text").mapInArrow(run, LINES)



def rule_matches(documents: DataFrame, rules: list[tuple]) -> DataFrame:
    """id, field, value, confidence: user rules (field, pattern, parser, priority, and, if given, confidence and whether it is
    active), lowest priority number first; the first that matches decides, and a match that its parser can't read is invalid
    (NULL), without any other rule being tried. A rule that doesn't compile is skipped."""
    ready = []
    for field, pattern, parser, _, sure, active in sorted(((*r, 0.9, True)[:6] if len(r) == 4 else (*r, True)[:6] for r in rules), key=lambda r: (r[3], r[1])):
        if active:
            try:
                ready.append((field, re.compile(pattern, re.I | re.M), parser, float(sure)))
            except re.error:
                continue

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                done: set[str] = set()
                for field, pattern, parser, sure in ready:
                    if field not in done and (m := pattern.search(t or "")):
                        done.add(field)
                        rows.append((i, field, m[1] if m.groups() else m[0], parser, sure))
            yield pd.DataFrame(rows, columns=["id", "field", "value", "parser", "confidence"])

    got = documents.select("id", "text").mapInPandas(run, "id long, field string, value string, parser string, confidence double")
    v = F.col("value")
    return got.select("id", "field", F.when(F.col("parser") == "amount", text.parse_amount(v).cast("string")).when(F.col("parser") == "date", text.parse_date(v).cast("string")).when(F.col("parser") == "digits_int", text.parse_digits(v).cast("string")).otherwise(F.nullif(F.trim(v), F.lit(""))).alias("value"), "confidence")


def _mojibake(s: str | None) -> str | None:
    """The most plausible of a text's re-decodings: known words, then Cyrillic letters, then letters and digits."""
    if s is None:
        return None
    every = [s]
    for a, b in (("cp1251", "utf-8"), ("latin-1", "utf-8"), ("latin-1", "cp1251"), ("cp866", "cp1251")):
        try:
            every.append(s.encode(a).decode(b))
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    score = lambda t: (sum(w in t.lower() for w in ("заказ", "работ", "итого", "пробег", "дата")), len(re.findall("[а-яё]", t, re.I)), sum(c.isalnum() for c in t))
    return max(every, key=score)


@F.pandas_udf(T.StringType())
def repaired(s: pd.Series) -> pd.Series:
    return s.map(_mojibake)
