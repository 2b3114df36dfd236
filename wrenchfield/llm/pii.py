"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Beside them, each document's words that hold a
digit or "@" are the nodes of a graph: neighbouring words are linked in a chain, and each word also with the one before
it in the document that is the same or similar (the same letters and digits, or the same last seven digits), however
far away. Labels are none or one of the four kinds. A node's potentials come from its shape, a softmax regression on
what the patterns find; a link's potentials are smoothed log ratios of label pairs (piecewise training). Both need counts
only, which are taken over all documents. Loopy sum-product message passing, until the messages settle, then makes labels
consistent over the document, so that it also finds what no pattern takes by itself, as two cards side by side or a phone number without its prefix
that stands in full elsewhere. Added spans never overlap the patterns' spans, which all stay.

Offsets are code points. Defined results: a null or empty text has no spans; a null doc_id is kept; repeated rows get
the same spans each; an empty table gives no rows; further columns are kept, but for those with a result's name.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

KINDS = ("email", "ip", "card", "phone")
K = len(KINDS) + 1  # labels: none, and the kinds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never ends before a digit, so the look-behind loses none
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")
_MARK, _BLANK, _BLANKS = re.compile("[0-9@]"), re.compile(r"[\x20\x09-\x0D]"), frozenset("\x20\x09\x0a\x0b\x0c\x0d")


def _octet(digits: str) -> bool:
    """At most 255, whatever zeros stand before."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the run of local characters before each "@", from the last match's end on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = end = m.end()
        at = text.find("@", end)


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), in order of kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 2 * 19 - 1 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


_DIGITS, _LENGTHS = (1, 2, 4, 7, 9, 11, 12, 16, 17, 20), (2, 5, 8, 12, 16, 20, 32)
N_FEATURES = 1 + 11 + 8 + 16
#: Features of a node's shape that do not depend on the words around it.


def _features(token: str, beside: tuple[bool, bool]) -> np.ndarray:
    x = np.zeros(N_FEATURES, np.float32)
    digits = _NO_DIGITS.sub("", token)
    x[0] = x[1 + _bucket(len(digits), _DIGITS)] = x[12 + _bucket(len(token), _LENGTHS)] = 1
    letters = sum(c.isalpha() for c in token)
    parts = token.split(".")
    local, _, domain = token.partition("@")
    x[20:] = (
        "@" in token, bool(local) and "." in domain, token[:1] == "+", token[:1] == "(", "-" in token, letters > 0, letters == 0,
        bool(token) and token == digits, len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), len(parts) == 4,
        16 <= len(digits) <= 19 and not letters and luhn(digits), 7 <= len(digits) <= 15 and not letters, "=" in token or '"' in token,
        letters > 0 and len(digits) > 0 and len(token) >= 20, *beside,
    )
    return x


@dataclass
class Graph:
    start: np.ndarray
    end: np.ndarray
    x: np.ndarray
    chain: np.ndarray  # pairs of nodes
    skip: np.ndarray


def _nodes(text: str) -> Iterator[tuple[int, int]]:
    """The words that hold a digit or "@"; every character is looked at once or twice, however long its word."""
    at = 0
    while hit := _MARK.search(text, at):
        start = hit.start()
        while start > at and text[start - 1] not in _BLANKS:
            start -= 1
        blank = _BLANK.search(text, hit.end())
        at = blank.start() if blank else len(text)
        yield start, at


def graph(text: str) -> Graph:
    start, end, rows, chain, skip = [], [], [], [], []
    last: dict[str, int] = {}
    found = list(_nodes(text))
    for i, (a, b) in enumerate(found):
        while b > a and text[b - 1] in ".,;:!?)\"'|":
            b -= 1
        while a < b and text[a] in "\"'|,;:":
            a += 1
        token = text[a:b]
        beside = (i > 0 and found[i][0] - found[i - 1][1] == 1, i + 1 < len(found) and found[i + 1][0] - found[i][1] == 1)
        rows.append(_features(token, beside))
        start.append(a), end.append(b)
        if beside[0]:
            chain.append((i - 1, i))
        digits = _NO_DIGITS.sub("", token)
        for key in {"=" + hashlib.blake2b("".join(c for c in token.lower() if c.isalnum()).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), *(["~" + digits[-7:]] if len(digits) >= 7 and token.lstrip("+(")[:1].isdigit() else [])}:
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    pairs = lambda p: np.array(p, np.int64).reshape(-1, 2)
    return Graph(np.array(start, np.int64), np.array(end, np.int64), np.array(rows, np.float32).reshape(-1, N_FEATURES), pairs(chain), pairs(skip))


def _weak_labels(g: Graph, base: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(len(g.start), np.int64)
    for kind, a, b in base:
        out[(g.start < b) & (g.end > a)] = kind + 1
    return out


@dataclass
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def _pairs(g: Graph, z: np.ndarray) -> np.ndarray:
    """How often each two labels stand at a link's ends: of the chain, and of the skips."""
    return np.stack([np.bincount(z[e[:, 0]] * K + z[e[:, 1]], minlength=K * K).reshape(K, K) for e in (g.chain, g.skip)])


@dataclass
class Counts:
    pairs: np.ndarray  # how often each two labels stand at a link's ends: of the chain, and of the skips
    shapes: np.ndarray  # bits of the features that occur together
    labels: np.ndarray  # shapes x labels: how often


_BIT = np.int64(1) << np.arange(N_FEATURES, dtype=np.int64)


def counted(texts: Iterable[str]) -> Counts:
    """What the patterns find in the texts, counted: enough to fit the model."""
    pairs, shapes = np.zeros((2, K, K), np.int64), Counter()
    for text in texts:
        g = graph(text)
        z = _weak_labels(g, patterns(text))
        pairs += _pairs(g, z)
        shapes.update(zip((g.x.astype(np.int64) @ _BIT).tolist(), z.tolist(), strict=True))
    return _counts(pairs, [(s, z, n) for (s, z), n in shapes.items()])


def _counts(pairs: np.ndarray, rows: list[tuple[int, int, int]]) -> Counts:
    shape, label, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    shapes, at = np.unique(shape, return_inverse=True)
    labels = np.zeros((len(shapes), K))
    np.add.at(labels, (at, label), n)
    return Counts(pairs, shapes, labels)


def fit(counts: Counts, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Softmax regression of labels on shapes, and smoothed log ratios of label pairs."""
    x = (counts.shapes[:, None] & _BIT > 0).astype(np.float64)
    n = counts.labels.sum(axis=1, keepdims=True)
    w = np.zeros((N_FEATURES, K))
    w[0, 0] = 4.0  # without anything to learn from, nothing is found
    for _ in range(steps if len(x) else 0):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (x.T @ (n * p - counts.labels) / n.sum() + ridge * w)
    pairs = []
    for c in counts.pairs:
        seen = c + 0.5
        seen = (seen + seen.T) / seen.sum() / 2
        one = seen.sum(axis=1)
        pairs.append(np.clip(np.log(seen / np.outer(one, one)), -3, 3))
    return Model(w, *pairs)


def marginals(g: Graph, m: Model, tolerance: float = 1e-3, damp: float = 0.3) -> np.ndarray:
    """Beliefs over labels by loopy sum-product in the log domain, until no message changes by the tolerance. Messages that
    swing are damped more and more; only those that never settle end after as many rounds as reach over the whole document."""
    unary = g.x @ m.unary
    edges = np.concatenate([g.chain, g.skip])
    soft = lambda z: z - np.log(np.exp(z - z.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)) - z.max(axis=-1, keepdims=True)
    if len(edges):
        pot = np.concatenate([np.broadcast_to(p, (len(e), *p.shape)) for p, e in ((m.chain, g.chain), (m.skip, g.skip))])
        source, to = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        n = len(edges)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, unary.shape[1]))
        for n_round in range(1, len(unary) + 101):
            belief = unary.copy()
            np.add.at(belief, to, message)
            inner = (belief[source] - message[back])[:, :, None] + pot
            top = inner.max(axis=1)
            new = soft(np.log(np.exp(inner - top[:, None, :]).sum(axis=1)) + top)
            if np.abs(new - message).max() < tolerance:
                break
            message = damp * message + (1 - damp) * new
            if n_round % 50 == 0:
                damp = min(0.9, (1 + damp) / 2)
        unary = unary.copy()
        np.add.at(unary, to, message)
    return np.exp(soft(unary))


def added(text: str, base: list[tuple[int, int, int]], m: Model, sure: float) -> list[tuple[int, int, int]]:
    """Spans that the field adds; the words of one phone number make one span."""
    g = graph(text)
    if not len(g.start):
        return []
    covered = _weak_labels(g, base) > 0
    if covered.all():
        return []
    p = marginals(g, m)
    best = p.argmax(axis=1)
    free = ~covered & (g.end > g.start)
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= sure) & free).tolist():
        kind, a, b = int(best[i]) - 1, int(g.start[i]), int(g.end[i])
        if kind == 3:  # the prefix in the words before belongs to the number
            while i and free[i - 1] and a - g.end[i - 1] in (1, 2) and text[g.start[i - 1]] in "+(" and g.end[i - 1] - g.start[i - 1] <= 6:
                i -= 1
                a = int(g.start[i])
        if out and kind == 3 and out[-1][0] == 3 and a - out[-1][2] <= 1:
            out[-1] = (3, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return [s for s in out if s[0] <= 1 or sum(c.isdigit() for c in text[s[1] : s[2]]) >= 7]


def _with_digits(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts that hold a digit or "@"; the others can't hold any span."""
    hit = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))])
    return hit[at[1:]] > hit[at[:-1]]


def model(docs: DataFrame) -> Model:
    """Fitted on all documents: tasks count label pairs and shapes, Spark adds them up. There are no more shapes than
    features' values allow (some hundreds of them occur), whatever the input's size."""
    shared.small_batches(docs.sparkSession)

    def run(batches):
        pairs, shapes = np.zeros((2, K, K), np.int64), Counter()
        for batch in words.slices(batches):
            c = counted(batch.column(0).to_pylist())
            pairs += c.pairs
            for i, z in zip(*np.nonzero(c.labels), strict=True):
                shapes[int(c.shapes[i]), int(z)] += int(c.labels[i, z])
        rows = [(0, int(i), 0, int(n)) for i, n in enumerate(pairs.ravel()) if n] + [(1, s, z, n) for (s, z), n in shapes.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["kind", "at", "label", "n"])

    some = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    got = some.mapInArrow(run, "kind int, at long, label int, n long").groupBy("kind", "at", "label").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(2 * K * K)
    for r in got:
        if not r["kind"]:
            pairs[r["at"]] = r["n"]
    return fit(_counts(pairs.reshape(2, K, K), [(r["at"], r["label"], r["n"]) for r in got if r["kind"]]))


def find(docs: DataFrame, fitted: Model | None = None, sure: float = 0.9) -> DataFrame:
    """docs with base and spans: arrays of (kind, start, end), sorted by kind as in KINDS, then start."""
    shared.small_batches(docs.sparkSession)
    docs = docs.drop("base", "spans")
    fitted = fitted or model(docs)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in words.slices(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            some = _with_digits(*words.buffers(column))
            base, every = [[]] * len(column), [[]] * len(column)
            for i in np.flatnonzero(some).tolist():
                text = column[i].as_py()
                base[i] = patterns(text)
                every[i] = sorted(base[i] + added(text, base[i], fitted, sure))
            as_rows = lambda x: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x], span)
            yield pa.record_batch([*batch.columns, as_rows(base), as_rows(every)], names=[*batch.schema.names, "base", "spans"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = "array<struct<kind:int,start:int,end:int>>"
    return docs.mapInArrow(run, f"{ddl}, base {kind}, spans {kind}")


def redact(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """docs with each found span of text replaced by its kind in angle brackets (overlapping spans by the first), n_chars anew."""
    shared.small_batches(docs.sparkSession)
    fitted = fitted or model(docs)

    def run(batches):
        for batch in words.slices(batches):
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            some = _with_digits(*words.buffers(column))
            texts = column.to_pylist()
            for i in np.flatnonzero(some).tolist():
                base = patterns(texts[i])
                done, parts = 0, []
                for a, b, kind in sorted((a, b, k) for k, a, b in base + added(texts[i], base, fitted, 0.9)):
                    if a < done:  # the rest of an overlapping span goes with the one before
                        done = max(done, b)
                        continue
                    parts += [texts[i][done:a], f"<{KINDS[kind]}>"]
                    done = b
                texts[i] = "".join([*parts, texts[i][done:]])
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(spans: str):
    name = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k))])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(i: int):
    return lambda span: span["kind"] == F.lit(i)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(shared.documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    n = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
