"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doculith.llm.common import lean, sliced

#: Kinds in the order in which spans with one start are listed; the base kinds come first.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit alone: a later start fails or matches just as the first does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_OTHER = re.compile(r"[^0-9]")

#: Words that make a kind likelier when they stand within WINDOW characters before or after a span.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Score of a confirmed span before context, what a context word adds, and the least score that is kept.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
LIFT, LEAST, WINDOW = 0.2, 0.5, 40
#: Context words stand alone: "ip" does not count in "ship".
_CONTEXT = {kind: re.compile(r"(?<![^\W_])(?:" + "|".join(words) + r")s?(?![^\W_])") for kind, words in CONTEXT.items()}

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Works outward from each @, so that a long word without one is never tried again and again."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            # No later match may begin before a failed @, as no part of an address holds another one.
            end, at = max(end, at + 1), text.find("@", at + 1)


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans that the patterns find and the validators confirm, kind by kind."""
    for start, end in emails(text):
        yield start, end, "email"
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        digits = _OTHER.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), "card"
    for m in _PHONE.finditer(text):
        if 9 <= len(_OTHER.sub("", m[0])) <= 15:
            yield m.start(), m.end(), "phone"
    for m in _IBAN.finditer(text):
        flat = m[0].replace(" ", "")
        if 15 <= len(flat) <= 34 and mod97(flat):
            yield m.start(), m.end(), "iban"
    for m in _SSN.finditer(text):
        yield m.start(), m.end(), "ssn"


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score), by start and then kind. Base kinds always stay; the others need a score of LEAST."""
    found = []
    for start, end, kind in proposals(text):
        near = text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()
        score = min(1.0, START[kind] + LIFT * bool(_CONTEXT[kind].search(near)))
        if kind in BASE or score >= LEAST:
            found.append((start, end, kind, score))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return found


def redacted(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first that begins is named."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


SPAN = "array<struct<start:bigint,end:bigint,kind:string,score:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row. A null or empty text has no spans; repeated rows each give a row; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in sliced(batches, text_col):
            found = [[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in find(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPAN)], names=["id", "spans"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, spans {SPAN}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, with every span of the text replaced by its kind in brackets; null texts stay null, empty ones empty, repeated rows alike."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for b in sliced(batches, text_col):
            texts = [t if t is None else redacted(t, find(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(lean(run), schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `detect` finds, as counts and one line of spans for each row, by expressions over its spans."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return detect(docs, id_col, text_col).select(id_col, *counts, F.sha2(line(of(*BASE)).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
