"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Base kinds are email, ip, card (Luhn) and phone; the method adds iban (mod 97).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import documents, small

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone", "iban")
#: Score of a span of each kind before its context is seen.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
#: Words near a span that make it likelier, or less likely, to be personal data.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "order", "isbn", "example", "sample", "test")
#: Code points on both sides of a span that count as near; what a word adds or takes; the least score that is masked.
NEAR, STEP, MASKED = 40, 0.2, 0.35
#: Lengths of an IBAN by registered country.
_COUNTRIES = """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29
    ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20
    LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29
    PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20
    YE30
"""
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in _COUNTRIES.split()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Atomic and possessive forms of the given patterns: the same matches, found in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        elif start < at:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every confirmed span, by start and then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    for m in _IBAN.finditer(text):
        raw = m[0].replace(" ", "")
        size = IBAN_LENGTHS.get(raw[:2])
        # Words of capitals may follow: the country tells how long the number is.
        if size and len(raw) >= size and mod97(raw[:size]):
            end, seen = m.start(), 0
            while seen < size:
                seen += text[end] != " "
                end += 1
            out.append(("iban", m.start(), end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def score(text: str, span: tuple[str, int, int]) -> float:
    """The kind's prior, raised or lowered once by words near the span."""
    kind, a, b = span
    near = set(_WORD.findall((text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]).lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * (not near.isdisjoint(CONTEXT[kind])) - STEP * (not near.isdisjoint(AGAINST)))), 3)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        cols: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "scores": []}
        for x in batch.column("text"):
            text = x.as_py()
            spans = find(text)
            for k in KINDS:
                cols[f"n_{k}"].append(sum(s[0] == k for s in spans))
            base = joined([s for s in spans if s[0] != "iban"])
            cols["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            cols["spans"].append(joined(spans))
            cols["scores"].append(",".join(str(score(text, s)) for s in spans))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in cols.items()})


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_iban, base_sha256, spans, scores.

    A null text counts as empty and has no spans.  Offsets are code points.  Spans of two kinds may overlap, and all are
    given.  Repeated rows and a null doc_id have rows of their own; other columns, whatever their names, aren't read; an empty table gives no rows.
    Rows are read where they are; nothing is shuffled.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return documents(docs).mapInArrow(_report, f"doc_id long, {counts}, base_sha256 string, spans string, scores string")


def mask(text: str) -> str:
    """The text with every span of enough score replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, from the first start to the last
    end, by the kind of the best score; of equal ones, the first.
    """
    out, at, groups = [], 0, []
    for s in find(text):
        if (own := score(text, s)) < MASKED:
            continue
        if groups and s[1] < groups[-1][1]:
            last = groups[-1]
            last[1] = max(last[1], s[2])
            if own > last[2]:
                last[2:] = own, s[0]
        else:
            groups.append([s[1], s[2], own, s[0]])
    for a, b, _, kind in groups:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data masked in text and n_chars counted anew; other columns are untouched."""
    kind = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            texts = [None if x is None else mask(x) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, kind)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(kind["n_chars"].dataType))
    return out
