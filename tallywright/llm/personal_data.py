"""Personal data in whole texts: proposed by patterns, confirmed by checksums, scored by context.

Each kind proposes spans by a pattern that runs in linear time, a validator confirms them (Luhn for
cards, mod 97 for bank accounts, value ranges for addresses and phone numbers), and words near a span
move its score up or down. Spans of the four base kinds stay whatever their score; the others are
kept from ``KEEP`` on.

Spans are in code points, the end exclusive. Defined cases: a null or empty text has no span; a null id
stays null; repeated rows are read each; columns beside ``doc_id`` and ``text`` are not looked at; an
empty table gives no row. A text is read once, in its Arrow batch; memory follows the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the output; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
BASE_KINDS = KINDS[:4]
KEEP = 0.5
BEFORE, AFTER = 48, 24
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Digits joined by single blanks, hyphens or dots; addresses and cards lie inside one such cluster.
CLUSTER = re.compile(r"[0-9]++(?:[ .-]?[0-9]++)*+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
SECRET = re.compile(r"[:=] ?[\"']?([A-Za-z0-9_/+-]{16,}+)")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[a-z]+")


class Evidence(NamedTuple):
    """Score of a confirmed span, and words near it that raise or lower it."""

    score: float
    raises: frozenset[str]
    lowers: frozenset[str]


STEP = 0.35
EVIDENCE = {
    "email": Evidence(0.9, frozenset(("mail", "email", "contact", "write")), frozenset(("example", "noreply"))),
    "ip": Evidence(0.6, frozenset(("ip", "address", "host", "server", "client")), frozenset(("version", "release", "section", "build"))),
    "card": Evidence(0.6, frozenset(("card", "credit", "debit", "visa", "payment", "pay")), frozenset(("isbn", "order", "serial", "tracking"))),
    "phone": Evidence(0.6, frozenset(("phone", "call", "tel", "mobile", "fax", "contact")), frozenset(("score", "offset"))),
    "iban": Evidence(0.8, frozenset(("iban", "account", "bank", "transfer")), frozenset(("part", "serial"))),
    "secret": Evidence(0.3, frozenset(("token", "secret", "password", "passwd", "key", "bearer", "credential")), frozenset(("sha", "checksum", "digest", "commit"))),
    "ssn": Evidence(0.3, frozenset(("ssn", "social", "security", "taxpayer")), frozenset(("part", "serial"))),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """The check digit of card numbers: every second digit from the right counts double."""
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        double = 2 * int(d)
        total += double if double < 10 else double - 9
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of bank accounts: the country and check digits moved to the end, letters as 10 to 35."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(filter(str.isdecimal, text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has one ``@``, so each is looked at with what stands on both sides of it."""
    at, last = text.find("@"), 0
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                yield start, last
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _card_parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Card numbers inside a run of digits that is none as a whole: one part, or groups of four."""
    parts = [(m.start(), m.end()) for m in re.finditer("[0-9]++", text[start:end])]
    at = 0
    while at < len(parts):
        a, b = parts[at]
        k = at + 1
        if b - a == 4:
            while k < len(parts) and k < at + 4 and parts[k][1] - parts[k][0] == 4:
                b = parts[k][1]
                k += 1
        found = _digits(text[start + a : start + b])
        if 13 <= len(found) <= 19 and luhn(found):
            yield start + a, start + b
            at = k
        else:
            at += 1


def _score(kind: str, text: str, start: int, end: int) -> float:
    score, raises, lowers = EVIDENCE[kind]
    near = set(WORD.findall(text[max(0, start - BEFORE) : start].lower()))
    near.update(WORD.findall(text[end : end + AFTER].lower()))
    if not raises.isdisjoint(near):
        score += STEP
    if not lowers.isdisjoint(near):
        score -= STEP
    return round(min(max(score, 0.0), 1.0), 2)


def find_spans(text: str) -> list[Span]:
    """All spans of a text by kind in the order of ``KINDS``, then by start."""
    found: dict[str, list[tuple[int, int, bool]]] = {kind: [] for kind in KINDS}
    found["email"] = [(a, b, True) for a, b in _emails(text)] if "@" in text else []
    for cluster in CLUSTER.finditer(text):
        a, b = cluster.span()
        if b - a < 7:
            continue
        for m in ADDRESS.finditer(text, a, b):
            if all(map(_small, m[0].split("."))):
                found["ip"].append((*m.span(), True))
        for m in CARD.finditer(text, a, b):
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append((*m.span(), True))
            elif len(digits) > 13:
                found["card"] += [(*s, False) for s in _card_parts(text, *m.span())]
        found["ssn"] += [(*m.span(), False) for m in SSN.finditer(text, a, b)]
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found["phone"].append((*m.span(), True))
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            found["iban"].append((*m.span(), False))
    for m in SECRET.finditer(text):
        value = m[1]
        if not value.isalpha() and not value.isdecimal():
            found["secret"].append((*m.span(1), False))
    out = []
    for kind in KINDS:
        for start, end, base in found[kind]:
            score = _score(kind, text, start, end)
            if base or score >= KEEP:
                out.append(Span(kind, start, end, score, base))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((s.start, s.end, s.kind) for s in spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, redact: bool = False) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``; ``redact`` adds the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            spans = [find_spans(t) for t in texts]
            columns = {"doc_id": batch["doc_id"], "spans": pa.array([[s._asdict() for s in some] for some in spans], kinds)}
            if redact:
                columns["text"] = pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]
    kinds = pa.list_(pa.struct(fields))
    schema = f"doc_id bigint, spans {SPANS}" + (", text string" if redact else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans of each document."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(_of_kind(base, k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    added = (F.size("spans") - F.size(base)).cast("bigint").alias("n_added")
    least = F.array_min(F.transform("spans", lambda s: s["score"])).alias("least_score")
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), added, least)
