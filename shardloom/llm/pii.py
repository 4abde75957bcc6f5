"""Personal data: regular expressions propose spans, validators confirm, context scores.

Kinds: email, ip, card (12 to 19 digits that pass Luhn) and phone (9 to 15 digits) make up
the base; iban (mod-97) and ssn (number groups in use, confirmed by a context word) are
added; an IBAN is as long as its country's are, whatever follows it.  A span's score starts
from its kind's prior; words close before or after it that speak for its kind raise it, words
that speak for another use (versions, orders, ...) lower it.  Base spans are always reported,
with their scores; added ones from ``LEAST`` on.  An IBAN in lower case needs a known country.

Nulls: a null text is empty.  Texts without a digit or an @ cost two substring searches.
All patterns run in linear time, so very long texts are no special case.  Rows that repeat
a doc_id are one row each; of kinds that find the same place each is a span; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE, LEAST, NEAR = KINDS[:4], 0.5, 48
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
SPEAKS_FOR = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "pay"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "contact"},
    "iban": {"iban", "account", "bank", "konto", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
SPEAKS_AGAINST = {"version", "release", "order", "isbn", "serial", "part", "section", "build"}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
_IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile("[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    last = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            last = m.end()
            yield at, last


def _iban_end(text: str, start: int, stop: int) -> int | None:
    """Where an IBAN that begins at ``start`` ends: at its country's length, for another country at the last word edge where mod-97 holds."""
    length = _IBAN_LENGTHS.get(text[start : start + 2].upper())
    places = [i for i in range(start, stop) if text[i] != " "]
    for n in (length,) if length else range(len(places), 14, -1):
        if n > len(places):
            continue
        end = places[n - 1] + 1
        found = text[start:end].replace(" ", "")
        if (length or found.isupper()) and (end == len(text) or not (text[end].isascii() and text[end].isalnum())) and mod97(found):
            return end
    return None


def _ibans(text: str):
    at = 0
    while m := _IBAN.search(text, at):
        end = _iban_end(text, *m.span())
        if end:
            yield m.start(), end
        at = end or m.start() + 1


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) < 4 and int(part or "0") <= 255


def proposals(text: str):
    """(start, end, kind) of the confirmed spans, in code points, end exclusive."""
    if "@" in text:
        yield from ((a, b, "email") for a, b in _emails(text))
    if not _DIGIT.search(text):
        return
    if "." in text:
        yield from ((*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split("."))))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield *m.span(), "card"
    if "+" in text:
        yield from ((*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    yield from ((a, b, "iban") for a, b in _ibans(text))
    yield from ((*m.span(), "ssn") for m in _SSN.finditer(text))


def score(text: str, start: int, end: int, kind: str) -> float:
    near = {*_WORD.findall(text[max(0, start - NEAR) : start].lower()), *_WORD.findall(text[end : end + NEAR].lower())}
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.3 * bool(near & SPEAKS_FOR[kind]) - 0.3 * bool(near & SPEAKS_AGAINST))), 2)


def spans_of(text: str) -> list[tuple[int, int, str, float]]:
    found = sorted(proposals(text), key=lambda x: (x[0], KINDS.index(x[2])))
    scored = [(a, b, kind, score(text, a, b, kind)) for a, b, kind in found]
    return [x for x in scored if x[2] in BASE or x[3] >= LEAST]


def find_pii(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, spans (start, end, kind, score), base_sha256."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans_of(x) for x in batch.column("text").to_pylist()]
        rows = [[dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in s] for s in found]
        base = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, _ in s if k in BASE).encode()).hexdigest() for s in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind), pa.array(base)], names=["doc_id", "spans", "base_sha256"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return mapped(source, fn, "doc_id long, spans array<struct<start:long,end:long,kind:string,score:double>>, base_sha256 string")


def masked(text: str) -> str:
    """The text with its spans replaced by their kinds."""
    out, last = [], 0
    for a, b, kind, _ in spans_of(text):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    line = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    scores = F.transform("spans", lambda x: F.round(x["score"], 2).cast("string"))
    return found.select("doc_id", *map(number, BASE), "base_sha256", F.array_join(line, ",").alias("spans"), F.array_join(scores, ",").alias("scores"))
