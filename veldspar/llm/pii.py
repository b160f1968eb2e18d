"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (email, ip, card, phone) are always reported when their expression matches and their
validator holds. Added kinds (iban, local_phone, ssn, secret, account) are reported when the score reaches
``min_score`` and the span overlaps no base span. A key or password (secret) and an account number look like
any other run of characters, so only the words near by lift them over it. Each scan is linear in the text: nothing here
backtracks over more than one match, so a text of many megabytes takes time in proportion.

Defined results: null and empty texts have no spans; texts of any length are read whole; ids may be null or
repeat, each input row gives one output row; an empty table gives an empty one; extra input columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "ssn", "secret", "account")
KINDS = BASE + ADDED

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]{7,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9.-])[0-9]{8,17}(?![A-Za-z0-9-]|\.[0-9])")

#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.55, "ssn": 0.4, "secret": 0.35, "account": 0.35}
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "appel"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "api key", "access key", "private key", "bearer", "credential"),
    "account": ("account", "acct", "konto", "compte", "cuenta", "routing"),
}
AGAINST = {"ip": ("version", "release", "section"), "card": ("isbn", "order", "serial"), "ssn": ("order", "part", "serial"), "account": ("order", "part", "serial", "isbn")}
STEP, WINDOW = 0.2, 48

ENTITY = "array<struct<kind:string,start:int,end:int,score:double,base:boolean,value:string>>"
_ENTITY = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_()), ("value", pa.string())]))


def luhn(digits: str) -> bool:
    """Whether the check digit of a digit string is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number without spaces, country code first, leaves remainder 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one @; its local part is all that precedes it back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts, places, at = m[0].split("."), [], m.start()
        for p in parts:
            places.append(at)
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += 1
                continue
            small = [p.lstrip("0") for p in four]
            if all(len(p) <= 3 and (not p or int(p) <= 255) for p in small):
                yield places[i], places[i + 3] + len(parts[i + 3])
            i += 4


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in LOCAL_PHONE.finditer(text))


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Runs that mix letters with four digits or more."""
    for m in SECRET.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if digits >= 4 and any(c.isalpha() for c in m[0]):
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in ACCOUNT.finditer(text))


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "local_phone": local_phones, "ssn": ssns, "secret": secrets, "account": accounts}


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()
    value = PRIOR[kind]
    value += STEP * any(w in near for w in CONTEXT[kind])
    value -= STEP * any(w in near for w in AGAINST.get(kind, ()))
    return min(1.0, max(0.0, round(value, 3)))


def find(text: str, min_score: float = 0.5) -> list[dict]:
    """The spans of one text, by kind as in KINDS and then by start; code points, end exclusive."""
    out: list[dict] = []
    digit = re.search("[0-9]", text) is not None
    for kind in KINDS:
        if not digit and kind != "email":
            continue
        base = kind in BASE
        taken = [(e["start"], e["end"]) for e in out] if not base else []
        for s, e in FINDERS[kind](text):
            value = score(kind, text, s, e)
            if base or value >= min_score and not any(s < b and a < e for a, b in taken):
                out.append({"kind": kind, "start": s, "end": e, "score": value, "base": base, "value": text[s:e]})
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """One row per document: its id as ``doc_id`` and ``entities``, see ENTITY."""

    def run(batches):
        enter("pii")
        for b in batches:
            found = [find(t or "", min_score) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ENTITY)], ["doc_id", "entities"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, entities {ENTITY}")
