"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

``scan`` adds one column of spans to any table with a text column.  A span has
``kind``, ``start`` and ``end`` (code points, end exclusive), ``score`` from 0
to 1 and ``base``.  Spans of the base kinds are kept whatever their score;
spans of the added kinds (``iban``, ``ssn``) are kept from ``THRESHOLD`` up, so
an account number needs its mod-97 checksum and a bare nine-digit group needs
a word such as "social security" nearby.

Each pattern is run in time proportional to the text: e-mail addresses are
grown from their ``@``, numbers start only where a run of digits starts.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; an empty table gives an empty one; a text of any length is scanned
whole, one at a time.  Spans of equal start follow their kinds in the order of
``KINDS``; spans of different kinds may overlap.  A column of the input named
like the output gives way to it; all others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = frozenset(KINDS[:4])
THRESHOLD = 0.6
REACH = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[^0-9]+")

#: Score of a confirmed span before its context is read, and words near it that raise or lower the score.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "server", "host", "ip"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security", "tax"),
}
DOUBT = ("version", "isbn", "order", "example", "test")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = int(char) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number passes ISO 7064's mod 97 with remainder 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _found(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def spans(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """The kept spans of one text, by start and then by kind in the order of ``KINDS``."""
    out = []
    for kind, start, end in _found(text or ""):
        near = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
        score = PRIOR[kind] + 0.2 * any(w in near for w in CONTEXT[kind]) - 0.2 * any(w in near for w in DOUBT)
        base = kind in BASE
        if base or score >= THRESHOLD - 1e-9:
            out.append((kind, start, end, round(min(1.0, max(0.0, score)), 3), base))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean>"


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = ("kind", "start", "end", "score", "base")
    for texts in batches:
        yield pd.Series([[dict(zip(names, s, strict=True)) for s in spans(t)] for t in texts], dtype=object)


def scan(df: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """``df`` with ``output``, the spans of each text."""
    return df.withColumn(output, F.pandas_udf(_scan, f"array<{_SPAN}>")(F.col(text)))


def redact(df: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """Texts with each span of ``output`` replaced by its kind in brackets; overlapping spans merge into the first."""
    t = F.col(text)

    def step(acc, s):
        gap = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.concat(gap, F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["text"], mark).alias("text"), s["end"].alias("at")))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    tail = lambda acc: F.concat(acc["text"], F.substring(t, acc["at"] + 1, F.length(t)))
    return df.withColumn(text, F.aggregate(output, start, step, tail))
