"""Personal data and secrets: patterns propose spans, checksums confirm them, nearby words adjust their score.

The base kinds are email, ip, card and phone: leftmost non-overlapping matches of their patterns, dropped without
a retry where the check fails (parts of an ip over 255, 12 to 19 digits passing Luhn, 9 to 15 digits of a phone).
The method adds iban (as many characters as the country has, then mod-97), national_id (three, two and four digits, no
number that is never issued), which only nearby words can confirm, and secret: keys with a known prefix, private-key
headers, signed tokens whose header is JSON, and values given to a name as token or password, if they are long, mixed
and have digits, or are short and mixed of three kinds of characters. Base spans stay whatever their score.

Cases
    Null text reads as empty: no spans. Texts of any length are searched whole; every pattern is linear, since a
    failed attempt at the start of a run is not repeated within the run. Rows are independent, so repeated rows and
    null ids give a result each; an empty table gives none; other columns are ignored. Offsets count code points.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._store import bounded_batches

# Kinds in their order, patterns, and words that speak for or against a kind.
KINDS = ["email", "ip", "card", "phone", "iban", "national_id", "secret"]
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_KEY_HEADER = re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
_GIVEN = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?token|client[_-]?secret|secret[_-]?key)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([a-z0-9+/_.~=&!#$%^*@-]{8,})")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    **dict.fromkeys(["NO"], 15), **dict.fromkeys(["BE", "BI"], 16), **dict.fromkeys(["DK", "FI", "FK", "FO", "GL", "NL", "SD"], 18), **dict.fromkeys(["MK", "SI"], 19),
    **dict.fromkeys(["AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"], 20), **dict.fromkeys(["CH", "HR", "LI", "LV"], 21), **dict.fromkeys(["BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"], 22),
    **dict.fromkeys(["AE", "GI", "IL", "IQ", "OM", "SO", "TL"], 23), **dict.fromkeys(["AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"], 24), **dict.fromkeys(["LY", "PT", "ST"], 25), **dict.fromkeys(["IS", "TR"], 26),
    **dict.fromkeys(["BF", "BJ", "CI", "CM", "CV", "DJ", "DZ", "FR", "GR", "IT", "KM", "MC", "MG", "ML", "MR", "MZ", "SM", "SN", "TD", "TG"], 27), **dict.fromkeys(["AL", "AZ", "BY", "CY", "DO", "GT", "HN", "HU", "LB", "MA", "NE", "NI", "PL", "SV"], 28),
    **dict.fromkeys(["BR", "EG", "PS", "QA", "UA"], 29), **dict.fromkeys(["JO", "KW", "MU", "YE"], 30), **dict.fromkeys(["MT", "SC"], 31), **dict.fromkeys(["LC"], 32), **dict.fromkeys(["RU"], 33),
}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile("[0-9]")
CONTEXT = {
    "email": (0.9, ["mail", "contact", "write to", "courriel", "correo"], ["noreply"]),
    "ip": (0.6, ["ip", "host", "server", "address", "login"], ["version", "release"]),
    "card": (0.8, ["card", "visa", "mastercard", "credit", "carte", "tarjeta", "karte"], ["isbn", "tracking"]),
    "phone": (0.7, ["phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"], ["order"]),
    "iban": (0.9, ["iban", "account", "bank", "konto", "compte", "cuenta"], []),
    "secret": (0.8, ["key", "token", "secret", "auth", "login", "password"], ["example", "placeholder"]),
    "national_id": (0.3, ["ssn", "social security", "national id", "tax id"], ["part", "serial"]),
}
#: Least length and bits a character of a value given to a name; shorter ones count if they mix letters, digits and more.
VALUE_LENGTH, VALUE_BITS = 16, 3.0
#: Code points on either side in which context words count, what one is worth, and the score that an added kind needs.
WINDOW, WORTH, THRESHOLD = 40, 0.3, 0.5


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_end(text: str, start: int) -> int | None:
    """The end of the IBAN that begins at ``start``: as many characters as its country has, with single spaces between them, and no word goes on."""
    left, at, n = IBAN_LENGTHS.get(text[start : start + 2], 0), start, len(text)
    if not left:
        return None
    while left and at < n:
        if "0" <= text[at] <= "9" or "A" <= text[at] <= "Z":
            left -= 1
        elif text[at] != " " or text[at - 1] == " ":
            return None
        at += 1
    return None if left or (at < n and text[at].isascii() and text[at].isalnum()) else at


def _issued(number: str) -> bool:
    """Whether a national number of three, two and four digits is of a kind that is issued."""
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _is_value(value: str) -> bool:
    """Whether a value given to a name is no word: long, mixed and with a digit, or short with characters of three kinds."""
    kinds = [any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())]
    if len(value) < VALUE_LENGTH:
        return sum(kinds) >= 3
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return kinds[2] and sum(kinds) >= 2 and bits >= VALUE_BITS


def _json_header(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Spans of secrets from left to right; of overlapping ones the first, then the longest."""
    found = []
    if "PRIVATE KEY" in text:
        found += [m.span() for m in _KEY_HEADER.finditer(text)]
    if "eyJ" in text:
        found += [m.span() for m in _SIGNED.finditer(text) if _json_header(m[1])]
    found += [m.span() for m in _SECRET.finditer(text)]
    if "=" in text or ":" in text:
        # Marks at the end are the sentence's.
        found += [(m.start(1), m.start(1) + len(value)) for m in _GIVEN.finditer(text) if _is_value(value := m[1].rstrip(".!"))]
    done = -1
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= done:
            done = end
            yield start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", end)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for start, end in _secrets(text):
        yield "secret", start, end
    if _DIGITS.search(text) is None:
        return
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        end = _iban_end(text, m.start())
        if end is not None and mod97(text[m.start() : end].replace(" ", "")):
            yield "iban", m.start(), end
    for m in _NATIONAL.finditer(text):
        if _issued(m[0]):
            yield "national_id", *m.span()


def find_spans(text: str) -> list[Span]:
    """All confirmed spans by start, then kind as listed."""
    out = []
    for kind, start, end in _proposed(text):
        score, for_, against = CONTEXT[kind]
        near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
        score += WORTH * any(re.search(rf"\b{re.escape(w)}", near) for w in for_) - WORTH * any(re.search(rf"\b{re.escape(w)}", near) for w in against)
        score = min(1.0, max(0.0, score))
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(start, end, kind, round(score, 2)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "spans array<struct<start:int,end:int,kind:string,score:double>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (start, end, kind, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            found = [[s._asdict() for s in find_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], ["doc_id", "text", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {SPANS}")


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    pieces = F.expr(
        "aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> if(s.start < a.at, a, named_struct('at', s.end, 'out', concat(a.out, substr(text, a.at + 1, s.start - a.at), '[', s.kind, ']'))), a -> concat(a.out, substr(text, a.at + 1)))"
    )
    return with_spans(docs).select("doc_id", F.when(F.size("spans") == 0, F.coalesce("text", F.lit(""))).otherwise(pieces).alias("text"))


DIGEST = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, scores string"


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                spans = find_spans(t.as_py() or "")
                base = [s for s in spans if s.kind in BASE]
                joined = [",".join(f"{s.kind}:{s.start}:{s.end}" for s in x) for x in (base, spans)]
                rows.append((*[sum(s.kind == k for s in base) for k in BASE], hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], len(spans) - len(base), len(spans), ",".join(f"{s.score:g}" for s in spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
            columns = [*zip(*rows)] or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *(c.split()[0] for c in DIGEST.split(", "))])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + DIGEST)
