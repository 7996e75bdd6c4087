"""Personal data: regular expressions propose spans, checksums confirm them, nearby words set the score.

Base kinds (email, ip, card, phone) are proposed leftmost and non-overlapping, a kind at a time; a match
that fails its check is dropped without a retry. They are always kept. Added kinds (iban, secret, ssn)
are kept where checksum and context bring their score to THRESHOLD.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm import kernels as K
from glossa.llm.runtime import lean, ship

THRESHOLD, NEAR = 0.5, 40
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a run of digits that fails from its start fails from each later one: not looking there keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{16,})")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Words that speak for a kind, and words that speak against any.
_FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"), "secret": ("key", "secret", "token", "auth"), "ssn": ("ssn", "social", "security", "tax"),
}
_AGAINST = ("example", "sample", "test", "dummy", "version")
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "secret": 0.5, "ssn": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """As the base expression finds them, but led by the @ signs, so that long texts stay linear."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0]) if len(m[0]) < 64 else ""
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, moved by words within NEAR characters."""
    around = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    s = _PRIOR[kind] + 0.25 * any(w in around for w in _FOR[kind]) - 0.15 * any(w in around for w in _AGAINST)
    return min(1.0, max(0.0, round(s, 4)))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start; code points, end exclusive."""
    found = [(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    if _DIGIT.search(text):
        more = [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
        more += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        more += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text) if _DIGIT.search(m[1])]
        more.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
        found += [(k, a, b, s) for k, a, b in more if (s := score(text, k, a, b)) >= THRESHOLD]
    return found


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def detect(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, n_email, n_ip, n_card, n_phone long, base_sha256,
    spans string, scores array<double>), a row per row.

    base_sha256: of kind:start:end of the base spans by kind, then start, comma-joined; spans: all spans,
    joined likewise, the base kinds' first; scores: one for each. Null and empty texts have none; long
    texts are read whole, in time linear in their length; repeated rows get equal results, other columns
    are not read, and an empty table gives an empty result."""
    ship(docs.sparkSession)
    d = lean(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches):
            found = [find(b.raw(i).decode()) for i in range(len(b))]
            base = [[x for x in f if x[0] in BASE] for f in found]
            counts = [pa.array([sum(x[0] == k for x in f) for f in base], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sha, pa.array([joined(f) for f in found], pa.string()), pa.array([[x[3] for x in f] for f in found], pa.list_(pa.float64()))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def redacted(text: str) -> str:
    """The text with each span (overlapping ones as one) replaced by its first kind in brackets."""
    out, last = [], 0
    merged: list[list] = []
    for k, a, b, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[last:a], f"[{k.upper()}]"]
        last = b
    return "".join([*out, text[last:]])
