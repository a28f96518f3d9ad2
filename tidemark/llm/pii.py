r"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Base kinds (all found, leftmost and non-overlapping within a kind, whatever their score): email, ip, card, phone. Added
kinds: iban (mod-97), ssn (issued ranges) and secret (a long token behind a name such as password); these are reported
where their score reaches ``least``. Scores start at a value for the kind, rise with a passed checksum and with words
near the span that speak for it, and fall with words that speak against it.

All patterns take time in proportion to the text, also for long runs of one character: an address is found from its @,
a number from the start of its run of digits.

Cases: null counts as empty; a text without spans gets an empty array; spans are code points, the end exclusive; spans
of different kinds may overlap, and masking then covers their union; equal rows get equal results; other columns pass
through, except those named like a result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)[\"']? {0,3}[=:] {0,3}[\"']?([A-Za-z0-9_/+=.-]{12,}+)")
#: Score of a match by kind, before context.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "secret": 0.8}
SPEAKS_FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "bic"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("login", "credential", "auth", "key"),
}
SPEAKS_AGAINST = ("order", "invoice", "isbn", "version", "part", "serial", "example", "test")
CONTEXT_CHARS = 40
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    value = 0
    for c in code[4:] + code[:4]:
        n = int(c, 36)
        value = (value * (100 if n > 9 else 10) + n) % 97
    return value == 1


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def octets(text: str) -> bool:
    return all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if (first := DIGIT.search(text)) is None:
        return out
    low = first.start()
    out += [(*m.span(), "ip") for m in IP.finditer(text, low) if octets(m[0])]
    for m in CARD.finditer(text, low):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text, max(0, low - 1)):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return out


def added_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if DIGIT.search(text):
        out += [(*m.span(), "iban") for m in IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
        out += [(*m.span(), "ssn") for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0] < "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    return out + [(*m.span(1), "secret") for m in SECRET.finditer(text)]


def score(text: str, start: int, end: int, kind: str) -> float:
    near = set(WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()))
    value = START[kind] + 0.25 * any(w in near for w in SPEAKS_FOR[kind]) - 0.25 * any(w in near for w in SPEAKS_AGAINST)
    return round(min(1.0, max(0.0, value)), 6)


def find(text: str | None, least: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then by kind as listed."""
    text = text or ""
    found = [(a, b, k, score(text, a, b, k)) for a, b, k in base_spans(text)]
    found += [x for a, b, k in added_spans(text) if (x := (a, b, k, score(text, a, b, k)))[3] >= least]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def mask(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with each covered stretch replaced by the name of the kind that starts it."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind, _ = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, text_col: str = "text", least: float = 0.5, masked: bool = False) -> DataFrame:
    """``docs`` with spans (kind, start, end, score); with ``masked``, ``text_col`` holds the masked text."""
    fields = [T.StructField("spans", SPANS)] + [T.StructField(text_col, T.StringType())] * masked

    def run(texts):
        found = [find(t, least) for t in texts]
        columns = [[[{"kind": k, "start": a, "end": b, "score": s} for a, b, k, s in spans] for spans in found]]
        if masked:
            columns.append([t if t is None else mask(t, spans) for t, spans in zip(texts, found, strict=True)])
        return columns

    return map_texts(docs, text_col, run, fields, docs.columns)


def of_kind(kind: str):
    """A function of a span: the kind if it is that one, else null."""
    return lambda span: F.when(span["kind"] == kind, span["kind"])


def listed(spans, only_base: bool = False):
    """kind:start:end of the spans, comma-joined."""
    some = F.filter(spans, lambda s: s["kind"].isin(*BASE)) if only_base else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
