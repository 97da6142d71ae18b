"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Four kinds are found by a fixed base rule (email, ip, card, phone). The method adds account numbers (IBAN,
confirmed by mod-97) and national phone and identity numbers, whose patterns alone prove nothing: those count
only if a word next to them says what they are. Base spans always stay; their score tells how sure they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and the patterns of the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "local_phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.(-])\(?0?[0-9]{2,4}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9-])")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words that make a kind likelier, looked for shortly before a span.
CONTEXT = {
    "email": r"e-?mail|mail|contact|write",
    "ip": r"ip|address|host|server|login",
    "card": r"card|visa|mastercard|credit|debit|payment",
    "phone": r"phone|tel|call|mobile|cell|fax",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "national_id": r"ssn|social security|national id|tax id",
    "local_phone": r"phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono",
}
NEARBY = {kind: re.compile(rf"(?<![a-z])(?:{words})(?![a-z])", re.IGNORECASE) for kind, words in CONTEXT.items()}
#: Score of a span on its pattern and checksum alone; what a context word adds; the least score that counts.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.95, "national_id": 0.35, "local_phone": 0.3}
CONTEXT_GAIN, LEAST_SCORE, CONTEXT_CHARS = 0.35, 0.5, 40


def luhn(digits: str) -> bool:
    doubled = (int(c) * 2 for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: each local part ends at an @, so the search goes from @ to @."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            after = m.end()
            yield start, after
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind and start. A match that fails its check is dropped, without a retry."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def added_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for kind, pattern in (("national_id", NATIONAL_ID), ("local_phone", LOCAL_PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def score(kind: str, text: str, start: int) -> float:
    near = NEARBY[kind].search(text, max(0, start - CONTEXT_CHARS), start)
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * (near is not None))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans with their scores, by kind as KINDS lists them, then start. Added spans don't overlap base ones."""
    if not text or not HINT.search(text):
        return []
    base = base_spans(text)
    scored = [(*s, score(s[0], text, s[1])) for s in base]
    starts, ends = [], []  # what base spans cover, as stretches that don't touch
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, start, end in added_spans(text):
        before = bisect_left(starts, end) - 1  # the last stretch that begins before the span's end
        if (s := score(kind, text, start)) >= LEAST_SCORE and not (before >= 0 and ends[before] > start):
            scored.append((kind, start, end, s))
    return sorted(scored, key=lambda x: (KINDS.index(x[0]), x[1]))


#: Every kind has an @ or two digits with at most one sign between them.
HINT = re.compile(r"@|[0-9][ ().-]*[0-9]")

SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with a column of spans added: kind, start and end in code points (end exclusive), and score.

    Whole texts are searched, very long ones in linear time; a null or empty one has no spans, given as an empty
    list. Rows are judged alone,
    so ties, repeats and empty tables need no rule; a column that already has the name ``into`` is replaced.
    """
    kept = docs.drop(into)
    columns = kept.columns
    schema = kept.withColumn(into, F.lit(None).cast(SPANS)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t.as_py())] for t in batch.column(text)]
            yield pa.record_batch([*batch.columns, pa.array(found, kind)], [*columns, into])

    return kept.mapInArrow(search, schema)
