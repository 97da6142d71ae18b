import hashlib
import random
import re
import time

import pytest

from tidemark.llm import pii
from tidemark.llm.queries import op6_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The base rule, with the patterns as they stand."""
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@pytest.mark.parametrize("alphabet", ["a1@.-+ ", "0123456789 -", "+1(). -2", "a@b.c_%1", "10.2 5é"])
def test_base_spans_on_noise(alphabet):
    draw = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert sum(len(plain(r.text)) for r in rows) > 20
    for r in rows:
        assert [s[:3] for s in pii.spans_of(r.text) if s[0] in pii.BASE_KINDS] == plain(r.text)


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in pii.spans_of(text)]


def test_added_kinds():
    assert kinds("konto DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GB82WEST12345698765432 and GB82WEST12345698765433") == [("iban", "GB82WEST12345698765432")]
    assert kinds("ssn: 078-05-1120") == [("national_id", "078-05-1120")]
    assert kinds("part 078-05-1120") == []
    assert kinds("call 555 123 4567 now") == [("local_phone", "555 123 4567")]
    assert kinds("lot 555 123 4567 now") == []


def test_context_raises_the_score():
    near, far = "pay by card 4111 1111 1111 1111", "here 4111 1111 1111 1111"
    assert pii.spans_of(near)[0][3] > pii.spans_of(far)[0][3]
    assert kinds("4111 1111 1111 1112") == []


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" + " " * 200_000, "1." * 100_000):
        pii.spans_of(text)


def test_code_points():
    assert pii.spans_of("é😀 a@b.cd")[0][1:3] == (3, 9)


def test_table(docs, empty):
    out = pii.find_pii(docs, into="hits")
    assert out.columns == [*(c for c in docs.columns if c != "hits"), "hits"] and out.count() == docs.count()
    assert out.where("text is null").select("hits").first()[0] == []
    assert pii.find_pii(empty).collect() == []


def test_query(spark):
    """Every column, made anew from the patterns; spans hold all base ones."""
    rows = {r.doc_id: r for r in op6_pii(spark, "/root/testdata/sf0.01").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(texts)
    for t in texts:
        base = [f"{k}:{a}:{b}" for k, a, b in plain(t.text or "")]
        row = rows[t.doc_id]
        assert [row[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s.startswith(f"{k}:") for s in base) for k in pii.BASE_KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if s.split(":")[0] in pii.BASE_KINDS] == base
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_many_spans_in_one_text_take_linear_time():
    text = "phone 555 123 4567 or a@b.example, " * 20_000
    begin = time.time()
    found = pii.spans_of(text)
    assert len(found) == 40_000 and time.time() - begin < 20


def test_added_spans_never_overlap_base_ones():
    draw = random.Random(2)
    parts = ["ssn 123-45-6789", "+1 555 123 4567", "phone 555 123 4567", "4111 1111 1111 1111", "a@123-45-6789.example", "iban DE89 3704 0044 0532 0130 00", " ", ", ", "1.2.3.4", "x"]
    for _ in range(300):
        text = "".join(draw.choices(parts, k=8))
        base = pii.base_spans(text)
        added = [s for s in pii.spans_of(text) if s[0] not in pii.BASE_KINDS]
        want = [(k, a, b) for k, a, b in pii.added_spans(text) if pii.score(k, text, a) >= pii.LEAST_SCORE and not any(x < b and a < y for _, x, y in base)]
        assert sorted(s[:3] for s in added) == sorted(want)
