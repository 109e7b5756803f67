"""Decontamination and personal data against plain versions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tests.llm.helpers import LOWERED, awkward, documents, folder, prose
from trailmetrics.llm.decontaminate import clean_documents, op10_winnowing
from trailmetrics.llm.pii import KINDS, estimate, op3_weak_supervision, redact_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWERED))


def contaminated(rows, items):
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        found = words(text)
        n = min(10, len(found))
        for i in range(len(found) - n + 1 if found else 0):
            windows.setdefault(tuple(found[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in rows:
        found, hit, ids = words(text), set(), set()
        for n in {len(window) for window in windows}:
            for i in range(len(found) - n + 1):
                if (own := windows.get(tuple(found[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= {str(x) for x in own if x is not None}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(found), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def test_hits_equal_a_plain_search_also_for_short_items(spark):
    base = prose(1, 120).split()
    items = [
        (1, " ".join(base[40:75])), (10, " ".join(base[100:110])), (2, "One two"), (2, None), (3, ""), (None, " ".join(base[5:17])),
        (4, prose(99, 20)), (7, "Grüße"), (8, " ".join(prose(2, 6_000).split()[5_000:5_012])),
    ]
    given = awkward()
    path = folder(spark, documents=documents(spark, given), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    found = op10_winnowing(spark, path)
    assert sorted(map(tuple, found.collect()), key=repr) == contaminated(given, items)


def test_without_items_or_documents_nothing_is_hit(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    path = folder(spark, documents=documents(spark, [(1, "a b c")]), benchmark=none)
    assert [row.contaminated for row in op10_winnowing(spark, path).collect()] == [False]
    path = folder(spark, documents=documents(spark, []), benchmark=none)
    assert op10_winnowing(spark, path).count() == 0


def test_clean_documents_keep_all_columns(spark):
    docs = documents(spark, awkward())
    items = spark.createDataFrame([(1, prose(1, 120))], "item_id long, text string")
    left = clean_documents(docs, items)
    assert left.columns == docs.columns
    assert {row.doc_id for row in left.collect()} == {5, 6, 7, 8, 11, 14, 15, 16, 17, None}
    assert left.where("doc_id IS NULL").count() == 1


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


PERSONAL = [
    (1, "write to a.b@mail.example.com or x@y.zz_q@w.org, a@b.c.@d.e.f"), (2, None), (3, "😀 from 10.0.0.255 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"),
    (4, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 12"), (5, "call +1 (213) 555-5044 or +49.30.1234567-, +1 2"),
    (6, "password=79f3040bf02a602472 token = \"7ccfcfa5a2be58db3a9b34252\""), (7, "é" * 50 + " a@b.co " * 700), (7, ""),
    (8, "1" * 30_000), (9, "1 " * 20_000), (10, "a" * 40_000 + "@"), (None, "a+b@c.de"), (11, "+" + "1-" * 9_000),
]


def test_base_spans_equal_the_plain_patterns_and_stay(spark):
    path = folder(spark, documents=documents(spark, PERSONAL))
    found = {(row.doc_id, row.spans): row for row in op3_weak_supervision(spark, path).collect()}
    assert len(found) == len(PERSONAL)
    for doc_id, text in PERSONAL:
        expected = [f"{KINDS[kind]}:{start}:{end}" for start, kind, end in base_spans(text or "")]
        digest = hashlib.sha256(",".join(expected).encode()).hexdigest()
        row = next(row for row in found.values() if row.doc_id == doc_id and row.base_sha256 == digest)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x.startswith(k + ":") for x in expected) for k in KINDS[:4]]
        assert set(expected) <= set(row.spans.split(",")) | {""}
    assert op3_weak_supervision(spark, folder(spark, documents=documents(spark, []))).count() == 0


def test_redaction_replaces_spans_and_nothing_else(spark):
    docs = documents(spark, [(1, "mail a@b.com, ok"), (2, None), (3, "plain text"), (4, "ip 1.2.3.4"), (5, "")])
    out = redact_documents(docs)
    assert out.columns == docs.columns
    assert {row.doc_id: row.text for row in out.collect()} == {1: "mail [EMAIL], ok", 2: None, 3: "plain text", 4: "ip [IP]", 5: ""}
    assert out.where(F.col("n_chars") != F.coalesce(F.length("text"), F.lit(0))).count() == 0


def test_estimated_reliability_follows_the_labelers():
    agree = {"kind": 0, "gazetteer": 0, "context": 0, "size": 1, "digits": 1}
    patterns = [
        agree | {"form": 1, "alone": 1, "n": 900}, agree | {"form": -1, "alone": -1, "n": 900},
        agree | {"form": 1, "alone": -1, "n": 30}, agree | {"form": -1, "alone": 1, "n": 30},
    ]
    belief, votes = estimate(patterns)
    assert belief[0] > 0.9 > 0.1 > belief[1]
    assert votes["form", 1][1] > 0.9 and votes["form", 0][-1] > 0.9
