"""Personal data: written forms against plain patterns, and contexts that discover."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from trialframe.llm import pii
from trialframe.llm.catalog import QUERIES, table

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def slow(text):
    return [(k, m.start(), m.end()) for k, p in FORMS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a.@b-+1 2(0)5é\n"), max_size=60))
def test_written_forms(text):
    assert pii.base_spans(text) == slow(text)


@pytest.mark.parametrize("text", [
    None, "", "x@y.z@q.w.e", "a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (988) 555-2485, +44.20.7946.0958", "é" * 3 + "me@x.org", "1" * 50_000, "a" * 50_000 + "@", "@" * 5000, "+1" + "(" * 20_000])
def test_cases(text):
    assert pii.base_spans(text) == slow(text)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    got = QUERIES["op7_contextual_pii"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = slow(texts[r.doc_id])
        written = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]
        assert set(written) <= set(r.spans.split(","))


def test_contexts_discover_and_edges(spark):
    rows = [(i, f"Item {i}: please call us +1 202 555 {1000 + i} today for more.") for i in range(30)]
    rows += [(100, "Hello, please call us 0202-555-7788 today for more."), (101, "They sold 40,000 units in 2019 today."), (102, None), (103, ""),
             (None, "please call us 0202-555-9999 today for"), (100, "Hello, please call us 0202-555-7788 today for more."), (104, "x " * 100_000 + "please call us 0303-123456 today")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, kind int")
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.spans for r in got if r.doc_id == 100) == ["phone:22:35"] * 2
    assert [r.spans for r in got if r.doc_id is None] == ["phone:15:28"]
    assert [r.spans for r in got if r.doc_id == 104] == ["phone:200015:200026"]
    assert all(r.spans == "" for r in got if r.doc_id in (101, 102, 103))
    assert all(r.n_phone == 1 and r.spans.startswith("phone:") for r in got if r.doc_id is not None and r.doc_id < 30)
    assert pii.report(df.limit(0)).count() == 0


def test_candidates_of_each_form():
    offered = lambda text: [(f, text[a:b]) for f, a, b in pii._offered(text, pii.base_spans(text))]
    assert offered("call 0202 555 7788 or (0303) 12-34.5 now") == [("number", "0202 555 7788"), ("number", "(0303) 12-34.5")]
    assert offered("id ab-12x4 of 555 12ab") == [("address", "ab-12x4"), ("token", "12ab"), ("number", "555")]
    assert offered("jane.doe (at) mail dot org, joe at work dot com, me@localhost and look at me") == [
        ("address", "jane.doe (at) mail dot org"), ("address", "joe at work dot com"), ("address", "me@localhost")]
    assert offered("me@x.org 4111 1111 1111 1111 plain words, 1") == [("number", "1")]
    for text in ("1" * 50_000, "a." * 50_000, "1 " * 50_000, "a@" * 30_000, "(" * 50_000, "é1" * 30_000, "a at " * 20_000, "+ " * 50_000):
        spans = sorted((a, b) for _, a, b in [*pii._offered(text, []), *()])
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_contexts_are_whole_words():
    for gap in (1, 300):
        text = "aaa " + "b" * 500 + " " * gap + "7788" + " " * gap + "c" * 500 + " d"
        found = pii._Words(text).contexts(text.index("7"), text.index("7") + 4)
        assert found == ["2 aaa " + "b" * 40, "1 " + "b" * 40 + " * " + "c" * 40]
    text = "see tel:7788, then"
    assert pii._Words(text).contexts(8, 12) == ["2 see tel:", "1 tel: * ,"]


def test_spaced_numbers_and_addresses_without_digits(spark):
    rows = [(i, f"Item {i}: please call us +1 202 555 {1000 + i} today or mail to user{i}@x{i}.org for more.") for i in range(30)]
    rows += [(100, "So please call us 0202 555 7788 today."), (101, "or mail to jane.doe (at) mail dot org for more"),
             (102, "or mail to 0202 555 7788 for"), (103, "please call us well-known today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got[100] == "phone:18:31" and got[101] == "email:11:37" and got[102] == got[103] == ""


def test_pattern_scores_fall_with_what_they_also_hold(spark):
    found = [(i, "p", "phone", f"n{i}") for i in range(10)] + [(i, "q", "phone", f"n{i}") for i in range(10)] + [(50 + i, "q", None, f"u{i}") for i in range(10)]
    found += [(i, "mixed", "phone" if i % 2 else "card", f"m{i}") for i in range(10)]
    df = spark.createDataFrame(found, "doc long, pattern string, kind string, instance string")
    assert [(r.pattern, r.kind) for r in pii.confident_patterns(df).collect()] == [("p", "phone")]
    # an instance that a confident pattern reaches counts for the others it stands in
    more = spark.createDataFrame([(200, "p", None, "u0"), (201, "r", None, "u0")] + [(i, "r", "phone", f"n{i}") for i in range(10)], df.schema)
    assert sorted(r.pattern for r in pii.confident_patterns(df.union(more)).collect()) == ["p", "r"]
