"""Spans against plain regular expressions."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.llm import pii
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain(text):
    return [(k, m.start(), m.end()) for k, (_, rx, ok) in enumerate(RULES) for m in re.finditer(rx, text) if ok(m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1204.@+- ()Z_,", max_size=60))
def test_base_spans_equal_plain_expressions(text):
    assert [s for s in pii.find_spans(text, ANCHORS) if s[0] < 4] == plain(text)


ANCHORS = pii.automaton()


def test_digits_in_rows():
    for text in ["1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "+1 (555) 010-0000 x", "0000000000.1.1.1", "9" * 5000 + ".1.1.1", "a@b@c.d.e@f.g", "x@y..z", "1" * 19 + "." + "1" * 16]:
        if len(text) < 4000:
            assert [s for s in pii.find_spans(text, ANCHORS) if s[0] < 4] == plain(text), text


def test_added_kinds_and_mask():
    text = 'see https://bob:pw@host.example/x and token = "1eb9c654e721" or IBAN: DE89 3704 0044 0532 0130 00, mail a.b@c.org'
    spans = pii.find_spans(text, ANCHORS)
    got = [(pii.KINDS[k], text[s:e]) for k, s, e in spans]
    assert ("login", "bob:pw") in got and ("account", "1eb9c654e721") in got and ("account", "DE89 3704 0044 0532 0130 00") in got and ("email", "a.b@c.org") in got
    out = pii.masked(text, spans)
    assert "pw" not in out and "1eb9" not in out and "DE89" not in out and out.endswith("mail <EMAIL>")
    assert pii.find_spans("the accountant took 5 minutes; a token of thanks", ANCHORS) == []


def test_rows(spark, texts):
    rows = list(enumerate(texts)) + [(None, "me@x.org"), (3, "me@x.org"), (3, "me@x.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_email")
    got = pii.personal_data(df, with_text=True).collect()
    assert len(got) == len(rows) and sum(r.n_email for r in got) == 3 and {r.masked for r in got if r.n_email} == {"<EMAIL>"}
    assert pii.personal_data(df.where("false")).collect() == []


def test_query(spark, duck):
    got = {r.doc_id: r for r in QUERIES["op1_personal_data"](spark, SF).collect()}
    for doc_id, text in duck.execute("select doc_id, text from documents").fetchall():
        spans = plain(text or "")
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        r = got.pop(doc_id)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
    assert not got


def test_long_identifiers_are_masked_to_their_end():
    anchors = pii.automaton()
    for token in ("ab12" * 100, "x" * 200 + "1234", "a1-" * 5000 + "b2"):
        text = f"say token: {token} and go"
        assert pii.find_spans(text, anchors)[-1:] == [(pii.KINDS.index("account"), 11, 11 + len(token))]
        assert pii.masked(text, [(pii.KINDS.index("account"), 11, 11 + len(token))]) == "say token: <ACCOUNT> and go"
