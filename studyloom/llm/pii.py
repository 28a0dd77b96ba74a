"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and cues that name an
account. At each anchor a local parser reads outward, decides where the item starts and ends, and
validates it. The kinds ``email``, ``ip``, ``card`` and ``phone`` are leftmost, non-overlapping matches of
fixed grammars; a match that fails its check is dropped, and the search goes on behind it. ``login`` (user info
inside a URL) and ``account`` (a cue such as ``iban`` or ``token`` with its identifier) are added to them.
Offsets are code points, ends exclusive. Work is linear in the text; a text never leaves its task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, rows

#: The base kinds in their order, and their grammars.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = "0123456789"
#: Added kinds: schemes, cues, and what may follow them.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "passport", "ssn")
LOGIN = re.compile(r"[^\s/@:?#]+(?::[^\s/@?#]*)?(?=@[A-Za-z0-9-])")
ACCOUNT = re.compile(r"(?:[ _-]?(?:no|nr|number|id))?\.?[\x20\t]{0,3}[:=#][\x20\t]{0,3}[\"']?"
                     r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b|[A-Za-z0-9](?:[_-]?[A-Za-z0-9]){5,}+)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in DIGITS:
        a.add_word(d, ("0", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """Spans (index into KINDS, start, end) in the order of kind, then start."""
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    email = ip = card = phone = login = account = 0  # where each kind's search goes on
    last_digit = -2
    for at, (what, size) in anchors.iter(text):
        if what == "0":
            fresh = at != last_digit + 1
            last_digit = at
            if at >= ip and (fresh or at == ip) and (m := IP.match(text, at)):
                ip = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
                    found[1].append((at, ip))
            if at >= card and (m := CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found[2].append((at, card))
        elif what == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                found[0].append((start, email))
        elif what == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found[3].append((at, phone))
        elif what == "scheme":
            if at + 1 >= login and (m := LOGIN.match(text, at + 1)):
                login = m.end()
                found[4].append((at + 1, login))
        else:
            start = at + 1 - size
            if at + 1 >= account and not (start and text[start - 1].isalnum()) and (m := ACCOUNT.match(text, at + 1)):
                account = m.end()
                if sum(c in DIGITS for c in m[1]) >= 4:
                    found[5].append((m.start(1), account))
    return [(k, s, e) for k, spans in enumerate(found) for s, e in spans]


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first, then longest."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            at = -end
        elif -end > at:  # a span that reaches beyond the one before goes with it
            at = -end
    return "".join([*out, text[at:]])


def describe(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: its id, a count per kind, spans as an array of (kind, start, end), and, if asked, the masked text.

    Null text counts as empty and has no spans. Repeated rows are treated one by one; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                        ("span_text", pa.string()), ("base_sha256", pa.string()), ("masked", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for some in rows(batches):
            cols: list[list] = [[] for _ in schema]
            for r in some:
                body = r["text"] or ""
                spans = find_spans(body, anchors)
                base = describe([s for s in spans if s[0] < len(BASE_KINDS)])
                values = (r["doc_id"], [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans], describe(spans), hashlib.sha256(base.encode()).hexdigest(),
                          (None if r["text"] is None else masked(body, spans)) if with_text else None)
                for c, v in zip(cols, values):
                    c.append(v)
            yield batch(schema, cols)

    out = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        find, "doc_id long, spans array<struct<kind string, start long, end long>>, span_text string, base_sha256 string, masked string")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select("doc_id", *counts, "base_sha256", "spans", "span_text", *(["masked"] if with_text else []))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span in the text replaced by its kind, as :func:`masked` does; other columns and null texts stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            texts = [t if t is None else masked(t, find_spans(t, anchors)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
