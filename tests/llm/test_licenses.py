"""Matches against plain containment."""

import math
import random

from studyloom.llm import licenses as L
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_bands_follow_the_bound():
    for s in (0.05, 0.3, 0.9, 1.0):
        b = L.bands_needed(s, 1e-4)
        assert (1 - s) ** b <= 1e-4 and (b == 1 or (1 - s) ** (b - 1) > 1e-4)
    assert all(len(g.seeds) >= 1 and g.window >= g.step for g in L.groups_of(L.TEMPLATES))


def test_templates_are_found_anywhere():
    rng, groups = random.Random(1), L.groups_of(L.TEMPLATES)
    vocab = [f"v{i}" for i in range(500)]
    for name, text in L.TEMPLATES.items():
        for _ in range(20):
            words = rng.choices(vocab, k=rng.randint(0, 300))
            at = rng.randint(0, len(words))
            assert name in L.scan([None, " ".join([*words[:at], text.upper() if rng.random() < 0.5 else text, *words[at:]]), "x"], groups)[1], name
    assert L.scan([" ".join(rng.choices(vocab, k=5000))], groups) == [{}]


def test_changed_templates():
    """Three quarters of the 5-grams in a row are enough, less are not."""
    groups = L.groups_of(L.TEMPLATES)
    words = L.TEMPLATES["bsd"].split()
    grams = len(words) - 4
    need = math.ceil(0.75 * grams) + 4
    assert L.scan([" ".join(["x"] * 30 + words[:need] + ["y"] * 30)], groups)[0]["bsd"][0] >= 0.75
    assert "bsd" not in L.scan([" ".join(["x"] * 30 + words[:need - 1] + ["y"] * 30)], groups)[0]


def test_rows(spark, texts):
    rows = list(enumerate(texts)) + [(50, "Released under the MIT License."), (50, "released under THE mit license"), (None, "x\nAll rights reserved.\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as license", "1 as word")
    assert sorted((str(r.doc_id), r.license) for r in L.license_matches(df).collect()) == [("50", "mit-short"), ("50", "mit-short"), ("None", "all-rights-reserved")]
    assert L.license_matches(df.where("false")).collect() == []


def test_query(spark, duck):
    got = {(r.doc_id, r.license) for r in QUERIES["op3_licenses"](spark, SF).collect()}
    want = set()
    for i, text in duck.execute("select doc_id, text from documents").fetchall():
        w = L.words_of(text)
        for name, t in L.TEMPLATES.items():
            v = L.words_of(t)
            n = min(5, len(v))
            grams, there = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)}, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            if len(grams & there) >= 0.75 * len(grams):
                want.add((i, name))
    assert got == want and want
