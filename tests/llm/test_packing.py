"""Pieces against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from studyloom.llm import packing
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, pieces, ids=None):
    """Every id in one piece; sequences gapless and within capacity. Returns the padded share."""
    of, seqs = {}, {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert set(of) == set(docs)
    for d, text in docs.items():
        want, at = expected(text), 0
        for p in sorted(of[d], key=lambda p: p.start):
            part = np.array(want[p.start:p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want) and zlib.crc32(part) == p.ids_crc32
            assert ids is None or p.ids == part
            at += p.length
        assert at == len(want)
    used = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        used += at
    return 1 - used / (2048 * len(seqs))


def test_difference_splits_whole():
    random.seed(3)
    for _ in range(30):
        sizes = [random.randint(1, 900) for _ in range(random.randint(0, 60))]
        k = random.randint(1, 9)
        parts = packing.difference(sizes, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))
        assert max((sum(sizes[i] for i in p) for p in packing.windows(sizes, 2048)), default=0) <= 2048
    assert sorted(map(sum, ([ [8, 7, 6, 5, 4][i] for i in p] for p in packing.difference([8, 7, 6, 5, 4], 2)))) == [14, 16]
    assert packing.windows([2048, 2048, 1], 2048) and len(packing.windows([1500, 1500, 1000], 2048)) == 3


def test_rows(spark, texts):
    words = ["plain", "It's  done", "<|endoftext|>", "<|endoftext|> twice <|endoftext|>", "naïve space   x", "a" * 300, "tail \n\n "]
    docs = dict(enumerate([*texts, *words]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "0 as start", "1 as sequence_id")
    rows = packing.pack(df.repartition(2)).collect()
    check(docs, rows, ids=True)
    assert packing.pack(df.where("false")).collect() == []
    seqs = packing.sequences(packing.pack(df)).collect()
    assert all(len(s.ids) == 4 * s.length for s in seqs) and sum(s.length for s in seqs) == sum(len(expected(t)) for t in docs.values())


def test_query(spark, duck):
    docs = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert check(docs, QUERIES["op2_packing"](spark, SF).collect()) < 0.03
