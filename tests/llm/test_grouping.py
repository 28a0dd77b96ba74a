"""Pieces against the tokenizer, packings against their bounds, crossover against its rules."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from studyloom.llm import grouping as G
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sound(p, sizes, capacity):
    """Every item in one bin, none over the capacity, free space as said."""
    assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
    for j, (b, f) in enumerate(zip(p.bins, p.free)):
        assert f == capacity - sum(sizes[i] for i in b) >= 0 and all(p.where[i] == j for i in b)
    assert p.worth(capacity)[0] == sum(1 for b in p.bins if b)


def test_crossover_takes_whole_bins_and_loses_nothing():
    rng = random.Random(2)
    taken = 0
    for _ in range(200):
        capacity = rng.choice([10, 100, 1024])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(2, 80))]
        a, b = (G.seeded(sizes, capacity, n, rng) for n in (0, .3))
        before = [*b.bins]
        child = G.crossover(a, b, sizes, capacity, rng)
        assert b.bins == before
        if child is None:
            assert {tuple(sorted(x)) for x in a.bins} == {tuple(sorted(x)) for x in b.bins}
            continue
        sound(child, sizes, capacity)
        own = {tuple(sorted(x)) for x in b.bins}
        taken += any(tuple(sorted(x)) in {tuple(sorted(y)) for y in a.bins} - own for x in child.bins)
        back = G.Packing.of(child.labels(), sizes, capacity)
        sound(back, sizes, capacity)
        assert back.worth(capacity) == child.worth(capacity)
    assert taken > 100


def fewest(sizes, capacity):
    """By trying all ways to add each item to a bin."""
    states = {()}
    for s in sizes:
        states = {tuple(sorted([*st[:i], st[i] + s, *st[i + 1:]])) for st in states for i in range(len(st)) if st[i] + s <= capacity} | {tuple(sorted([*st, s])) for st in states}
    return min(map(len, states), default=0)


def test_bound_and_evolution():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        best = fewest(sizes, capacity)
        assert math.ceil(sum(sizes) / capacity) <= G.lower_bound(sizes, capacity) <= best
        people = G.evolve([G.seeded(sizes, capacity, .3 * i, rng) for i in range(3)], sizes, capacity, 60, best, rng)
        for p in people:
            sound(p, sizes, capacity)
        assert people[0].worth(capacity)[0] <= best + 1
    assert G.lower_bound([60] * 10, 100) == 10 and G.lower_bound([60, 45, 45, 45], 100) == 3 and G.lower_bound([], 100) == 0
    # bins planted full: best fit alone misses some, evolution finds them
    sizes = []
    for _ in range(60):
        cut = sorted(rng.sample(range(1, 100), 3))
        sizes += [b - a for a, b in itertools.pairwise([0, *cut, 100])]
    plain = G.seeded(sizes, 100, 0, rng).worth(100)[0]
    assert plain > 60
    best = G.evolve([G.seeded(sizes, 100, .03 * i, rng) for i in range(4)], sizes, 100, 3000, 60, rng)[0]
    sound(best, sizes, 100)
    assert best.worth(100)[0] < plain


def expected(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(docs, rows, ids=False):
    """docs: id and text of each row. Returns the number of sequences and of ids."""
    of, seqs = {}, {}
    for p in rows:
        of.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    want = {d: expected(t) for d, t in docs.items()}
    assert set(of) == set(docs)
    for d, w in want.items():
        at = 0
        for i, p in enumerate(sorted(of[d], key=lambda p: p.piece)):
            part = np.array(w[p.start:p.start + p.length], "<u4").tobytes()
            assert (p.piece, p.start, p.ids_crc32) == (i, at, zlib.crc32(part)) and (i == 0 or p.length == 1024)
            assert not ids or p.ids == part
            at += p.length
        assert at == len(w) and len(of[d]) == -(-len(w) // 1024)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
    return len(seqs), sum(map(len, want.values()))


def test_rows(spark, texts):
    words = ["plain", "It's  done", "<|endoftext|>", "naïve space   x", "a" * 300, "tail \n\n ", " lead", "a \nb  c\x1c d", "w " * 1023, "w " * 2046]
    docs = dict(enumerate([*texts, *words]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "0 as key", "1 as sequence_id", "2 as `group`")
    check(docs, G.best_fit_pack(df.repartition(3), group_items=4, islands=2, epochs=2, generations=10).collect(), ids=True)
    assert G.best_fit_pack(df.where("false")).collect() == []
    twice = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string")
    got = G.best_fit_pack(twice, with_ids=False).collect()
    assert len(got) == 3 and {r.sequence_id for r in got} == {got[0].sequence_id} and sorted(r.offset for r in got) in ([0, 3, 4], [0, 1, 4], [0, 3, 6])


def test_query_is_near_the_bound(spark, duck):
    docs = dict(duck.execute("select doc_id, text from documents").fetchall())
    first = QUERIES["op13_best_fit"](spark, SF).collect()
    used, total = check(docs, first)
    sizes = [len(expected(t)) % 1024 for t in docs.values()]
    least = sum(len(expected(t)) // 1024 for t in docs.values()) + G.lower_bound([s for s in sizes if s], 1024)
    assert total / 1024 <= least <= used <= least + 1
    again = QUERIES["op13_best_fit"](spark, SF).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)
