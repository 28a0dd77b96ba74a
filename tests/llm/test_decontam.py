"""Leaks against plain containment."""

import random

import duckdb
import numpy as np
from check import canonical

from studyloom.llm import decontam as D
from studyloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(text, items, window):
    w = D.words_of(text)
    grams = lambda x: {tuple(x[i:i + 5]) for i in range(len(x) - 4)} or ({tuple(x)} if x else set())
    out = set()
    for i, item in items:
        q, a = (D.words_of(x) for x in D.question_and_answer(item))
        if not q:
            continue
        for s in range(0, max(1, len(w) - window // 2), window // 2):
            part = w[s:s + window]
            if len(grams(q) & grams(part)) * 100 >= 75 * len(grams(q)) and len(set(a) & set(part)) * 100 >= 75 * len(set(a)):
                out.add(i)
    return out


def test_pruning_loses_nothing():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40))) + rng.choice([".", ". ", "\n"]) + " ".join(rng.choices(vocab, k=rng.randint(0, 8)))) for i in range(60)]
    index = D.build(items, block=4, passage=64)
    hits = 0
    for _ in range(400):
        body = rng.choices(vocab, k=rng.randint(0, 150))
        words = items[rng.randrange(60)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        text = " ".join([*body[:50], *words, *body[50:]]) if rng.random() < 0.8 else " ".join(body)
        got = set()
        for part in index.passages(D.words_of(text)):
            present = np.array(sorted({index.terms[w] for w in part if w in index.terms}), np.int64)
            for i, _ in index.search(present):
                q, a = index.verify(i, part, D.hashes(part))
                if q >= 0.75 and a >= 0.75:
                    got.add(index.ids[i])
        assert got == plain(text, items, index.window)
        hits += bool(got)
    assert hits > 100


def plain_whole(text, items, window):
    """As plain, and for a question under five words also its whole item's n-grams, of its own length if it has fewer than five words."""
    w, out = D.words_of(text), plain(text, items, window)
    for i, item in items:
        q, a = (D.words_of(x) for x in D.question_and_answer(item))
        all_ = D.words_of(item)
        if not 0 < len(q) < 5:
            continue
        n = min(5, len(all_))
        cut = lambda x: {tuple(x[k:k + n]) for k in range(len(x) - n + 1)}  # noqa: E731, B023
        for s in range(0, max(1, len(w) - window // 2), window // 2):
            part = w[s:s + window]
            if len(cut(all_) & cut(part)) * 100 >= 75 * len(cut(all_)) and len(set(a) & set(part)) * 100 >= 75 * len(set(a)):
                out.add(i)
    return out


def test_short_questions_are_found_whole(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 6))) + rng.choice([". ", "\n"]) + " ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for i in range(60)]
    index = D.build(items, block=4, passage=64, whole=True)
    more = 0
    for _ in range(400):
        body = rng.choices(vocab, k=rng.randint(0, 150))
        words = items[rng.randrange(60)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        text = " ".join([*body[:50], *words, *body[50:]]) if rng.random() < 0.8 else " ".join(body)
        got = set()
        for part in index.passages(D.words_of(text)):
            present = np.array(sorted({index.terms[w] for w in part if w in index.terms}), np.int64)
            for i, _ in index.search(present):
                q, a = index.verify(i, part, D.hashes(part))
                if q >= 0.75 and a >= 0.75:
                    got.add(index.ids[i])
        assert got == plain_whole(text, items, index.window)
        more += got > plain(text, items, index.window)
    assert more > 100
    bench = spark.createDataFrame([(1, "The nt rewh. Thin onwhhe ha rest thesreti thansh in er erbleha as heat"), (2, "short item here")], "item_id long, text string")
    fill = " ".join(f"f{i}" for i in range(900))
    docs = spark.createDataFrame([(1, f"{fill} the nt rewh thin onwhhe ha rest thesreti thansh in er erbleha as heat {fill}"), (2, f"{fill} short item here {fill}"), (3, fill)], "doc_id long, text string")
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [3]


def test_rows(spark, texts):
    item = "what is the third word of this made up question here\nits answer names one"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "??"), (5, item)], "item_id long, text string").selectExpr("*", "1 as doc_id")
    rows = list(enumerate(texts)) + [(100, "So: " + item.upper() + "!"), (100, item), (None, "x " + item), (101, item.split("\n")[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "2 as item_id", "3 as score")
    got = sorted((str(r.doc_id), r.item_id) for r in D.leaks(docs, bench).collect())
    assert got == sorted([("100", 1), ("100", 5)] * 2 + [("None", 1), ("None", 5)])
    assert sorted((str(r.doc_id), r.item_id) for r in D.leaks(docs, bench, round_items=1).collect()) == got
    assert D.leaks(docs, bench.where("false")).collect() == [] and D.leaks(docs.where("false"), bench).collect() == []
    assert D.clean(docs, bench).count() == len(rows) - 3  # the leak without an id goes too


def test_query(spark, duck):
    df = QUERIES["op10_benchmark_leaks"](spark, SF)
    cur = duck.execute(SQL["op10_benchmark_leaks"])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert want and canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want, cols)


def test_query_and_twin_on_hand_made_items(spark):
    """Short questions, items under five words and cuts at question and exclamation marks, against the plain version."""
    items = [(1, "The nt rewh. Thin onwhhe ha rest thesreti thansh in er"), (2, "short item here"), (3, "alpha beta gamma delta epsilon zeta? Paris"), (4, "one two three four five six seven! yes indeed"),
             (5, "what is asked in this line\nthe answer. With two ends"), (6, "... \n tail words of an item without a head"), (7, "lone")]
    fill = " ".join(f"f{i}" for i in range(700))
    docs = [(1, f"{fill} the nt rewh thin onwhhe ha rest thesreti thansh in er {fill}"), (2, f"{fill} short item here"), (3, "alpha beta gamma delta epsilon zeta something Paris"), (4, "alpha beta gamma delta epsilon zeta"),
            (5, "one two three four five six seven yes indeed"), (6, f"{fill} What is asked in this line: the answer, with two ends {fill}"), (7, "tail words of an item without a head"), (8, "a lone word"), (9, None), (10, ""), (11, fill), (12, "the nt rewh")]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("score")
    con = duckdb.connect()
    for name, ident, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({ident} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    cur = con.execute(SQL["op10_benchmark_leaks"])
    cols = [d[0] for d in cur.description]
    found = [tuple(r) for r in got.collect()]
    assert canonical(found, got.columns) == canonical(cur.fetchall(), cols)
    assert {r[:2] for r in found} == {(i, k) for i, t in docs for k in plain_whole(t, items, D.PASSAGE)} == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 5), (7, 6), (8, 7)}


def test_skipped_blocks_are_not_read():
    """Weights of blocks under their bound are poisoned; the search neither reads nor needs them."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(200)]
    index = D.build(items, block=4, passage=64, whole=True)
    kept, skipped = index.weights.copy(), 0
    for i in range(50):
        words = D.words_of(items[i * 4][1]) + rng.choices(vocab, k=20)
        present = np.array(sorted({index.terms[w] for w in words}), np.int64)
        want = index.search(present)
        runs = D.ranges(index.word_starts[present], index.word_starts[present + 1])
        closed = np.bincount(index.run_block[runs], index.run_max[runs], len(index.block_least)) < index.block_least
        index.weights[closed[index.items // index.block]] = np.nan
        assert index.search(present) == want and want
        skipped += int(closed.sum())
        index.weights[:] = kept
    assert skipped > 50 * 40


def test_rows_are_judged_one_by_one_and_rounds_share_the_window(spark):
    item = "what is the third word of this made up question here\nits answer names one"
    long = " ".join(f"l{i}" for i in range(900)) + "\nits end"
    bench = spark.createDataFrame([(1, item), (2, long), (3, "some other item of enough words\nyes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (1, "a clean row"), (2, f"x {long}"), (3, "more")], "doc_id long, text string")
    for size in (1, 20_000):
        assert sorted(r.text for r in D.clean(docs, bench, round_items=size).collect()) == ["a clean row", "more"]
    windows = [held.value.window for held in D._indexes(bench, "item_id", "text", 1, True)]
    assert len(windows) == 3 and set(windows) == {2 * len(D.words_of(long))}
