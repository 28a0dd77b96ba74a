"""Benchmark decontamination with a BM25 index of the test items and block-max pruning.

The items are indexed; every training passage is a query. An item's score is the sum of its BM25 weights for the words it shares
with the passage. A passage that repeats three quarters of an item's question and answer can miss only so many of its words,
which gives each item a least score that no such passage falls below. Items lie in blocks; for a word, a block keeps the
largest weight any of its items has. Blocks whose summed maxima stay under the least score of all their items are skipped, the others are scored,
and items that reach their least score are verified on word 5-grams. So pruning never loses a match.

The index is built for a bounded number of items at a time and sent to the tasks; more items mean more rounds over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows
from .jaccard import ngram_hashes

WORD = re.compile(r"\w+")
#: N-gram length and the share of question and answer that must be there.
NGRAM, NUM, DEN = 5, 75, 100
K1, B = 1.2, 0.75
PASSAGE = 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line, or else the last sentence; an item of one sentence is a question alone."""
    body = text.strip()
    for mark in ("\n", ". ", "? ", "! "):
        head, found, tail = body.rpartition(mark)
        if found and words_of(head) and words_of(tail):
            return head, tail
    return body, ""


def hashes(words: list[str], n: int = NGRAM) -> np.ndarray:
    return np.unique(ngram_hashes([w.encode() for w in words], n))


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of many slices, joined."""
    sizes = ends - starts
    at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    return at + np.arange(len(at))


@dataclass
class Index:
    """Postings by word, then block, then item; block maxima; the least score and what to verify of each item."""

    ids: list[int]
    terms: dict[str, int]
    word_starts: np.ndarray  # word -> its runs
    run_block: np.ndarray  # run -> block
    run_max: np.ndarray
    run_starts: np.ndarray  # run -> its postings
    items: np.ndarray
    weights: np.ndarray
    least: np.ndarray
    block: int
    block_least: np.ndarray
    questions: list[np.ndarray]
    answers: list[frozenset[str]]
    wholes: list[tuple[int, np.ndarray] | None]  # of items with a short question: n-gram length and n-grams of the whole item
    window: int

    def search(self, present: np.ndarray) -> list[tuple[int, float]]:
        """Items, with scores, that reach their least score for a passage with these word numbers."""
        runs = ranges(self.word_starts[present], self.word_starts[present + 1])
        if not len(runs):
            return []
        bound = np.bincount(self.run_block[runs], self.run_max[runs], len(self.block_least))
        open_ = bound >= self.block_least
        runs = runs[open_[self.run_block[runs]]]
        if not len(runs):
            return []
        at = ranges(self.run_starts[runs], self.run_starts[runs + 1])
        score = np.bincount(self.items[at], self.weights[at], len(self.ids))
        return [(int(i), float(score[i])) for i in np.flatnonzero(score >= self.least)]

    def verify(self, item: int, words: list[str], grams: np.ndarray) -> tuple[float, float]:
        q, a = self.questions[item], self.answers[item]
        have = np.isin(q, grams).sum() / len(q)
        if whole := self.wholes[item]:
            n, w = whole
            have = max(have, np.isin(w, grams if n == NGRAM else hashes(words, n)).sum() / len(w))
        return float(have), len(a.intersection(words)) / len(a) if a else 1.0

    def passages(self, words: list[str]) -> Iterator[list[str]]:
        """Windows that overlap by half, so that any item lies whole in one."""
        half = self.window // 2
        for start in range(0, max(1, len(words) - half), half):
            yield words[start:start + self.window]


def build(items: list[tuple[int, str]], block: int = 16, passage: int = PASSAGE, whole: bool = False) -> Index:
    """An index of (item_id, text) pairs; items without a word are left out. ``whole`` is that of :func:`leaks`."""
    kept = [(i, t) for i, t in items if words_of(t)]
    docs = [words_of(t) for _, t in kept]
    terms: dict[str, int] = {}
    df: dict[int, int] = {}
    counts: list[dict[int, int]] = []
    for d in docs:
        tf: dict[int, int] = {}
        for w in d:
            k = terms.setdefault(w, len(terms))
            tf[k] = tf.get(k, 0) + 1
        counts.append(tf)
        for k in tf:
            df[k] = df.get(k, 0) + 1
    n, mean = len(docs), sum(map(len, docs)) / max(1, len(docs))
    word, item, weight = [], [], []
    least = np.zeros(n)
    questions, answers, wholes = [], [], []
    for i, ((_, text), tf) in enumerate(zip(kept, counts)):
        idf = {k: np.log(1 + (n - df[k] + 0.5) / (df[k] + 0.5)) for k in tf}
        w = {k: idf[k] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(docs[i]) / mean)) for k, c in tf.items()}
        q, a = question_and_answer(text)
        questions.append(hashes(words_of(q)))
        answers.append(frozenset(words_of(a)))
        k = min(NGRAM, len(docs[i]))
        wholes.append((k, hashes(docs[i], k)) if whole and len(words_of(q)) < NGRAM else None)
        # n-grams that may be missing bound the words that may be; none counts twice
        lost = (DEN - NUM) * max(len(questions[i]), len(wholes[i][1]) if wholes[i] else 0) // DEN + (DEN - NUM) * len(answers[i]) // DEN
        least[i] = (sum(w.values()) - sum(sorted(w.values(), reverse=True)[:lost])) * (1 - 1e-6)
        word += w
        item += [i] * len(w)
        weight += w.values()
    word_, item_, weight_ = np.array(word, np.int64), np.array(item, np.int64), np.array(weight, float)
    order = np.lexsort((item_, word_))
    word_, item_, weight_ = word_[order], item_[order], weight_[order]
    run = np.flatnonzero(np.r_[True, (word_[1:] != word_[:-1]) | (item_[1:] // block != item_[:-1] // block)]) if n else np.zeros(0, np.int64)
    blocks = -(-n // block)
    return Index([i for i, _ in kept], terms, np.searchsorted(word_[run], np.arange(len(terms) + 1)), item_[run] // block, np.maximum.reduceat(weight_, run) if n else weight_, np.r_[run, len(word_)], item_, weight_,
                 least, block, np.array([least[b * block:(b + 1) * block].min() for b in range(blocks)]), questions, answers, wholes, max(passage, 2 * max(map(len, docs), default=0)))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", round_items: int = 20_000, whole: bool = True) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap) for every document and item it repeats; the best of its passages.

    A passage repeats an item if it holds three quarters of the question's word 5-grams and of the answer's different words. Case and
    punctuation do not count. Null or empty texts, and items without a word, match nothing. Repeated rows match alike, each on its own.
    A question of fewer than five words is one n-gram of its own length, which only a passage as short can hold. So the n-grams
    of the whole item also count as those of such a question, and an item of fewer than five words is one n-gram looked for in any passage; not so without ``whole``.
    ``round_items`` bounds the items indexed at a time; word statistics are those of the round and do not decide.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for held in _indexes(benchmark, item_id, item_text, round_items, whole):
        found = docs.mapInArrow(_search(held), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, round_items: int, whole: bool) -> Iterator:
    """A broadcast index per round; the passages of all rounds are those of the longest item of all."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    rounds = max(1, -(-items.count() // round_items))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((len(words_of(t)) for t in b.column(0).to_pylist()), default=0)], pa.int64())], ["n"])

    # one round sees all items itself
    passage = PASSAGE if rounds == 1 else max(PASSAGE, 2 * (items.select("text").mapInArrow(longest, "n long").agg(F.max("n")).first()[0] or 0))
    for k in range(rounds):
        mine = items if rounds == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(build([tuple(r) for r in mine.collect()], passage=passage, whole=whole))


def repeated(index: Index, text: str | None) -> dict[int, tuple[float, float, float]]:
    """The items a text repeats, each with question and answer overlap and score of its best passage."""
    number = index.terms.get
    best: dict[int, tuple[float, float, float]] = {}
    for words in index.passages(words_of(text)):
        present = {number(w, -1) for w in words}
        present.discard(-1)
        grams = None
        for i, score in index.search(np.fromiter(sorted(present), np.int64, len(present))):
            grams = hashes(words) if grams is None else grams
            q, a = index.verify(i, words, grams)
            if q * DEN >= NUM and a * DEN >= NUM:
                best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (q, a, score))
    return best


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for some in rows(batches):
            out: list[list] = [[] for _ in range(5)]
            for r in some:
                best = repeated(index, r["text"])
                for i, (q, a, score) in sorted(best.items()):
                    for c, v in zip(out, (r["doc_id"], index.ids[i], score, q, a)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", round_items: int = 20_000) -> DataFrame:
    """The rows that repeat no item, those with short questions whole; each row is judged on its own text, also without an id. Null and empty texts stay."""
    text_at = docs.columns.index(text)

    def drop(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = held.value
            for b in batches:
                yield b.filter(pa.array([not repeated(index, t.as_py()) for t in b.column(text_at)], pa.bool_()))

        return run

    schema = docs.schema
    for held in _indexes(benchmark, "item_id", "text", round_items, True):
        docs = docs.mapInArrow(drop(held), schema)
    return docs
