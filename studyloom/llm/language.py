"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

A text is its hashed letter pairs and triples, word edges included, scaled to unit length. Families are separated by
the same kind of machine. Machines are trained side by side in Spark tasks by dual coordinate descent, on a bounded sample of labelled
rows; prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows

DIMS = 8192
UNKNOWN = "und"
#: Language families by code; a language that is not listed is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
            "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "hr": "slavic", "sr": "slavic"}


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None, step: int = 1 << 20) -> np.ndarray | None:
    """Counts of hashed letter pairs and triples, or None without a letter. Long texts are read a step at a time, with what the steps share."""
    low = (text or "").lower()
    counts, any_letter = np.zeros(DIMS), False
    for at in range(0, len(low), step):
        code = np.frombuffer(low[max(0, at - 2):at + step].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[code]
        if not is_letter.any():
            continue
        any_letter = True
        code = np.where(is_letter, code, np.uint32(0))
        code = np.concatenate([np.zeros(1, np.uint32), code, np.zeros(1, np.uint32)])
        code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
        pair = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA6B)
        triple = pair[:-1] * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
        for h in (pair, triple):
            counts += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19), minlength=DIMS)
    return counts if any_letter else None


def train(indices: list[np.ndarray], values: list[np.ndarray], positive: np.ndarray, cost: float = 10.0, passes: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss; both classes weigh the same in all."""
    n = len(indices)
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, max(1, positive.sum()), max(1, n - positive.sum()))
    slack = share * 2 / n / (2 * cost)
    w, alpha, rng = np.zeros(DIMS + 1), np.zeros(n), np.random.default_rng(seed)
    norm = np.array([v @ v for v in values]) + slack + 1
    for _ in range(passes):
        for i in rng.permutation(n):
            k, v = indices[i], values[i]
            g = y[i] * (w[k] @ v + w[-1]) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[k] += d * v
                w[-1] += d
                alpha[i] = new
    return w


@dataclass(frozen=True)
class Model:
    """Machines by pair of labels, positive for the first; members of each family."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]

    def choose(self, labels: list[str], x: np.ndarray) -> tuple[str, float]:
        """The label with most wins, then the largest sum of margins; and the chance that its narrowest margin gives it."""
        if len(labels) == 1:
            return labels[0], 1.0
        wins, sums, least = dict.fromkeys(labels, 0), dict.fromkeys(labels, 0.0), dict.fromkeys(labels, np.inf)
        for a, b in combinations(labels, 2):
            w = self.machines[a, b]
            m = float(w[:-1] @ x + w[-1])
            for label, margin in ((a, m), (b, -m)):
                wins[label] += margin > 0
                sums[label] += margin
                least[label] = min(least[label], margin)
        best = max(labels, key=lambda v: (wins[v], sums[v]))
        return best, float(1 / (1 + np.exp(-3 * np.clip(least[best], -20, 20))))

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = features(text)
        if counts is None or not self.families:
            return UNKNOWN, 0.0
        x = counts / np.sqrt(counts @ counts)
        family, sure = self.choose(sorted(self.families), x)
        label, rather = self.choose(self.families[family], x)
        return label, sure * rather


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1000, families: dict[str, str] | None = None) -> Model:
    """Train on at most about ``per_language`` labelled rows of each language, chosen by a hash of the id.

    Rows with null text, null label or null id, or without a letter, teach nothing. Without labelled rows the model is empty.
    """
    families = FAMILIES if families is None else families
    known = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("lang is not null and doc_id is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, {})
    of = {v: families.get(v, v) for v in counts}
    groups = {f: sorted(v for v in counts if of[v] == f) for f in sorted(set(of.values()))}
    pairs = [("family", *p) for p in combinations(sorted(groups), 2)] + [("language", *p) for g in groups.values() for p in combinations(g, 2)]
    share = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, min(1.0, per_language / n))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    if not pairs:
        return Model(groups, {})

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows(batches):
            out: list[list] = [[], [], [], []]
            for r in some:
                counts = features(r["text"])
                if counts is not None:
                    at = np.flatnonzero(counts)
                    value = (counts[at] / np.sqrt(counts @ counts)).astype(np.float32)
                    for k, (level, a, b) in enumerate(pairs):
                        mine = of[r["lang"]] if level == "family" else r["lang"]
                        if mine in (a, b):
                            for c, v in zip(out, (k, mine == a, at.astype(np.int32).tobytes(), value.tobytes())):
                                c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["pair", "positive", "at", "value"])

    def learn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, positive = [], [], []
        for b in batches:
            at += [np.frombuffer(x.as_py(), np.int32) for x in b.column("at")]
            value += [np.frombuffer(x.as_py(), np.float32).astype(float) for x in b.column("value")]
            positive += b.column("positive").to_pylist()
        order = sorted(range(len(at)), key=lambda i: (at[i].tobytes(), value[i].tobytes()))  # the same weights however rows arrive
        w = train([at[i] for i in order], [value[i] for i in order], np.array([positive[i] for i in order], bool))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([w.tobytes()], pa.binary())], ["pair", "w"])

    trained = sample.select("text", "lang").mapInArrow(spell, "pair int, positive boolean, at binary, value binary").groupBy("pair").applyInArrow(learn, "pair int, w binary").collect()
    machines = {pairs[r["pair"]][1:]: np.frombuffer(r["w"], float) for r in trained}
    for _, a, b in pairs:  # labels without a usable text never win against others
        machines.setdefault((a, b), np.zeros(DIMS + 1))
    return Model(groups, machines)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (0 to 1) added; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0. Only the text decides.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # labels and weights, of a size the languages set
    out = docs.drop("lang_pred", "score")
    at = out.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            said = [model.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
