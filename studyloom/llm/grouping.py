"""Best-fit packing by a grouping genetic algorithm.

An individual is a whole packing; its genes are the bins. Crossover takes whole well-filled bins of one parent into the other; the other's bins that
share a document with them go, so nothing is there twice, and the documents displaced are put back: first in place of a smaller one wherever
that fills a bin better, then by best fit in falling order. A child takes its parent's place if it has fewer bins, or as many with the free
space in fewer places.

A document over the capacity is cut into full pieces, which are sequences of their own, and one shorter first piece. First pieces are dealt by a hash
into groups of about ``group_items``, so a group holds all kinds of lengths and an average of half a window is lost in each. A group is packed by
several islands, one task row each, that evolve apart; after each epoch every island hands its elite to the next one. Groups that
have reached a lower bound stop. A state is a few kilobytes of bin numbers, and all draws come from the group, island and epoch, so a lost task does the same again.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, rows, written
from .packing import TextIds

CAPACITY, END_ID = 1024, 2
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("key", pa.int64())])
PIECES_DDL = "doc_id long, piece long, start long, length long, ids binary, ids_crc32 long, key long"


class Packing:
    """Bins of item numbers, the free space of each, and each item's bin. An emptied bin stays as an empty place."""

    __slots__ = ("bins", "free", "where")

    def __init__(self, bins: list[tuple], free: list[int], where: list[int]):
        self.bins, self.free, self.where = bins, free, where

    def copy(self) -> Packing:
        return Packing(self.bins.copy(), self.free.copy(), self.where.copy())

    def worth(self, capacity: int) -> tuple[int, int]:
        """Smaller is better: bins in use, then how evenly the free space is spread."""
        open_ = [f for f in self.free if 0 < f < capacity]
        return len(self.free) - self.free.count(capacity), -sum(f * f for f in open_)

    def best_fit(self, items: list[int], sizes: list[int], capacity: int) -> None:
        """Put items, in this order, into the fullest bins that take them."""
        bins, free, where = self.bins, self.free, self.where
        room = sorted((f, b) for b, f in enumerate(free) if f)
        for i in items:
            k = bisect_left(room, (sizes[i], -1))
            if k < len(room):
                f, b = room.pop(k)
                bins[b] += (i,)
            else:
                f, b = capacity, len(bins)
                bins.append((i,))
                free.append(f)
            f -= sizes[i]
            free[b], where[i] = f, b
            if f:
                insort(room, (f, b))

    def replace(self, items: list[int], sizes: list[int], capacity: int, rng: random.Random, tries: int) -> list[int]:
        """Put items in place of smaller ones that leave less free space; returns what is out then, in falling order."""
        items = sorted(items, key=sizes.__getitem__)
        outer = [sizes[i] for i in items]
        open_ = [b for b, f in enumerate(self.free) if 0 < f < capacity]
        for b in rng.sample(open_, min(tries, len(open_))):
            f, gain, swap = self.free[b], 0, None
            for i in self.bins[b]:
                k = bisect_right(outer, sizes[i] + f) - 1
                if k >= 0 and outer[k] - sizes[i] > gain:
                    gain, swap = outer[k] - sizes[i], (i, k)
            if swap:
                i, k = swap
                new = items.pop(k)
                outer.pop(k)
                self.bins[b] = tuple(new if x == i else x for x in self.bins[b])
                self.free[b], self.where[new] = f - gain, b
                k = bisect_left(outer, sizes[i])
                items.insert(k, i)
                outer.insert(k, sizes[i])
        return items[::-1]

    def labels(self) -> np.ndarray:
        return np.array(self.where, "<u4")

    @classmethod
    def of(cls, where: np.ndarray, sizes: list[int], capacity: int) -> Packing:
        bins: list[tuple] = [()] * (int(where.max()) + 1 if len(where) else 0)
        free = [capacity] * len(bins)
        for i, b in enumerate(where.tolist()):
            bins[b] += (i,)
            free[b] -= sizes[i]
        return cls(bins, free, where.tolist())


def seeded(sizes: list[int], capacity: int, noise: float, rng: random.Random) -> Packing:
    """Best fit in falling order of sizes that are blurred by ``noise``."""
    out = Packing([], [], [0] * len(sizes))
    out.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random())), sizes, capacity)
    return out


def crossover(giver: Packing, taker: Packing, sizes: list[int], capacity: int, rng: random.Random, most: int = 8, emptied: int = 3, tries: int = 150) -> Packing | None:
    """The taker with some whole bins of the giver, full ones if there are any; None if they have the same bins."""
    new = taker.copy()
    chosen: dict[int, tuple] = {}
    spare: dict[int, tuple] = {}
    count = rng.randint(1, most)
    for _ in range(6 * most):
        g = giver.bins[b := rng.randrange(len(giver.bins))]
        if not g or sorted(taker.bins[taker.where[g[0]]]) == sorted(g):
            continue
        (spare if giver.free[b] else chosen)[b] = g
        if len(chosen) == count:
            break
    if not chosen:
        chosen = dict([min(spare.items(), key=lambda x: giver.free[x[0]])]) if spare else {}
    if not chosen:
        return None
    moved = {i for g in chosen.values() for i in g}
    gone = {taker.where[i] for i in moved}
    open_ = sorted(((f, b) for b, f in enumerate(taker.free) if 0 < f < capacity and b not in gone), reverse=True)
    gone.update(b for _, b in open_[:rng.randint(0, emptied)])
    displaced = [i for b in gone for i in taker.bins[b] if i not in moved]
    places = sorted(gone)
    for b in places:
        new.bins[b], new.free[b] = (), capacity
    for b, (g_at, g) in zip(places, chosen.items()):
        new.bins[b], new.free[b] = g, giver.free[g_at]
        for i in g:
            new.where[i] = b
    for g_at, g in list(chosen.items())[len(places):]:
        for i in g:
            new.where[i] = len(new.bins)
        new.bins.append(g)
        new.free.append(giver.free[g_at])
    new.best_fit(new.replace(displaced, sizes, capacity, rng, tries), sizes, capacity)
    return new


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: large items meet nobody, middle ones one another never, and the small ones at best fill up the middle ones' bins."""
    s = np.sort(np.array(sizes, np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    middle = int(np.searchsorted(s, capacity // 2, "right"))
    best = -(-int(total[-1]) // capacity)
    for least in np.unique(np.concatenate([[0], s[:middle]])).tolist():
        large = int(np.searchsorted(s, capacity - least, "right"))
        small = int(np.searchsorted(s, least, "left"))
        between = max(0, large - middle)
        over = int(total[middle] - total[min(small, middle)]) - (between * capacity - int(total[max(large, middle)] - total[middle]))
        best = max(best, len(s) - max(large, middle) + between + max(0, -(-over // capacity)))
    return best


def evolve(people: list[Packing], sizes: list[int], capacity: int, generations: int, bound: int, rng: random.Random) -> list[Packing]:
    """Crossovers of random pairs, each child against its taker; stops at the bound. Best first."""
    worths = [p.worth(capacity) for p in people]
    for _ in range(generations):
        if min(worths)[0] <= bound or len(people) < 2:
            break
        giver, taker = rng.sample(range(len(people)), 2)
        child = crossover(people[giver], people[taker], sizes, capacity, rng)
        if child is not None and (worth := child.worth(capacity)) <= worths[taker]:
            people[taker], worths[taker] = child, worth
    return [people[i] for i in sorted(range(len(people)), key=worths.__getitem__)]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str, text: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece, with a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 36
        texts, end = TextIds(tokenizer), np.array([end_id], "<u4").tobytes()
        out: list[list] = [[] for _ in PIECES]
        size = 0
        for some in rows(batches):
            for r in some:
                ids = texts.ids(r["text"] or "") + end
                n = len(ids) // 4
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cut, cut[1:])):
                    part = ids[4 * a:4 * b]
                    for c, v in zip(out, (r["doc_id"], piece, a, b - a, part if with_ids else None, zlib.crc32(part), key)):
                        c.append(v)
                    key += 1
                size += n
                if size >= 1 << 20:
                    yield batch(PIECES, out)
                    out, size = [[] for _ in PIECES], 0
        yield batch(PIECES, out)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, PIECES_DDL)


STATE = pa.schema([("group", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("people", pa.list_(pa.binary())), ("used", pa.int32()), ("bound", pa.int32())])
STATE_DDL = "`group` long, island int, sizes binary, people array<binary>, used int, bound int"


def epoch(states: DataFrame, number: int, capacity: int, population: int, generations: int) -> DataFrame:
    """Every island evolves by itself. Needs group, island, sizes, people (best first, none at the start), used and bound; ``immigrant`` joins the population."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows(batches, 16):
            out: list[list] = [[] for _ in STATE]
            for r in some:
                sizes = np.frombuffer(r["sizes"], "<u4").tolist()
                rng = random.Random(f"{r['group']} {r['island']} {number}")
                bound, people, used = r["bound"], r["people"] or [], r["used"]
                if number == 0 or r["group_used"] > bound:
                    there = [Packing.of(np.frombuffer(p, "<u4"), sizes, capacity) for p in [*people, *([r["immigrant"]] if r["immigrant"] else [])]]
                    if number == 0:
                        bound = lower_bound(sizes, capacity)
                        there = [seeded(sizes, capacity, 0.02 * (r["island"] + i), rng) for i in range(population)]
                    there = evolve(there, sizes, capacity, generations, bound, rng)[:population]
                    people, used = [p.labels().tobytes() for p in there], there[0].worth(capacity)[0]
                for c, v in zip(out, (r["group"], r["island"], r["sizes"], people, used, bound)):
                    c.append(v)
            yield batch(STATE, out)

    return states.mapInArrow(run, STATE_DDL)


def migrated(states: DataFrame) -> DataFrame:
    """Each island gets the elite of the one before it in its group, and the fewest bins anybody has."""
    ring = Window.partitionBy("group").orderBy("island")
    whole = Window.partitionBy("group")
    elite = F.col("people")[0]
    last = F.max_by(elite, "island").over(whole)
    return states.select("*", F.coalesce(F.lag(elite).over(ring), last).alias("immigrant"), F.min("used").over(whole).alias("group_used"))


def best_fit_pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_items: int = 4096,
                  islands: int = 3, epochs: int = 3, population: int = 4, generations: int = 100, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), their CRC-32, sequence_id, offset.

    A document's ids end with ``end_id``. Only documents over ``capacity`` are cut: full pieces behind a first one that may be shorter. Null or empty
    text is the end id alone; very long ones are cut whole. Repeated rows are packed one by one, null ids too; ties in size go to the fullest bin,
    then to the earlier one. Other columns are not read. An empty table gives no rows. Sequences of full pieces have negative numbers.
    """
    found = written(pieces(docs, tokenizer, doc_id, text, capacity, end_id, with_ids), "grouping-pieces")
    short = found.where(F.col("length") < capacity)
    n = short.count()
    groups = max(1, round(n / group_items))
    dealt = short.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"), "key", "length")

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("key").combine_chunks()
        keys, sizes = t["key"].to_numpy().astype("<i8").tobytes(), t["length"].to_numpy().astype("<u4").tobytes()
        return pa.table({"group": t["group"].slice(0, 1), "keys": pa.array([keys], pa.binary()), "sizes": pa.array([sizes], pa.binary())})

    members = written(dealt.groupBy("group").applyInArrow(gather, "`group` long, keys binary, sizes binary"), "grouping-groups")
    nobody = [F.lit(None).cast("array<binary>").alias("people"), F.lit(None).cast("int").alias("used"), F.lit(None).cast("int").alias("bound"), F.lit(None).cast("binary").alias("immigrant"),
              F.lit(None).cast("int").alias("group_used")]
    states = members.select("group", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", *nobody).repartition("group", "island")
    for number in range(epochs):
        states = written(epoch(states, number, capacity, population, generations), "grouping-epoch")
        if number + 1 < epochs:
            states = migrated(states).repartition("group", "island")
    best = states.groupBy("group").agg(F.min_by(F.struct(F.col("people")[0].alias("where")), F.struct("used", "island")).alias("p"))
    chosen = members.select("group", "keys", "sizes").join(best, "group").select("group", "keys", "sizes", F.col("p.where").alias("where"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for some in rows(batches, 16) for r in some):
            keys, sizes, at = (np.frombuffer(r[c], kind).astype(np.int64) for c, kind in (("keys", "<i8"), ("sizes", "<u4"), ("where", "<u4")))
            order = np.argsort(at, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            first = np.searchsorted(at[order], at[order])
            yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array((r["group"] << 32) + at[order]), pa.array(before - before[first])], names=["key", "sequence_id", "offset"])

    placed = chosen.mapInArrow(place, "key long, sequence_id long, offset long")
    columns = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    full = found.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("key")).withColumn("offset", F.lit(0).cast("long"))
    return full.select(*columns).unionByName(short.join(placed, "key").select(*columns)).withColumn("piece", F.col("piece").cast("int"))
