"""Exact Jaccard links between documents on word n-grams, and their groups.

A document is its set of hashed n-grams. Equal sets are one class from the start. Two sets that reach the threshold share
one of their first few members in any order fixed for all, so classes meet only in tiles: those that hold one n-gram among
their first, near in size. Then

1. in each tile and size band every class is compared with the band's first; links found so far become components;
2. tiles whose classes are in one component are done. In the larger of the others, each with a first drawn by its own n-gram, this is
   repeated, so that a class meets as many firsts as it has tiles; that joins near copies which differ too much from one first;
3. in tiles still open, pairs across components are compared. A tile with more classes than a bound is not paired up: its n-gram is frequent, so its classes are put in tiles anew by an order that
   starts with their rarest n-grams, where a frequent one counts only for texts made of little else.

A pair that reaches the threshold must do so from the first member it shares on, so a tile holds it only if enough of both sets is left behind the tile's n-gram;
and a pair met in several tiles is passed on from the first, as far as the few tiles each class names show it.

A comparison looks at hashed bitmaps first: bits set in one and not in the other bound the overlap from above. To tiles travel smaller ones, of
parities, whose differing bits bound it too and do not fill up as sets grow. Only pairs that can still reach the threshold have their sorted arrays intersected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, rows, small_batches, written
from .links import components

#: N-gram length, and the threshold 100 * intersection >= 75 * union.
NGRAM, NUM, DEN = 5, 75, 100
#: Tiles with more classes than this go to the rare-first order.
TILE = 1000
#: Tiles a class names, its first, so that a pair is passed on once.
HEADS = 4
#: Bytes of an n-gram's hash that travel to its bucket, which knows the upper bits; two that share them meet for nothing, no more.
KEY = 5


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def ngrams(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """64-bit hashes of the n-grams of hashed words in order; fewer words are one n-gram, none give none."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - k + 1 + i]
    return mix(h)


def ngram_hashes(words: list[bytes], n: int = NGRAM) -> np.ndarray:
    return ngrams(word_hashes(words), n)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ngram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    return np.unique(ngram_hashes(words_of(text), n))


def needed(total, num: int = NUM, den: int = DEN):
    """Least intersection of two sets with this total size that reaches the threshold."""
    return -(-num * total // (num + den))


def prefix_length(n, num: int = NUM, den: int = DEN):
    """How many first members must hold one in common with any set that reaches the threshold."""
    return n - (-(-num * n // den)) + 1


def places(n: int) -> np.ndarray:
    """Places in a prefix in order, each in a byte, as 256ths of the prefix."""
    k = prefix_length(n)
    return (np.arange(k) * 256 // k).astype(np.uint8)


def room(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The most members a set of size n has from a place in its prefix on. Places are rounded down, so it is never too low."""
    return n - -(-place.astype(np.int64) * prefix_length(n) // 256)


def class_of(members: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(members: np.ndarray) -> bytes:
    """The set hashed into a bitmap of at least four times its size, a tenth or so of its bytes; few members fall on one bit."""
    size = max(64, 1 << int(4 * len(members) - 1).bit_length())
    flags = np.zeros(size, np.uint8)
    flags[(members & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def fold(bits: bytes, most: int) -> bytes:
    """A bitmap folded by halves until it has at most ``most`` bytes."""
    if len(bits) <= most:
        return bits
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, most), axis=0).tobytes()


def parity(members: np.ndarray) -> bytes:
    """A bitmap of one to two bits a member, each the parity of the members that fall on it.

    A member of one of two sets alone turns one bit, so differing bits are at most as many as the members not shared. Unlike set bits they don't fill up.
    """
    size = max(64, 1 << int(len(members) - 1).bit_length())
    flags = np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """The overlap is at most each set's size less the bits it sets alone; the larger bitmap is folded onto the smaller."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    p, q = 8 * len(a), 8 * len(b)
    while p > q:
        p //= 2
        x = (x >> p) | (x & ((1 << p) - 1))
    while q > p:
        q //= 2
        y = (y >> q) | (y & ((1 << q) - 1))
    both = (x & y).bit_count()
    return min(na - x.bit_count() + both, nb - y.bit_count() + both)


# ---------------------------------------------------------------------------------------------- texts to sets

PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("bits", pa.binary()), ("short", pa.binary()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("owner", pa.binary()), ("places", pa.binary()),
                     ("classes", pa.binary()), ("sizes", pa.binary())])


def _frequent(docs: DataFrame, sample: tuple[int, int] = (16_000, 64_000), least: int = 4, seed: int = 3) -> np.ndarray:
    """N-grams that ``least`` or more texts of a sample hold, sorted. The sample is an eighth of the texts within the bounds ``sample``, so the
    result has at most the upper bound / ``least`` times the mean set size.

    They are put last in the order of members, which keeps common passages out of prefixes. Only the lower half of hashes is counted, since prefixes
    take the least hashes. Any order gives the same links, so the sample decides on work alone.
    """
    total = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0):
                h = ngram_set(text.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[h >= 0])], ["h"])

    some = docs.select("text").sample(min(1.0, min(sample[1], max(sample[0], total // 8)) / max(1, total)), seed).mapInArrow(run, "h long")
    often = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h").toPandas()
    return np.sort(often["h"].to_numpy().astype(np.int64).view(np.uint64))


def prefix(members: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first members by hash, those in ``last`` behind all others."""
    if len(last):
        at = np.minimum(np.searchsorted(last, members), len(last) - 1)
        late = last[at] == members
        members = np.concatenate([members[~late], members[late]])
    return members[:prefix_length(len(members))]


def _profiles(docs: DataFrame, buckets: int, last: np.ndarray, hold: int = 1 << 18) -> DataFrame:
    """Rows of two kinds. bucket null: a document with its set's size, class and bitmap. Else: a block of prefix members, each with
    the number of its class in ``classes`` and ``sizes``. A task names a class once, however many copies it has.
    """

    held = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hs: list[np.ndarray] = []
        cs: list[int] = []
        ns: list[int] = []
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            h = mix(np.concatenate(hs) if hs else np.zeros(0, np.uint64))
            own = np.repeat(np.arange(len(hs), dtype=np.uint32), [len(x) for x in hs])
            place = np.concatenate([places(n) for n in ns] or [np.zeros(0, np.uint8)])
            where = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            h, own, place, where = h[order], own[order], place[order], where[order]
            cls, n = np.array(cs, np.int64), np.array(ns, np.uint32)
            cuts = np.flatnonzero(np.diff(where)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(h)]):
                if a < b:
                    some, at = np.unique(own[a:b], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                        (None, None, None, None, None, int(where[a]), np.ascontiguousarray(h[a:b].view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes(), at.astype(np.uint32).tobytes(), place[a:b].tobytes(), cls[some].tobytes(), n[some].tobytes()), PROFILE)], schema=PROFILE)

        for some in rows(batches):
            out: list[list] = [[] for _ in range(5)]
            for r in some:
                s = ngram_set(r["text"])
                cls = class_of(s) if len(s) else None
                new = cls is not None and cls not in seen
                bits = bitmap(s) if new else None
                for c, v in zip(out, (r["doc_id"], len(s), cls, bits, parity(s) if new else None)):
                    c.append(v)
                if new:
                    seen.add(cls)
                    hs.append(prefix(s, held.value))
                    cs.append(cls)
                    ns.append(len(s))
                    size += len(hs[-1])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(out, PROFILE)), *(pa.nulls(len(some), f.type) for f in list(PROFILE)[5:])], schema=PROFILE)
            if size >= hold:
                yield from blocks()
                hs, cs, ns, size = [], [], [], 0
        yield from blocks()

    return docs.mapInArrow(run, "doc_id long, n long, cls long, bits binary, short binary, bucket int, hashes binary, owner binary, places binary, classes binary, sizes binary")


def _bands(tile: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of rows sorted by tile and size: one tile each, with sizes up to DEN / NUM of the smallest."""
    cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(tile)]):
        while a < b:
            e = a + int(np.searchsorted(n[a:b], n[a] * DEN // NUM, "right"))
            yield a, e
            a = e


def _partnered(tile: np.ndarray, n: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows, sorted by tile and size, with another in the tile that is near in size and small enough for the room left."""
    if not len(n):
        return np.zeros(0, bool)
    most = np.minimum(n * DEN // NUM, left * (NUM + DEN) // NUM - n)
    step = int(n.max()) * DEN // NUM + 2
    base = np.r_[0, np.cumsum(tile[1:] != tile[:-1])] * step
    at = base + n
    return np.searchsorted(at, base + most, "right") - np.searchsorted(at, base - (-n * NUM // DEN)) > (n <= most)


def _tiles(blocks: DataFrame) -> DataFrame:
    """Rows (bucket, tile, cls, n, room, first) of n-grams that several classes hold: room is what the class's set has from the n-gram on,
    first the class each is compared with first. The bucket is part of the tile's number.
    """
    schema = pa.schema([("bucket", pa.int32()), ("tile", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("room", pa.int64()), ("first", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, ns, ps = [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                own = np.frombuffer(r["owner"], np.uint32)
                low = np.zeros((len(own), 8), np.uint8)
                low[:, :KEY] = np.frombuffer(r["hashes"], np.uint8).reshape(-1, KEY)
                hs.append(low.view(np.uint64)[:, 0])
                cs.append(np.frombuffer(r["classes"], np.int64)[own])
                ns.append(np.frombuffer(r["sizes"], np.uint32)[own])
                ps.append(np.frombuffer(r["places"], np.uint8))
        h, c, n, left = np.concatenate(hs), np.concatenate(cs), np.concatenate(ns), np.concatenate(ps)
        order = np.argsort(h, kind="stable")
        g = h[order]
        # of the members held once nothing is kept; that leaves little to sort in full
        same = np.r_[False, g[1:] == g[:-1]]
        order = order[same | np.r_[same[1:], False]]
        h, c, n = h[order], c[order], n[order].astype(np.int64)
        left = room(n, left[order])
        order = np.lexsort((-left, c, n, h))
        h, c, n, left = h[order], c[order], n[order], left[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
        # a class without another of fitting size has no partner in its tile; what goes may have been another's only one
        for _ in range(3):
            h, c, n, left = h[keep], c[keep], n[keep], left[keep]
            keep = _partnered(h, n, left)
        h, c, n, left = h[keep], c[keep], n[keep], left[keep]
        first = c.copy()
        for a, e in _bands(h, n):
            k = a + int(c[a:e].argmin())
            first[a:e] = np.where(np.minimum(left[a:e], left[k]) >= needed(n[a:e] + n[k]), c[k], c[a:e])
        at = key[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at, np.int32)), pa.array(h.astype(np.int64) + (at << 8 * KEY)), pa.array(c), pa.array(n), pa.array(left), pa.array(first)], schema=schema)

    return blocks.groupBy("bucket").applyInArrow(run, "bucket int, tile long, cls long, n long, room long, first long")


# ---------------------------------------------------------------------------------------------- comparing pairs


def _filter_bits(ids: DataFrame, log2: int = 23) -> np.ndarray:
    """A Bloom filter of fixed size over the ids, one bit each; it only spares work, the join behind it decides."""
    words = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << log2)).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toPandas()
    out = np.zeros(1 << (log2 - 6), np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Sets (cls, n, members) of classes; owners has one document (doc_id, cls) of each."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(_filter_bits(owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            for start in range(0, len(hit), 128):
                part = b.take(pa.array(hit[start:start + 128]))
                ids, cls, n, members = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = ngram_set(text)
                    c = class_of(s) if len(s) else None
                    if c is not None and c not in seen:
                        seen.add(c)
                        ids.append(doc_id)
                        cls.append(c)
                        n.append(len(s))
                        members.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(members, pa.binary())], ["cls", "n", "members"])

    some = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 23)).alias("at")).mapInArrow(run, "cls long, n long, members binary")
    return some.join(owners.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("members").alias("members"))


def _by_bits(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow the overlap the threshold asks for."""
    near = pairs.join(bits.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a")
    near = near.join(bits.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, na, nb, xa, xb = (b.column(i) for i in range(6))
            keep = [overlap_bound(x.as_py(), y.as_py(), p, q) >= needed(p + q) for p, q, x, y in zip(na.to_pylist(), nb.to_pylist(), xa, xb)]
            yield pa.RecordBatch.from_arrays([a_, b_], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, salts: int = 64) -> DataFrame:
    """Pairs (a, b) of classes that reach the threshold."""
    likely = written(_by_bits(pairs, classes), "jaccard-likely")
    owners = written(likely.select(F.col("a").alias("cls")).unionByName(likely.select(F.col("b").alias("cls"))).distinct().join(classes.select("cls", "rep"), "cls").select("cls", F.col("rep").alias("doc_id")), "jaccard-owners")
    sets = _sets(docs, owners)
    # every set goes to where its first is; a first with many partners is spread over salts, and sent only to those in use
    keyed = likely.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    firsts = keyed.select("a", "s").distinct().select(F.col("a").alias("cls"), F.col("a"), "s", F.lit(True).alias("is_first"))
    roles = firsts.unionByName(keyed.select(F.col("b").alias("cls"), "a", "s", F.lit(False).alias("is_first")))
    tiles = roles.join(sets, "cls").select("a", "s", "is_first", "cls", "n", "members")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, waiting, a, b = None, [], [], []

        def compare(cls: int, n: int, members: bytes) -> None:
            both = np.intersect1d(first, np.frombuffer(members, np.uint64), assume_unique=True)
            if len(both) >= needed(len(first) + n):
                a.append(key[0].as_py())
                b.append(cls)

        for batch in batches:
            for r in batch.to_pylist():
                if r["is_first"]:
                    first = np.frombuffer(r["members"], np.uint64)
                    for w in waiting:
                        compare(*w)
                    waiting = []
                elif first is None:
                    waiting.append((r["cls"], r["n"], r["members"]))
                else:
                    compare(r["cls"], r["n"], r["members"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return written(tiles.groupBy("a", "s").applyInArrow(run, "a long, b long"), "jaccard-links")


def _across(tiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a < b) in one tile, of different components, near in size, and allowed by the room left and by the parities of their bitmaps.

    A tile leaves out a pair that both classes name an earlier tile for: there the room is as large or larger, and all else is the same. Pairs
    that share none of the tiles both name come from several buckets.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        tile, cls, n, comp, left = (t.column(c).to_numpy() for c in ("tile", "cls", "n", "comp", "room"))
        order = np.lexsort((n, tile))
        tile, cls, n, comp, left = tile[order], cls[order], n[order], comp[order], left[order]
        names, at = np.unique(cls, return_index=True)
        raw = t.column("short").take(pa.array(order[at])).to_pylist()
        own = np.searchsorted(names, cls)
        heads = np.frombuffer(b"".join(t.column("heads").take(pa.array(order[at])).to_pylist()), np.int64).reshape(-1, HEADS)
        named = heads[own] == tile[:, None]
        rank = np.where(named.any(axis=1), named.argmax(axis=1), HEADS)  # of its class's heads so many are earlier than a row's tile
        size = np.array([len(x) for x in raw], np.int64)
        folded: dict[int, np.ndarray] = {}  # parities of every class folded to a size, for classes of that size or more

        def bitmaps(width: int) -> np.ndarray:
            if width not in folded:
                m = np.zeros((len(names), width // 8), np.uint64)
                for k in np.flatnonzero(size >= width):
                    m[k] = np.bitwise_xor.reduce(np.frombuffer(raw[k], np.uint64).reshape(-1, width // 8), axis=0)
                folded[width] = m
            return folded[width]

        end = np.searchsorted(tile, tile, "right")
        found = np.zeros((0, 2), np.int64)
        held: list[np.ndarray] = []
        waiting = 0
        for i in range(len(tile)):
            e = i + 1 + int(np.searchsorted(n[i + 1:end[i]], n[i] * DEN // NUM, "right"))
            j = i + 1 + np.flatnonzero((comp[i + 1:e] != comp[i]) & (np.minimum(left[i + 1:e], left[i]) >= needed(n[i + 1:e] + n[i])))
            if len(j):
                m = bitmaps(int(size[own[i]]))
                x, y = m[own[i]], m[own[j]]
                bound = (n[i] + n[j] - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
                j = j[bound >= needed(n[i] + n[j])]
                if rank[i] and len(j):
                    both = heads[own[i]][None, :rank[i], None] == heads[own[j]][:, None, :]
                    j = j[~(both & (np.arange(HEADS) < rank[j][:, None])[:, None, :]).any(axis=(1, 2))]
                other = cls[j]
                held.append(np.stack([np.minimum(cls[i], other), np.maximum(cls[i], other)], axis=1))
                waiting += len(other)
                if waiting >= 1 << 18:
                    found, held, waiting = np.unique(np.concatenate([found, *held]), axis=0), [], 0
        found = np.unique(np.concatenate([found, *held]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(([*v, *[-1] * HEADS])[:HEADS], np.int64).tobytes() for v in b.column(2).to_pylist()], pa.binary())], ["cls", "short", "heads"])

    by_room = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("room")).alias("later"), "tile"))), 1, HEADS)
    small = tiles.groupBy("cls").agg(by_room["tile"].alias("heads")).join(classes.select("cls", "short"), "cls").select("cls", "short", "heads").mapInArrow(head, "cls long, short binary, heads binary")
    return tiles.select("bucket", "tile", "cls", "n", "room", "comp").join(small, "cls").groupBy("bucket").applyInArrow(run, "a long, b long")


def _drawn(tiles: DataFrame, draws: int) -> DataFrame:
    """Pairs (a, b) of a band's firsts, so many drawn by tile, with the classes of other components in the band that the room left allows."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        tile, cls, n, comp, left = (t.column(c).to_numpy() for c in ("tile", "cls", "n", "comp", "room"))
        order = np.lexsort((n, tile))
        tile, cls, n, comp, left = tile[order], cls[order], n[order], comp[order], left[order]
        held = [np.zeros((0, 2), np.int64)]
        for draw in range(draws):
            lot = mix(cls.view(np.uint64) ^ mix(tile.view(np.uint64) + np.uint64(draw)))
            for a, e in _bands(tile, n):
                k = a + int(lot[a:e].argmin())
                other = cls[a:e][(comp[a:e] != comp[k]) & (np.minimum(left[a:e], left[k]) >= needed(n[a:e] + n[k]))]
                held.append(np.stack([np.full(len(other), cls[k]), other], axis=1))
        found = np.unique(np.concatenate(held), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    pairs = tiles.select("bucket", "tile", "cls", "n", "room", "comp").groupBy("bucket").applyInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rare_first(docs: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """Tiles (bucket, tile, cls, n, room) of the classes in ``hot`` (cls, rep), by an order that starts with their rarest n-grams.

    A member no other class holds can be in no tile; it only moves the others back. So only shared members travel, and a class
    with more lone members than its prefix is long has no partner.
    """
    sets = _sets(docs, hot.select("cls", F.col("rep").alias("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, n, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                m = np.frombuffer(members.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), cls)), pa.array(np.full(len(m), n)), pa.array(m)], ["cls", "n", "h"])

    members = sets.mapInArrow(run, "cls long, n long, h long")
    spread = written(members, "jaccard-members")
    shared = spread.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = spread.join(shared, "h").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("m"))
    lone = F.col("n") - F.size("m")
    length = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    first = own.select("cls", "n", lone.alias("lone"), F.posexplode(F.slice("m", F.lit(1), F.greatest(F.lit(0), (length - lone).cast("int")))).alias("at", "e"))
    return first.select(F.pmod("e.h", F.lit(buckets)).cast("int").alias("bucket"), F.col("e.h").alias("tile"), "cls", "n", (F.col("n") - F.col("lone") - F.col("at")).alias("room"))


def grouped(docs: DataFrame, tile: int = TILE, small: int = 32, draws: int = 2) -> DataFrame:
    """Rows (doc_id, n, cls, group) for rows (doc_id, text): the set's size and class, and the least class that links lead to; null without words."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = written(_profiles(docs, buckets, _frequent(docs)), "jaccard-profiles")
    profiles = both.where("bucket is null").select("doc_id", "n", "cls", "bits", "short")
    classes = written(profiles.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("bits").alias("bits"), F.max("short").alias("short")), "jaccard-classes")
    tiles = written(_tiles(both.where("bucket is not null").select("bucket", "hashes", "owner", "places", "classes", "sizes")), "jaccard-tiles")
    links = _linked(docs, tiles.where("first <> cls").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct(), classes)
    so_far = components(links)

    def labelled(t: DataFrame) -> DataFrame:
        return t.join(so_far.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")

    def still_open(t: DataFrame, label: str) -> DataFrame:
        """Rows of tiles whose classes are in several components, with the number of rows."""
        t = written(labelled(t), label)
        several = t.groupBy("bucket", "tile").agg(F.count("*").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "tile", "held")
        return written(t.join(several, ["bucket", "tile"]), label)

    open_tiles = still_open(tiles.drop("first"), "jaccard-open")
    large = open_tiles.where(F.col("held") > small)
    if draws and large.take(1):
        links = written(links.unionByName(_linked(docs, _drawn(large, draws), classes)), "jaccard-links")
        so_far = components(links)
        open_tiles = still_open(open_tiles.drop("comp", "held"), "jaccard-open")
    hot = written(open_tiles.where(F.col("held") > tile).select("cls").distinct().join(classes.select("cls", "rep"), "cls"), "jaccard-hot")
    pairs = _across(open_tiles.where(F.col("held") <= tile), classes)
    if hot.take(1):
        pairs = pairs.unionByName(_across(still_open(_rare_first(docs, hot, buckets), "jaccard-rare"), classes))
    more = _linked(docs, pairs.distinct(), classes)
    groups = components(links.unionByName(more)).select(F.col("node").alias("cls"), "component")
    named = classes.select("cls").join(groups, "cls", "left").select("cls", F.coalesce("component", "cls").alias("group"))
    return profiles.select("doc_id", "n", "cls").join(named, "cls", "left").select("doc_id", "n", "cls", "group")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, the least doc_id that links lead to.

    Words are split at ASCII white space, A-Z counts as a-z. Null, empty or blank texts have no n-grams and no link: they are
    their own component. Repeated rows and equal texts are one class. Rows with a null doc_id take part; ids they have not, so
    a component of such rows alone has a null id. ``tile`` changes the work, not the result. Only the id and the text are read.
    """
    rows_ = written(grouped(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), tile), "jaccard-groups")
    least = rows_.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = rows_.join(least, "group", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("cls").isNull(), F.col("doc_id"))).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """Whole rows, one of each group of near copies: that with the least doc_id, null last, then the least class. Texts without words all stay. Columns of any name may stand beside."""
    cls, best_id, best_cls = (free(n, docs.columns) for n in ("_class", "_best_id", "_best"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    blank = F.btrim(body, F.lit(" \t\n\x0b\x0c\r")) == ""
    spoken = docs.where(~blank)
    rows_ = grouped(spoken.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), tile)
    best = rows_.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cls")).alias("b")).select(F.col("b.doc_id").alias(best_id), F.col("b.cls").alias(best_cls))
    at = spoken.columns.index(text)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([class_of(ngram_set(t.as_py())) for t in b.column(at)], pa.int64())], names=[*b.schema.names, cls])

    tagged = spoken.mapInArrow(tag, T.StructType([*spoken.schema.fields, T.StructField(cls, T.LongType())]))
    kept = tagged.join(best, (tagged[cls] == F.col(best_cls)) & tagged[doc_id].cast("long").eqNullSafe(F.col(best_id)), "left_semi")
    return kept.dropDuplicates([cls]).drop(cls).unionByName(docs.where(blank))
