"""Packing token sequences with Karmarkar-Karp multiway differencing.

A document's full windows fill sequences of their own. What remains is cut into pieces and gathered, partition by
partition, into bins of a few windows' worth of tokens. Within a bin, differencing keeps partial partitions
(one load per window) in a heap by their imbalance and merges the two with the largest, heavy side onto light, until
one is left: near-equal windows. If the fullest exceeds the capacity, the window count rises and the bin is split anew.

Packing needs no shuffle: a bin never leaves its task, and sequence ids hold the partition number, so a
rerun of a lost task gives the same ids. At most one window of each partition is left partly empty.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, rows

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                          ("sequence_id", pa.int64()), ("offset", pa.int64())])


class TextIds:
    """Little-endian unsigned 32-bit ids of texts. The vocabulary is the JSON file's, read in its rank form, which encodes faster; tests hold both against each other."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{path.removesuffix('.json')}.tiktoken"), "rb"))}
        self.encode = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(public_tokenizers.path(path))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # a special token's string counts as that token
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.encode(text)
        return array("I", ids).tobytes()


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split item numbers into k near-equal parts by Karmarkar-Karp differencing."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial partition: loads in falling order, each with a linked list of its items
    heap = [(-s, i, (s,) + (0,) * (k - 1), ((i, None, None),) + (None,) * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, la, pa_ = heapq.heappop(heap)
        _, _, lb, pb = heapq.heappop(heap)
        loads = [x + y for x, y in zip(la, reversed(lb))]
        parts = [(None, x, y) if x and y else x or y for x, y in zip(pa_, reversed(pb))]
        order = sorted(range(k), key=loads.__getitem__, reverse=True)
        loads, parts = tuple(loads[j] for j in order), tuple(parts[j] for j in order)
        heapq.heappush(heap, (loads[-1] - loads[0], tick, loads, parts))
        tick += 1
    out = []
    for part in heap[0][3] if heap else [None] * k:
        items, stack = [], [part]
        while stack:
            node = stack.pop()
            if node:
                if node[0] is None:
                    stack += [node[1], node[2]]
                else:
                    items.append(node[0])
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of items, none above the capacity; the fewest windows the total allows are tried first."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        parts = difference(sizes, k)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1


def cuts(start: int, end: int, piece: int) -> Iterator[int]:
    """Ends of pieces that take two thirds of what is left until ``piece`` ids or fewer are: the small last ones even out the loads."""
    while end - start > piece:
        start += (2 * (end - start) + 2) // 3
        yield start
    yield end


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         piece: int = 64, bin_windows: int = 32, spare: int = 10, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), their CRC-32, the document's tokens, sequence_id, offset.

    Remainders are cut by :func:`cuts` and binned until ``bin_windows`` windows are full but for ``spare`` ids each.
    Null or empty text is the end id alone. Repeated rows are packed one by one; the doc_id may be null. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, sequence = TaskContext.get().partitionId() << 36, 0
        texts, end = TextIds(tokenizer), np.array([end_id], "<u4").tobytes()
        room = bin_windows * (capacity - spare)
        out: list[list] = [[] for _ in PIECE_SCHEMA]
        held: list[tuple] = []
        size = waiting = 0

        def put(p: tuple, seq: int, offset: int) -> None:
            for c, v in zip(out, (*p, base + seq, offset)):
                c.append(v)

        def close() -> None:
            nonlocal sequence, held, size
            for part in windows([p[2] for p in held], capacity):
                offset = 0
                for i in part:
                    put(held[i], sequence, offset)
                    offset += held[i][2]
                sequence += 1
            held, size = [], 0

        for some in rows(batches):
            for r in some:
                ids = texts.ids(r["text"] or "") + end
                n = len(ids) // 4

                def make(a: int, b: int, r=r, ids=ids, n=n) -> tuple:
                    part = ids[4 * a:4 * b]
                    return r["doc_id"], a, b - a, part if with_ids else None, zlib.crc32(part), n

                full = n // capacity * capacity
                for a in range(0, full, capacity):
                    put(make(a, a + capacity), sequence, 0)
                    sequence += 1
                a = full
                while a < n:
                    for b in cuts(a, min(n, a + room - size), piece):
                        held.append(make(a, b))
                        size += b - a
                        a = b
                    if size == room:
                        close()
                waiting += n
                if waiting >= 1 << 20:
                    yield batch(PIECE_SCHEMA, out)
                    out, waiting = [[] for _ in PIECE_SCHEMA], 0
        if held:
            close()
        yield batch(PIECE_SCHEMA, out)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its length and its ids joined in order of their offsets, at most a window of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.aggregate("p", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
