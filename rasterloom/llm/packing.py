"""Best-fit packing into bins of several permitted lengths.

Pieces are taken longest first. A piece goes to the open bin that it leaves fullest; where none has room, a bin is opened. All
permitted lengths are then tried together: each is filled with the piece and, the longest that fit first, with pieces that are
still left, and the length whose cost is least for each token so held is opened. At the end each bin is downsized to the least
permitted length that holds its contents. A bin costs its length, a fixed overhead, and what attention adds to long sequences.

Bins are formed within blocks of rows of one input partition: nothing is shuffled, no key can grow hot, and memory is
bounded by the block. The same files and split settings give the same bins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, words_bytes

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Tokens' worth of cost that each bin has besides its length (a step's fixed work).
OVERHEAD = 32
#: At this length attention, which grows with the square of the length, costs as much as all the rest.
ATTENTION = 65_536


def bin_cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return length + length * length / attention + overhead


class Left:
    """How many pieces of each size are left, for trial fills."""

    def __init__(self, sizes: Sequence[int]):
        self.count = Counter(sizes)
        self.there = sum(1 << s for s in self.count)  # the bits of the sizes that are left

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.there ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens that pieces which are left would put into so much room, the longest that fits first."""
        free = most = room
        while small := self.there & ((2 << most) - 1):
            size = small.bit_length() - 1
            free -= size * min(self.count[size], free // size)
            most = min(free, size - 1)
        return room - free


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, offset of each piece in its bin, and the length of each bin. No piece may exceed the longest bin."""
    lengths = sorted(lengths)
    costs = {n: bin_cost(n, overhead, attention) for n in lengths}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = Left(sizes)
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by free tokens
    rooms = 0  # the bits of free tokens that some bin has
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), []
    for i in order:
        size = sizes[i]
        left.take(size)
        if fits := rooms >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                rooms ^= 1 << free
        else:
            length = min((n for n in lengths if n >= size), key=lambda n: (costs[n] / (size + left.fill(n - size)), n))
            b, free = len(used), length
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if free > size:
            room[free - size].append(b)
            rooms |= 1 << (free - size)
    return bins, offsets, [lengths[bisect_left(lengths, n)] for n in used]


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION, block: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every whole document: tokens are its words and one end. A longer document than the longest bin is cut into
    pieces of that length and a rest. Returns a row per piece: doc_id, piece, start and n_tokens (in the document), bin_id,
    bin_offset, bin_length, bin_tokens.

    Null and empty texts are one piece of one token (the end); null ids and repeated rows are packed like any other row;
    ties go by the order of rows; an empty table gives no rows; other columns aren't looked at.
    """
    lengths = tuple(sorted(set(lengths)))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_length", "bin_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def packed(rows: list[tuple], first_bin: int) -> tuple[pa.RecordBatch, int]:
        ids, piece, start, size = zip(*rows)
        bins, offsets, bin_lengths = pack(size, lengths, overhead, attention)
        at = np.asarray(bins)
        held = np.bincount(at, weights=np.asarray(size)).astype(np.int64)
        columns = [ids, piece, start, size, at + first_bin, offsets, np.asarray(bin_lengths)[at], held[at]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema), first_bin + len(bin_lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows: list[tuple] = []
        next_bin = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in batches_of(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    n = len(words_bytes(text)) + 1
                    rows += [(doc_id, k, s, min(lengths[-1], n - s)) for k, s in enumerate(range(0, n, lengths[-1]))]
                    while len(rows) >= block:
                        out, next_bin = packed(rows[:block], next_bin)
                        rows = rows[block:]
                        yield out
        if rows:
            yield packed(rows, next_bin)[0]

    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))
