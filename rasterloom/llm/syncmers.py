"""Document fingerprints from closed syncmers.

A run of K bytes is a closed syncmer when the least hash of its inner runs of S bytes is that of its first or last one.
Whether a run is chosen depends on the run alone, so equal passages have equal anchors wherever they stand. A fingerprint
is the SKETCH least hashes of a text's distinct anchors, each with the place where it first stands. The likeness of two
fingerprints estimates the share of anchors that the texts have in common and in the same order: of the common ones, those
count that form the longest run of places ascending in both texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of
from rasterloom.llm.hashing import mix

K, S, SKETCH = 16, 4, 64
#: A long text is taken in slices of so many bytes, which overlap by K - 1.
SLICE = 4_000_000
#: Documents of a range of ids that one task puts in order, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1024, 20_000


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of the bytes, in order. Fewer than K bytes are one anchor; none, none."""
    if len(data) < K:
        whole = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
        return np.zeros(int(bool(data)), np.int64), np.full(int(bool(data)), whole, np.uint64)
    positions, hashes = [], []
    for at in range(0, len(data) - K + 1, SLICE):
        x = np.frombuffer(data, np.uint8, min(SLICE + K - 1, len(data) - at), at)
        found = _chosen(x)
        words = np.lib.stride_tricks.sliding_window_view(x, K)[found].view("<u8")
        positions.append(found + at)
        hashes.append(mix(words[:, 0] * np.uint64(0x9E3779B97F4A7C15) + mix(words[:, 1])))
    return np.concatenate(positions), np.concatenate(hashes)


def _chosen(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.uint32)
    n = len(x) - S + 1
    inner = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3 : n + 3] << np.uint32(24)
    inner *= np.uint32(0x85EBCA6B)
    inner ^= inner >> np.uint32(15)
    inner *= np.uint32(0xC2B2AE35)
    least, width, span = inner, 1, K - S + 1
    while width < span:  # least of `width` neighbours, doubled
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    m = len(least)
    return np.flatnonzero((inner[:m] == least) | (inner[span - 1 : span - 1 + m] == least))


#: A hash and a place, in hexadecimal digits.
DIGITS = 16


def fingerprint(text: str) -> str:
    """Hexadecimal digits of the sketch, eight for the hash and eight for the place (in UTF-8 bytes) of each anchor, ascending by
    hash; empty for an empty text."""
    positions, hashes = syncmers(text.encode("utf-8", "surrogatepass"))
    short, first = np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_index=True)
    return np.column_stack((short[:SKETCH], positions[first[:SKETCH]].astype(np.uint32))).astype(">u4").tobytes().hex()


def in_order(places: list[int]) -> int:
    """Length of the longest ascending run that is left when others are passed over."""
    ends: list[int] = []
    for x in places:
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def likeness(one: str, other: str) -> float:
    """Estimated share of common anchors in the same order; 1 for equal fingerprints, 0 where just one is empty."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x), ">u4").reshape(-1, 2) for x in (one, other))
    if not len(a) or not len(b):
        return 0.0
    both = np.union1d(a[:, 0], b[:, 0])
    if len(a) == SKETCH or len(b) == SKETCH:
        both = both[:SKETCH]
    common, at, there = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    inside = common <= both[-1]
    places = a[at[inside], 1].astype(np.int64), b[there[inside], 1].astype(np.int64)
    return in_order(places[1][np.argsort(places[0])].tolist()) / len(both)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points of the following text, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position (in UTF-8 bytes) and hash of every anchor of every text, for matching passages by position."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in batches_of(batch, "text"):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts):
                    at, hashes = syncmers(text.encode("utf-8", "surrogatepass"))
                    for i in range(0, len(at), 100_000):
                        part = at[i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(part), pa.int64()), pa.array(part), pa.array(hashes[i : i + 100_000].view(np.int64))], names=["doc_id", "position", "hash"])

    return source.mapInArrow(find, "doc_id long, position long, hash long")


def in_ranges(rows: DataFrame) -> DataFrame:
    """The rows with the columns `range` and `guest`: documents by ranges of descending id, and to each range the first
    document of the one that follows (of the first, after the last) as a guest. Only ids are looked at to draw the ranges,
    and only the least and greatest of each range come to the driver."""
    total = rows.count()
    wanted = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / wanted for i in range(1, wanted)], 0.1 / wanted))) if wanted > 1 else []
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    x = F.col("doc_id").cast("double")
    if cuts:  # two short searches: the group of cuts, then the place in it
        group = F.aggregate(F.array(*[F.lit(g[0]) for g in groups]), F.lit(0), lambda n, c: n + (x >= c).cast("int"))
        lists = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
        below = F.when(group == 0, 0).otherwise((group - 1) * side + F.aggregate(F.element_at(lists, F.greatest(group, F.lit(1))), F.lit(0), lambda n, c: n + (x >= c).cast("int")))
    else:
        below = F.lit(0)
    ranged = rows.withColumn("range", F.lit(len(cuts)) - below.cast("int"))
    heads = sorted(ranged.groupBy("range").agg(F.max("doc_id").alias("head")).collect())  # a row for each range
    guests = [(r, head, heads[i - 1][0]) for i, (r, head) in enumerate(heads)]
    if not guests:
        return ranged.withColumn("guest", F.lit(0))
    sides = rows.sparkSession.createDataFrame(guests, "range int, head long, host int")
    joined = ranged.join(F.broadcast(sides), "range")
    places = F.filter(F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.when(F.col("doc_id") == F.col("head"), F.struct(F.col("host").alias("range"), F.lit(1).alias("guest")))), lambda p: p.isNotNull())
    return joined.withColumn("place", F.explode(places)).select("place.range", "place.guest", *rows.columns)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of `docs` (doc_id, text) and of its edited text, whose last half is replaced by the
    start of the document that follows by descending id (of the first, after the last).

    Null and empty texts have an empty fingerprint; two empty texts have likeness 1. A null id comes after all others. Rows
    of equal ids are ordered by their texts; repeated rows stay. An empty table gives no rows; other columns aren't looked
    at. Texts move once, to the task that holds their range of ids.
    """
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = in_ranges(rows)
    ordered = ranges.repartition(F.col("range")).sortWithinPartitions("range", "guest", F.desc("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the document that waits for its next: range, doc_id, text, fingerprint
        for batch in batches:
            for piece, texts in batches_of(batch, "text"):
                out = []
                for at, guest, doc_id, text in zip(piece.column("range").to_pylist(), piece.column("guest").to_pylist(), piece.column("doc_id").to_pylist(), texts):
                    if guest and (before is None or before[0] != at):
                        continue  # a second row of the guest's id
                    own = fingerprint(text)
                    if before is not None:
                        _, last_id, last, last_own = before
                        changed = edited(last, text)
                        print_ = fingerprint(changed)
                        out.append((None if last_id == lowest else last_id, len(last), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), last_own, print_, likeness(last_own, print_), likeness(last_own, own)))
                    before = None if guest else (at, doc_id, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
