"""Near dedup by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidate edges.

Every document's distinct shingles are hashed once and dealt to bins; a bin's value is its least hash, and an empty bin
takes the value of the first non-empty bin in an order of its own (which is the same for all documents). Bands of bins are
buckets. Documents of equal word sequences are one representative, so copies cost nothing further.

In each bucket the least representative is the hub of a star, and only its edges are candidates. An edge is confirmed on
full shingle sets, as sorted 64-bit hashes. A bucket whose members then lie in several components is compared further, but
for the members of its largest component among each other: members are dealt to chunks of bounded size, each pair of chunks
is a block of its own, and within a block sizes and sketches are compared, so that only pairs that may be links become rows
to confirm. No link that shares a bucket is lost. Documents with similarity of 0.75 share no bucket with a chance of 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Stage, batches_of, checked, settled, words_bytes
from rasterloom.llm.components import components, extended
from rasterloom.llm.hashing import mix, shingles

WORDS = 5
#: Similarity as a fraction: links have 100 * intersection >= 75 * union.
SIMILARITY = (75, 100)
BANDS, BINS_PER_BAND = 48, 5
#: An odd sketch has so many bits; each shingle of the set, or of a sample of it by hash, flips one. What differs between two
#: sketches tells the size of the symmetric difference. Pairs that differ by six standard deviations more than a link may are
#: passed over, which a link is with a chance of 1e-9; all others are confirmed on full sets.
SKETCH_BITS, SKETCH_SHINGLES = 2048, 1024
#: Members of a bucket that one chunk is expected to hold.
CHUNK = 512


@lru_cache(4)
def donors(bins: int) -> np.ndarray:
    """donors[i, j]: when bin i, if empty, asks bin j."""
    rng = np.random.default_rng(977)
    return np.array([rng.permutation(bins) for _ in range(bins)], np.uint16)


@lru_cache(4)
def bin_bounds(bins: int) -> np.ndarray:
    return (np.arange(bins, dtype=object) * 2**64 // bins).astype(np.uint64)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One value for each bin of sorted distinct hashes (not empty)."""
    first = np.searchsorted(hashes, bin_bounds(bins))
    ends = np.append(first[1:], len(hashes))
    full = first < ends
    values = np.empty(bins, np.uint64)
    values[full] = mix(hashes[first[full]])
    if not full.all():
        filled = np.flatnonzero(full)
        empty = np.flatnonzero(~full)
        values[empty] = values[filled[donors(bins)[np.ix_(empty, filled)].argmin(1)]]
    return values


@lru_cache(4)
def _band_salts(bands: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(311)
    return rng.integers(0, 2**63, width, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, bands, dtype=np.uint64)


def band_hashes(values: np.ndarray, bands: int, width: int) -> np.ndarray:
    odd, salt = _band_salts(bands, width)
    return mix((mix(values.reshape(bands, width)) * odd).sum(1, dtype=np.uint64) + salt).view(np.int64)


def sketch(hashes: np.ndarray) -> tuple[int, list[int], list[bytes]]:
    """The level at which at most SKETCH_SHINGLES shingles are expected, and for it and the next the number of shingles and the
    bits. The next level is left out (0, no bits) where the set is too small to be linked with one of that level."""
    part, whole = SIMILARITY
    level = max(0, (max(len(hashes), 1) - 1) // SKETCH_SHINGLES).bit_length()
    counts, bits = [0, 0], [b"", b""]
    for i in (0, 1):
        if i and len(hashes) * whole < part * (SKETCH_SHINGLES << level):
            break
        some = hashes[hashes & np.uint64((1 << (level + i)) - 1) == 0]
        parity = np.bincount((some >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
        counts[i], bits[i] = len(some), np.packbits(parity.astype(np.uint8)).tobytes()
    return level, counts, bits


def signatures(docs: DataFrame, bands: int, width: int) -> DataFrame:
    """row, doc_id, n_shingles, words (digest of the word sequence; null without words) and bands of every document."""
    source = docs.select(F.col("__rasterloom_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("words", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in batches_of(batch, "text"):
                counts, digests, found = [], [], []
                for text in texts:
                    words = words_bytes(text)
                    own = shingles(words, WORDS)
                    counts.append(len(own))
                    digests.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                    found.append(band_hashes(signature(own, bands * width), bands, width) if words else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32), np.concatenate(found))
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], schema=schema)

    return source.mapInArrow(sign, "row long, doc_id long, n_shingles long, words binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, bands: int, width: int) -> Stage:
    """Of each wanted row (its number is the representative's): rep, n, hashes (the sorted set), and what blocks compare: level,
    counts and bits of its sketches, and its bands."""
    numbered = docs.select(F.col("__rasterloom_row").alias("rep"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64())), ("level", pa.int32()), ("c", pa.int64()), ("d", pa.int64()), ("own", pa.binary()), ("next", pa.binary()), ("bands", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in batches_of(batch, "text"):
                rows, sets = [], []
                for text in texts:
                    own = shingles(words_bytes(text), WORDS)
                    level, counts, bits = sketch(own)
                    sets.append(own.view(np.int64))
                    rows.append((level, *counts, *bits, band_hashes(signature(own, bands * width), bands, width).tobytes()))
                sizes = [len(s) for s in sets]
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate(sets))
                yield pa.RecordBatch.from_arrays([piece.column("rep"), pa.array(sizes, pa.int64()), lists, *(pa.array(c, schema.field(3 + i).type) for i, c in enumerate(zip(*rows)))], schema=schema)

    return Stage(numbered.join(checked(wanted), "rep").mapInArrow(make, "rep long, n long, hashes array<long>, level int, c long, d long, own binary, next binary, bands binary"), "sets")


def few_files(rows: DataFrame) -> DataFrame:
    """Small rows that are left of many or of large ones, dealt out anew by their own size, so that they aren't stored as a file for
    each task that made them (on a local disk, without its native library, Hadoop starts three processes for each file)."""
    return rows.hint("rebalance")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Which of the pairs (a, b) of representatives, a stored frame, are linked, on their full sets (rep, n, hashes). Pairs are
    broadcast to the sets of b where they are few enough, so that these sets don't move by themselves; a pair carries the set of b
    to that of a, and no sets but those of an `a` are dealt out to meet it. Adaptive execution splits an `a` with many pairs."""
    part, whole = SIMILARITY
    side = lambda some, end: some.select(F.col("rep").alias(end), F.col("n").alias("n" + end), F.col("hashes").alias("h" + end))
    hubs = pairs.select(F.col("a").alias("rep")).distinct()
    sized = side(sets, "b").join(checked(pairs), "b").join(side(sets.join(checked(hubs), "rep", "left_semi"), "a"), "a")
    common = F.size(F.array_intersect("ha", "hb"))
    linked = F.when(F.least("na", "nb") * whole >= F.greatest("na", "nb") * part, (common > 0) & (common * whole >= part * (F.col("na") + F.col("nb") - common))).otherwise(F.lit(False))
    return few_files(sized.where(linked).select("a", "b"))


def compared(block: pa.Table) -> pa.RecordBatch:
    """Pairs (a, b) of a block's members that may be linked, each in the first band alone in which the two meet. A block's rows
    are one chunk (all its pairs), or two (pairs across)."""
    part, whole = SIMILARITY
    rep, component, chunk, n, level, c, d = (block.column(x).to_numpy() for x in ("rep", "component", "chunk", "n", "level", "c", "d"))
    bits = lambda x, rows: np.frombuffer(b"".join(block.column(x).take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1)
    bands = bits("bands", np.arange(len(rep)))
    band, across = block.column("band")[0].as_py(), block.column("lo")[0].as_py() != block.column("hi")[0].as_py()
    firsts, seconds = [], []
    for at in np.unique(level):
        one = np.flatnonzero(level == at)
        below = np.flatnonzero((level == at - 1) & (d > 0))
        rows = np.concatenate((one, below))
        words = np.concatenate((bits("own", one), bits("next", below))) if len(below) else bits("own", one)
        count = np.concatenate((c[one], d[below])).astype(float)
        for k, i in enumerate(one):
            may = np.flatnonzero((component[rows[k + 1 :]] != component[i]) & (np.minimum(n[rows[k + 1 :]], n[i]) * whole >= np.maximum(n[rows[k + 1 :]], n[i]) * part)) + k + 1
            if across:
                may = may[chunk[rows[may]] != chunk[i]]
            if not len(may):
                continue
            differing = np.bitwise_count(words[may] ^ words[k]).sum(1, dtype=np.int64)
            most = (count[may] + count[k]) * ((whole - part) / (whole + part))  # of a link's symmetric difference
            expected = SKETCH_BITS / 2 * (1 - np.exp(-2.0 / SKETCH_BITS * most))
            spread = np.sqrt(2 * most * most / SKETCH_BITS + (1.5 * most if at else 0.0) + 1)
            other = rows[may[differing <= expected + 6 * spread]]
            other = other[(bands[other] == bands[i]).argmax(1) == band]
            firsts.append(np.full(len(other), rep[i])), seconds.append(rep[other])
    x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (firsts, seconds))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def across_components(members: DataFrame, labels: DataFrame, sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) that may be linked, of members (bucket, band, rep) of one bucket that are in different components."""
    labelled = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component"))
    kinds = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("home")).where("kinds > 1")
    chunks = lambda n: F.ceil(n / chunk).cast("int")
    mixed = Stage(mixed.select("bucket", F.col("home.component").alias("home"), chunks(F.col("home.n")).alias("inner"), chunks(F.col("n") - F.col("home.n")).alias("outer")), "mixed")
    some = labelled.join(checked(mixed.df), "bucket")
    spot, inside, last = F.xxhash64("rep"), F.col("component") == F.col("home"), F.col("inner") + F.col("outer") - 1
    some = some.withColumn("chunk", F.when(inside, F.pmod(spot, F.col("inner"))).otherwise(F.col("inner") + F.pmod(spot, F.col("outer"))).cast("int"))
    some = some.withColumn("partners", F.when(inside, F.sequence(F.col("inner"), last)).otherwise(F.sequence(F.lit(0), last)))
    some = some.select("bucket", "band", "rep", "component", "chunk", "partners").join(sets.drop("hashes"), "rep")
    some = some.withColumn("partner", F.explode("partners")).drop("partners")
    blocks = some.select(F.least("chunk", "partner").alias("lo"), F.greatest("chunk", "partner").alias("hi"), *[x for x in some.columns if x != "partner"])
    key = ["bucket", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the block that the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = np.column_stack([rows.column(x).to_numpy() for x in key])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)]
            for start, end in zip(cuts, cuts[1:]):
                yield compared(rows.slice(start, end - start).combine_chunks())
            held = rows.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield compared(held.combine_chunks())

    return few_files(blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long"))


def classes(docs: DataFrame, bands: int = BANDS, width: int = BINS_PER_BAND, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, n_shingles and component (the least row that links reach) of every row of `docs`."""
    docs = settled(docs)
    signed = Stage(signatures(docs, bands, width), "signatures")
    firsts = Stage(signed.df.where("words is not null").groupBy("words").agg(F.min("row").alias("rep")), "representatives")
    keyed = signed.df.select("row", "doc_id", "n_shingles", F.coalesce("words", F.col("row").cast("string").cast("binary")).alias("words"))  # no row waits for a null
    labels = Stage(keyed.join(firsts.df, "words", "left").select("row", "doc_id", "n_shingles", F.coalesce("rep", "row").alias("rep")), "named")
    own = signed.df.join(checked(firsts.df.select(F.col("rep").alias("row"))), "row", "left_semi").select(F.col("row").alias("rep"), F.posexplode("bands").alias("band", "bucket"))
    sizes = Stage(few_files(own.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")), "buckets")
    members = Stage(own.join(checked(sizes.df), "bucket").select("bucket", "band", "rep", "hub", "n"), "members")
    wanted = Stage(members.df.select("rep").distinct(), "wanted")
    sets = sets_of(docs, wanted.df, bands, width)
    for done in (signed, firsts, sizes, wanted):
        done.drop()

    stars = Stage(members.df.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    first_links = Stage(confirm(stars.df, sets.df), "links")
    found = components(first_links.df)
    # with two members, the star is all there is
    pairs = Stage(across_components(members.df.where("n > 2"), found.df, sets.df, chunk), "pairs")
    more = Stage(confirm(pairs.df, sets.df), "links")
    if not more.df.isEmpty():
        found = extended(found.df, more.df)
    for done in (members, sets, stars, first_links, pairs, more):
        done.drop()
    out = labels.df.join(found.df.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("row", "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component"))


def decide(docs: DataFrame, bands: int = BANDS, width: int = BINS_PER_BAND, chunk: int = CHUNK) -> DataFrame:
    """What `near_duplicates` returns, and the number of each row of `docs` (__rasterloom_row of the settled frame)."""
    rows = Stage(classes(docs, bands, width, chunk), "classes").df
    rank = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    heads = Stage(rows.groupBy("component").agg(F.min(rank).alias("head")), "heads").df
    return rows.join(heads, "component").select("row", "doc_id", "n_shingles", F.col("head.b").alias("component_id"), (F.col("row") == F.col("head.c")).alias("kept"))


def near_duplicates(docs: DataFrame, bands: int = BANDS, width: int = BINS_PER_BAND, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; the set is the distinct 5-word shingles of the whole text, or all
    words as one with fewer; null and empty texts have an empty set and stand alone. component_id is the least doc_id that
    links reach. Repeated rows are in one component and only the first row of its least doc_id is kept; a null id is
    greater than any other. An empty table gives no rows; other columns aren't looked at. Sets are held as
    64-bit hashes of the shingles: two different shingles of a pair of 10,000 shingles each agree with a chance of 5e-12.
    """
    return decide(docs, bands, width, chunk).drop("row")
