"""The trie of conversations' beginnings.

A conversation's digest at depth d stands for its first d turns; the node of those turns is owned by the least conversation with
that digest. As members only get fewer with depth, a conversation owns the depths from some first one up to its length, its chain.
Minima over digests are worked out once; all conversations then look for their first owned depth at the same time, by a binary
search whose every step joins their probes to the digests and to the minima. A chain hangs on the node that owns its
turns but the last one before it, and what chains gather from those below is summed by doubling the distance, so the number of
rounds grows with the logarithm of the tree's height. Nothing is as long as a conversation or as wide as a node in one task: turns
are numbered over ranges, digests chained and sums run in blocks, blocks of blocks and so on, and the ids that end at a node
are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Stage

#: Turns, or blocks of them, whose digests are chained in one group.
CHAIN_BLOCK = 256
#: Depths whose sums run in one group.
SUM_BLOCK = 4096
#: Of this many conversations, the one with the round id lends the first turns.
FAMILY, MOST_LENT = 100, 5
NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> Stage:
    """c (conv_id), pos (from 1, by turn, nulls first, then role and text), digest and size (code points of the text) of every turn.

    Turns are sorted by ranges, so a long conversation lies in several partitions; its places are what its earlier ones count. Roles
    and texts enter the ranges by their first characters only."""
    order = ["c", F.col("turn").asc_nulls_first()]
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    head = F.when(F.length("role") < 32, F.substring("text", 1, 32)).otherwise("")
    ranged = rows.repartitionByRange(*order, F.substring("role", 1, 32), head).sortWithinPartitions(*order, "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    placed = Stage(ranged.select("c", digest.alias("digest"), F.length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33).alias("part")
    counts = placed.df.groupBy("c", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("c", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first") + 1).alias("shift"))
    out = Stage(placed.df.withColumn("part", part).join(starts, ["c", "part"]).select("c", (F.col("at") + F.col("shift")).alias("pos"), "digest", "size"), "numbered-turns")
    placed.drop()
    return out


def lent(c: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return F.crc32(c.cast("string").cast("binary")) % (MOST_LENT + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d, digest, size) of the rebuilt conversations, and every conversation with its length."""
    counts = turns.groupBy("c").agg(F.count("*").alias("n"))
    convs = counts.select("c", "n", lent(F.col("c")).alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("b"))
    convs = convs.join(counts.select(F.col("c").alias("b"), F.col("n").alias("base")), "b", "left").withColumn("taken", F.least("h", F.coalesce("base", F.lit(0))))
    own = turns.where(F.col("pos") > lent(F.col("c"))).join(convs.select("c", (F.col("taken") - F.col("h")).alias("shift")), "c")
    firsts = turns.where(F.col("pos") <= MOST_LENT).select(F.col("c").alias("b"), F.col("pos").alias("d"), "digest", "size")
    begun = convs.where("taken > 0").join(firsts, "b").where("d <= taken")
    both = own.select("c", (F.col("pos") + F.col("shift")).alias("d"), "digest", "size").unionByName(begun.select("c", "d", "digest", "size"))
    return both, convs.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def chained(rows: DataFrame, longest: int, block: int = CHAIN_BLOCK) -> DataFrame:
    """Rows (c, i from 0, digest, size) with the digest of all up to theirs: SHA-256 chained within a block, after the digest of all
    earlier blocks, which is found in the same way."""
    blocks = rows.groupBy("c", F.expr(f"i div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "digest", "size"))).alias("items"))  # at most `block`
    step = lambda done, x: F.concat(done, F.array(F.unhex(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(b"")), x.digest), 256))))
    blocks = blocks.withColumn("chain", F.aggregate("items", F.array().cast("array<binary>"), step))
    if longest <= block:
        return blocks.select("c", F.explode(F.arrays_zip("items", "chain")).alias("x")).select("c", "x.items.i", F.col("x.chain").alias("digest"), "x.items.size")
    kept = Stage(blocks, "chains").df
    whole = chained(kept.select("c", F.col("block").alias("i"), F.element_at("chain", -1).alias("digest"), F.lit(0).cast("long").alias("size")), -(-longest // block), block)
    after = kept.join(whole.select("c", (F.col("i") + 1).alias("block"), F.col("digest").alias("start")), ["c", "block"], "left")
    flat = after.select("c", "start", F.explode(F.arrays_zip("items", "chain")).alias("x"))
    joined = F.when(F.col("start").isNull(), F.col("x.chain")).otherwise(F.unhex(F.sha2(F.concat("start", "x.chain"), 256)))
    return flat.select("c", "x.items.i", joined.alias("digest"), "x.items.size")


def first_owned(lengths: DataFrame, digests: DataFrame, minima: DataFrame, longest: int) -> Stage:
    """c, length and the first depth at which c is the least with its digest (length + 1: none)."""
    state = Stage(lengths.select("c", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high")), "search")
    for _ in range(int(longest).bit_length()):  # depths 1 to longest + 1
        asked = state.df.where("low < high").withColumn("d", F.expr("(low + high) div 2"))
        found = asked.join(digests, ["c", "d"]).join(minima.select("d", "digest", "owner"), ["d", "digest"])
        owns = F.col("owner") == F.col("c")
        moved = found.select("c", "length", F.when(owns, F.col("low")).otherwise(F.col("d") + 1).alias("low"), F.when(owns, F.col("d")).otherwise(F.col("high")).alias("high"))
        after = Stage(moved.unionByName(state.df.where("low >= high")), "search")
        state.drop()
        state = after
    return state


def gathered(chains: DataFrame) -> Stage:
    """o, w and leaves of each chain with those of all chains below it, from (o, up, w, leaves)."""
    state = Stage(chains, "gathered")
    while not state.df.where("up is not null").isEmpty():
        below = state.df.where("up is not null").groupBy(F.col("up").alias("o")).agg(F.sum("w").alias("more"), F.sum("leaves").alias("more_leaves"))
        further = state.df.select(F.col("o").alias("up"), F.col("up").alias("next"))
        after = state.df.join(below, "o", "left").join(further, "up", "left")
        step = Stage(after.select("o", F.col("next").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")), "gathered")
        state.drop()
        state = step
    return state


def sums_below(rows: DataFrame, longest: int, columns: list[str], block: int = SUM_BLOCK) -> DataFrame:
    """Rows (o, d, ...) with each column's sum over the depths of o from d on."""
    place = F.expr(f"d div {block}")
    down = Window.partitionBy("o", place).orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({c: F.sum(c).over(down) for c in columns})
    if longest < block:
        return inside
    totals = rows.groupBy("o", place.alias("d")).agg(*[F.sum(c).alias(c) for c in columns])
    beyond = sums_below(totals, longest // block, columns, block).select("o", (F.col("d") - 1).alias("__block"), *[F.col(c).alias(f"__{c}") for c in columns])
    # the next block that a chain has is the one after, as a chain has all its depths
    joined = inside.withColumn("__block", place).join(beyond, ["o", "__block"], "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in columns}).drop("__block", *[f"__{c}" for c in columns])


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (o, d, c) in order: o, d, c of the first and the ids c in decimals, a row for each node in a batch."""
    for batch in batches:
        o, d, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (d[1:] != d[:-1])))) if len(o) else np.empty(0, int)
        ids = [",".join(map(str, c[a:b].tolist())) for a, b in zip(starts, np.append(starts[1:], len(c)))]
        yield pa.record_batch([pa.array(o[starts]), pa.array(d[starts]), pa.array(c[starts]), pa.array(ids, pa.string())], names=["o", "d", "first", "ids"])


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (o, d, first, ids) in order: o, d and the SHA-256 of a node's ids, as a stream."""
    key, state = None, None
    row = lambda: pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["o", "d", "ends"])
    for batch in batches:
        for o, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            if key != (o, d):
                if key is not None:
                    yield row()
                key, state = (o, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if key is not None:
        yield row()


def ends(members: DataFrame) -> DataFrame:
    """o, d and the SHA-256 of the ids c of members (o, d, c) in ascending order, comma-joined."""
    order = ["o", "d", "c"]
    ids = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined_ids, "o long, d long, first long, ids string")
    return ids.repartition("o", "d").sortWithinPartitions("o", "d", "first").mapInArrow(hashed_ids, "o long, d long, ends string")


def prefix_trie(conversations: DataFrame, block: int = CHAIN_BLOCK, sum_block: int = SUM_BLOCK) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations (conv_id, turn, role, text), the textless root
    included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c takes the first h turns of conversation c - c % 100 (all if there are fewer, none if it is absent) and goes on
    with its own after its first h, h = crc32(c in decimals) % 6. Turns are in the order of turn (null first), then of role and text;
    null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns
    each. A conversation left without turns is a member of the root. An empty table gives no rows, not even the root. Other
    columns aren't looked at. block and sum_block change the work, never the result.
    """
    turns = numbered_turns(conversations)
    rows, lengths = rebuilt(turns.df)
    lengths = Stage(lengths, "lengths")
    longest, root, n_convs = lengths.df.agg(F.max("length"), F.min("c"), F.count("*")).first()
    longest = longest or 0
    digests = Stage(chained(rows.select("c", (F.col("d") - 1).alias("i"), "digest", "size"), longest, block).select("c", (F.col("i") + 1).alias("d"), "digest", "size"), "digests")
    turns.drop()
    minima = Stage(digests.df.groupBy("d", "digest").agg(F.min("c").alias("owner"), F.count("*").alias("n_convs"), F.min("size").alias("size")), "minima")
    probes = digests.df.select("c", "d", "digest")
    search = first_owned(lengths.df, probes, minima.df, longest)
    found = search.df.select("c", "length", F.when(F.col("c") == root, 0).otherwise(F.col("low")).cast("long").alias("first"))
    # who owns the node before the first owned one; at depth 0 the root's owner does
    above = found.where("first > 1").withColumn("d", F.col("first") - 1).join(probes, ["c", "d"]).join(minima.df.select("d", "digest", "owner"), ["d", "digest"]).select("c", "owner")
    up = F.when(F.col("first") == 1, F.lit(root).cast("long")).when(F.col("first") > 1, F.col("owner"))
    placed = Stage(found.join(above, "c", "left").select("c", "length", "first", up.alias("up")), "chains")
    chains = placed.df.where("first <= length or first = 0").select(F.col("c").alias("o"), "length", "first", "up")
    below = chains.where("up is not null").select("o", F.col("up").alias("at"), (F.col("first") - 1).alias("d"))
    spark = conversations.sparkSession
    top = spark.createDataFrame([] if root is None else [(root, 0, n_convs, 0)], "o long, d long, n_convs long, size long")
    nodes = minima.df.select(F.col("owner").alias("o"), "d", "n_convs", "size").unionByName(top).withColumn("w", (F.col("n_convs") - 1) * F.col("size"))
    ended = below.select(F.col("at").alias("o"), F.col("d").alias("length")).distinct().withColumn("leaves", F.lit(0))
    weights = nodes.groupBy("o").agg(F.sum("w").alias("w"))
    begun = chains.join(weights, "o").join(ended, ["o", "length"], "left").select("o", "up", "w", F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"))
    totals = gathered(begun)
    hung = below.join(totals.df.select("o", "w", "leaves"), "o").groupBy(F.col("at").alias("o"), "d").agg(F.count("*").alias("hung"), F.sum("w").alias("hung_w"), F.sum("leaves").alias("hung_leaves"))
    full = nodes.join(hung, ["o", "d"], "left").join(chains, "o")
    last = F.col("d") == F.col("length")
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = full.withColumns({"n_children": zero("hung") + F.when(last, 0).otherwise(1), "saved": F.col("w") + zero("hung_w"), "leaves": zero("hung_leaves") + F.when(last & F.col("hung").isNull(), 1).otherwise(0)})
    summed = sums_below(full.select("o", "d", "first", "up", "n_convs", "n_children", "saved", "leaves"), longest, ["saved", "leaves"], sum_block)
    closed = placed.df.select("c", F.col("length").alias("d"), F.when((F.col("first") <= F.col("length")) | (F.col("first") == 0), F.col("c")).otherwise(F.col("up")).alias("o"))
    out = summed.join(ends(closed), ["o", "d"], "left").select(
        F.col("o").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("first"), F.col("o")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    result = Stage(out, "prefix-trie")
    for stage in (lengths, digests, minima, search, placed, totals):
        stage.drop()
    return result.df
