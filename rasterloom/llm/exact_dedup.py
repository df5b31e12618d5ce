"""Exact dedup by deterministic block naming, in DataFrame operations alone.

A text without white space is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered; the
number is the block's name. Names of adjacent blocks are paired, the distinct pairs sorted and numbered, and so on until a
document has one name, which with its number of blocks identifies its text: two texts share it only if they are equal.

To keep text out of all but one shuffle, blocks are grouped and sorted by a fingerprint and length, and each group carries
its least and greatest block. Where these agree, as they do but for a collision, the fingerprint has one block and its
place in the order is that block's name; a fingerprint with several blocks gets one name for each, by a join on the blocks
themselves. Names are thus free of collisions whatever the fingerprint is. Copies of a block are folded before the
shuffle, and joins to names are plain equi-joins of two exchanges, which adaptive execution splits where a name is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Stage, settled

BLOCK_BYTES = 4096
WHITE = r"[\x20\x09-\x0D]+"


def fingerprint(block: Column, bits: int = 64) -> Column:
    mark = F.xxhash64(block)
    return mark if bits >= 64 else F.pmod(mark, F.lit(1 << bits))


def blocks_of(docs: DataFrame, block_bytes: int, bits: int) -> DataFrame:
    """A row for each block: row (of the document), at, block, mark, size; the first block of a document also carries its
    facts (doc_id, n_chars, text_sha256, n_blocks)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = settled(docs).select(F.col("__rasterloom_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, WHITE, "").cast("binary").alias("data"))
    rows = rows.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / F.lit(block_bytes))).cast("int"))
    facts = F.struct("row", "doc_id", "n_chars", F.sha2("data", 256).alias("text_sha256"), "n_blocks")
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))
    exploded = rows.select("row", F.when(F.lit(True), facts).alias("facts"), F.posexplode(cut).alias("at", "block"))
    exploded = exploded.withColumn("facts", F.when(F.col("at") == 0, F.col("facts")))
    return exploded.select("row", "at", "facts", "block", fingerprint(F.col("block"), bits).alias("mark"), F.octet_length("block").alias("size"))


def numbered(keys: DataFrame, order: list[str], name: str) -> Stage:
    """Distinct keys, sorted, with their integer names."""
    return Stage(keys.orderBy(*order).withColumn("name", F.monotonically_increasing_id()), name)


def name_blocks(blocks: DataFrame) -> DataFrame:
    """row, at, facts, name of every block."""
    groups = blocks.groupBy("mark", "size").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    names = numbered(groups.select("mark", "size", (F.col("least") != F.col("most")).alias("shared")), ["mark", "size"], "block-names")
    plain = names.df
    found = blocks.drop("block").join(plain, ["mark", "size"])
    if plain.where("shared").isEmpty():
        return found.select("row", "at", "facts", "name")
    shared = plain.where("shared").select("mark", "size")
    apart = numbered(blocks.join(shared, ["mark", "size"], "left_semi").select("mark", "size", "block").distinct(), ["mark", "size", "block"], "shared-names").df
    several = blocks.join(shared, ["mark", "size"], "left_semi").join(apart, ["mark", "size", "block"])
    # even names for the plain ones, odd for the others: the two numberings can't meet
    return found.where(~F.col("shared")).select("row", "at", "facts", (F.col("name") * 2).alias("name")).unionByName(several.select("row", "at", "facts", (F.col("name") * 2 + 1).alias("name")))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """doc_id, n_chars, text_sha256 and identity (n_blocks, name) of every row."""
    level = Stage(name_blocks(blocks_of(docs, block_bytes, bits)), "named-blocks")
    done = [level.df.where("facts.n_blocks = 1").select("facts.*", "name")]
    longest = level.df.agg(F.max("facts.n_blocks")).first()[0] or 1
    open_rows = level.df.join(level.df.where("at = 1").select("row"), "row", "left_semi") if longest > 1 else None
    blocks = longest
    while blocks > 1:
        pair = open_rows.groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"), F.max("facts").alias("facts")
        )
        pairs = Stage(pair, "pairs")
        names = numbered(pairs.df.select("left", "right").distinct(), ["left", "right"], "pair-names")
        level = Stage(pairs.df.join(names.df, ["left", "right"]).select("row", "at", "facts", "name"), "named-pairs")
        pairs.drop()
        blocks = (blocks + 1) // 2
        open_rows = level.df
        if blocks == 1:
            done.append(level.df.select("facts.*", "name"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def decide(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """What `dedup` returns, and the number of each row of `docs` (__rasterloom_row of the settled frame)."""
    rank = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    rows = Stage(identities(docs, block_bytes, bits).withColumn("rank", rank), "identities").df
    groups = Stage(rows.groupBy("n_blocks", "name").agg(F.min("rank").alias("first"), F.count("*").alias("group_size")), "groups").df
    return rows.join(groups, ["n_blocks", "name"]).select("row", "doc_id", F.col("first.c").alias("keep_id"), "group_size", (F.col("rank") == F.col("first")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; the row with most code points in its original text, then
    with the smallest doc_id (null last), stays. Of repeated rows that tie in both, all are named by the same keep_id and
    one is kept. Null counts as the empty text; empty texts are a group of their own; an empty table gives no rows; other
    columns aren't looked at. block_bytes and bits change the work, never the result.
    """
    return decide(docs, block_bytes, bits).drop("row")
