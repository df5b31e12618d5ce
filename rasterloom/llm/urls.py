"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list entry is a host and a start of a path, with an action; it fits its host and all subdomains where the URL's path
starts with its path. The keys that could fit a URL are the suffixes of its host that have as many labels as some
listed host, each with the starts of its path that have the length of some listed path. They are probed in a blocked Bloom filter (a block of four words of 64 bits for each key, eight
bits set in it); possible hits go to a hash join with the list, which removes false positives. The longest entry wins.

The filter's blocks are a table of at most bits_per_key / 256 rows for each entry; blocks and list are broadcast only up to
`most_broadcast` entries, and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Odd constants that draw a bit of a block for each of eight probes.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def probes(mark: Column) -> list[Column]:
    """Masks of the four words of a block."""
    low = mark.bitwiseAND(F.lit(0x7FFFFFFF))  # times 32 bits, this stays below 2**63
    bits = [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int") for s in SALTS]
    one = F.lit(1).cast("long")
    return [F.expr("0L").bitwiseOR(F.call_function("shiftleft", one, bits[2 * w])).bitwiseOR(F.call_function("shiftleft", one, bits[2 * w + 1])) for w in range(4)]


def block_of(mark: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(mark, 32), F.lit(blocks)).cast("long")


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: int = 16, most_broadcast: int = 200_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`. `listed`: host, path, action.

    A null URL, or one without `://`, has an empty host and path and fits no entry. Repeated rows stay, a row for each; of
    entries of equal length the greater string wins; of repeated entries the greater action. An empty list lets all pass
    as `default`; an empty table gives no rows; other columns aren't looked at. A host of any length has as many keys as the list
    has label counts and path lengths.
    """
    rules = listed.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), F.length("path").alias("path_length"), F.size(F.split("host", r"\.")).alias("labels"), "action").groupBy("rule", "path_length", "labels").agg(F.max("action").alias("action"))
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())  # distinct lengths of paths, at most the longest
    labels = sorted(r[0] for r in rules.select("labels").distinct().collect())  # at most the labels of the longest host
    entries = rules.count()
    blocks = max(1, -(-entries * bits_per_key // 256))
    small = F.broadcast if entries <= most_broadcast else (lambda df: df)

    host, path = split_url(F.col(url_col).cast("string"))
    rows = settled(pages).select(F.col("__rasterloom_row").alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not entries:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    marked = rules.withColumn("mark", F.xxhash64("rule"))
    filled = marked.select(block_of(F.col("mark"), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(probes(F.col("mark")))])
    filled = filled.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])

    parts = F.split("host", r"\.")
    suffixes = F.filter(F.array(*[F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n))) for n in labels]), lambda s: s.isNotNull())
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    asked = rows.where(F.col("host") != "").select("row", F.explode(keys).alias("rule")).withColumn("mark", F.xxhash64("rule"))
    asked = asked.withColumn("block", block_of(F.col("mark"), blocks)).join(small(filled), "block")
    possible = asked
    for i, mask in enumerate(probes(F.col("mark"))):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    exact = possible.select("row", "rule").join(small(rules.select("rule", "action")), "rule")
    best = exact.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
