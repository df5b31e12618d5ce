"""Source divergence audit: how each source's use of terms departs from its language's and from other sources'.

Terms are counted within tasks and summed once, dealt out by language and term, where a term's documents, total and number
of sources are known beside its counts. What a pair of sources differs by is mostly decided by terms that either of
them lacks, whose share is the same for all of a source: the sum over all terms is that of two such baselines, corrected for terms
of one source (which depend on their count alone, so a histogram of counts serves) and again for terms of both, worked out for
each term among the sources that have it. The most divergent terms of a group are found by radix select: histograms over some bits of
the values tell in which bin the kth lies, rows of lower bins go, and the next bits tell further; values equal to the kth
refine by bytes of their terms. What is put in order at last is k rows of a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Stage, broadcast_checked, white_slices

#: Terms of a group that are ranked, and documents of its language that a term must be in.
TOP, LEAST_DOCUMENTS = 200, 3
#: Shares are whole numbers of this unit.
UNIT = 1_000_000_000
#: Bits of a value, and bytes of a term, that one histogram covers.
RADIX_BITS, RADIX_BYTES = 12, 2
#: Distinct (language, source, term) that a task counts before it gives them on, and pairs of sources that one numpy pass takes.
MOST_COUNTED, MOST_PAIRS = 250_000, 1_000_000
GROUP = ["lang", "source"]

#: A-Z as a-z; letters and all bytes of other than ASCII characters as they are; everything else as a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (documents with the term), of parts of the documents."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def given(counters: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in counters.items():
            for keys in batched(counts, 20_000):
                columns = [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array([k.decode("utf-8", "replace") for k in keys], pa.string())]
                yield pa.record_batch([*columns, pa.array([counts[k] for k in keys], pa.int64()), pa.array([documents[k] for k in keys], pa.int64())], names=[*GROUP, "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                counts, documents = counters.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, seen = len(counts), set()
                for piece in white_slices(text.as_py().translate(_TERMS)):
                    words = piece.split()
                    counts.update(words)
                    seen.update(words)
                documents.update(seen)
                size += len(counts) - before
                if size >= MOST_COUNTED:
                    yield from given(counters)
                    counters, size = {}, 0
        yield from given(counters)

    return rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def kept_terms(docs: DataFrame, least: int) -> Stage:
    """lang, source, term, count of the terms that a language keeps, with the term's count in the language (total), its number of
    sources there, and whether this is the first of them (lead)."""
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = sums.select("*", F.sum("docs").over(term).alias("in_docs"), F.sum("count").over(term).alias("total"), F.count("*").over(term).alias("sources"), (F.min("source").over(term) == F.col("source")).alias("lead"))
    return Stage(wide.where(F.col("in_docs") >= least).drop("docs", "in_docs"), "terms")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact beyond 64 bits."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return (F.expr("1L") + F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most UNIT + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def apart_in_numpy(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def both_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, term, source, p, p0) in order of language and term: what pairs of sources (source, item) are to be corrected by for
    terms that both have, in parts. A term's rows may go on in the next batch."""
    rest: pa.Table | None = None
    columns = ["lang", "term", "source", "p", "p0"]

    def corrected(table: pa.Table) -> Iterator[pa.RecordBatch]:
        source = table.column("source").combine_chunks().dictionary_encode()
        lang = table.column("lang").combine_chunks().dictionary_encode()
        s, g = source.indices.to_numpy(zero_copy_only=False).astype(np.int64), lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        p, p0 = (table.column(c).to_numpy() for c in ("p", "p0"))
        starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (g[1:] != g[:-1]))))
        sizes = np.diff(np.append(starts, len(term)))
        first, many = np.repeat(starts, sizes), np.repeat(sizes, sizes)  # of each row: its term's first row and rows
        ends = np.cumsum(many)
        n_sources = len(source.dictionary)
        at = 0
        while at < len(term):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, "right")))
            rows = np.arange(at, upto)
            left = np.repeat(rows, many[rows])
            begin = np.cumsum(many[rows]) - many[rows]
            right = np.arange(len(left)) - np.repeat(begin, many[rows]) + first[left]
            left, right = left[left != right], right[left != right]
            at = upto
            if not len(left):
                continue
            value = apart_in_numpy(p[left], p[right]) - apart_in_numpy(p[left], p0[right]) - apart_in_numpy(p0[left], p[right]) + apart_in_numpy(p0[left], p0[right])
            key = (g[left] * n_sources + s[left]) * n_sources + s[right]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            key, value = key[new], np.add.reduceat(value, new)
            yield pa.record_batch([lang.dictionary.take(pa.array(key // (n_sources * n_sources))), source.dictionary.take(pa.array(key // n_sources % n_sources)), source.dictionary.take(pa.array(key % n_sources)), pa.array(value)], names=["lang", "source", "item", "value"])

    for batch in batches:
        table = pa.Table.from_batches([batch]).select(columns)
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        # the last term may go on
        last, langs = table.column("term"), table.column("lang")
        n = table.num_rows - 1
        while n > 0 and last[n - 1].as_py() == last[-1].as_py() and langs[n - 1].as_py() == langs[-1].as_py():
            n -= 1
        if n:
            yield from corrected(table.slice(0, n))
        rest = table.slice(n)
    if rest is not None and rest.num_rows:
        yield from corrected(rest)


def pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language. terms: with p of the group and its p0; groups: with
    p0 and the language's number of terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.join(broadcast_checked(other), "lang").where("source <> item").select("lang", "source", "item", (apart(F.col("p0"), F.col("q0")) * F.col("n_terms")).alias("value"))
    # terms of one count of a source have one share, so they are corrected together
    counts = terms.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    met = counts.join(broadcast_checked(other), "lang").where("source <> item")
    own, theirs = apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")), apart(F.col("q0"), F.col("p")) - apart(F.col("q0"), F.col("p0"))
    ways = F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("t"), (F.col("n") * own).alias("v")), F.struct(F.col("item").alias("s"), F.col("source").alias("t"), (F.col("n") * theirs).alias("v")))
    single = met.select("lang", F.explode(ways).alias("w")).select("lang", F.col("w.s").alias("source"), F.col("w.t").alias("item"), F.col("w.v").alias("value"))
    shared = terms.where("sources > 1").select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    double = shared.mapInArrow(both_terms, "lang string, source string, item string, value long")
    return base.unionByName(single).unionByName(double).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def narrowed(rows: DataFrame, state: DataFrame, digit: Column) -> tuple[Stage, DataFrame]:
    """One step of a radix select. rows: __in (whether the row is in the open bin of its group; else it is taken), state: the
    group and how many rows of its bin are wanted (need). `digit` orders rows of the bin, greater ones first. Rows that can't be among
    the wanted go; returned are the others and the new state, of groups whose bin holds more than is needed."""
    marked = rows.withColumn("__digit", F.when(F.col("__in"), digit))
    bins = marked.where("__in").groupBy(*GROUP, "__digit").agg(F.count("*").alias("__n")).join(broadcast_checked(state), GROUP)
    above = F.coalesce(F.sum("__n").over(Window.partitionBy(*GROUP).orderBy(F.col("__digit").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = bins.withColumn("__above", above).where((F.col("__above") < F.col("need")) & (F.col("__above") + F.col("__n") >= F.col("need")))
    found = Stage(cut.select(*GROUP, F.col("__digit").alias("__cut"), (F.col("need") - F.col("__above")).alias("need"), "__n"), "cuts")
    joined = marked.join(broadcast_checked(found.df.select(*GROUP, "__cut", (F.col("__n") > F.col("need")).alias("__open"))), GROUP, "left")
    left = joined.where(~F.col("__in") | (F.col("__digit") >= F.col("__cut")))
    # rows of a bin whose rows are all wanted are taken, like those of greater bins
    out = Stage(left.withColumn("__in", F.col("__in") & F.col("__open") & (F.col("__digit") == F.col("__cut"))).drop("__digit", "__cut", "__open"), "candidates")
    return out, found.df.where("__n > need").select(*GROUP, "need")


def top_terms(rows: DataFrame, k: int, bits: int = RADIX_BITS, width: int = RADIX_BYTES) -> DataFrame:
    """The k rows (lang, source, term, value) of each group with the greatest values, then the least terms in UTF-8. rows is a frame
    that is cheap to evaluate again; a group's terms are distinct and hold no zero byte."""
    sizes = Stage(rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.max("value").alias("most")), "candidate-counts").df
    greatest = sizes.agg(F.max("most")).first()[0] or 0
    whole = broadcast_checked(sizes.select(*GROUP, (F.col("n") > k).alias("__in")))
    state = sizes.where(F.col("n") > k).select(*GROUP, F.lit(k).cast("long").alias("need"))
    stage, open_rows = None, rows.join(whole, GROUP)

    def step(rows: DataFrame, digit: Column) -> None:
        nonlocal stage, state
        before = stage
        stage, state = narrowed(rows, state, digit)
        if before is not None:
            before.drop()

    shift = max(0, int(greatest).bit_length() - bits)
    while True:
        step(open_rows, F.shiftright("value", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        open_rows = stage.df
        if not shift:
            break
        shift = max(0, shift - bits)
    # all rows of an open bin have the kth value; bytes after what they share tell at least two of them apart
    while not state.isEmpty():
        term = F.col("term").cast("binary")
        ends = stage.df.where("__in").groupBy(*GROUP).agg(F.min(term).alias("a"), F.max(term).alias("b"))
        shared = Stage(ends.select(*GROUP, common_prefix(F.col("a"), F.col("b")).alias("__same")), "shared-bytes")
        known = stage.df.join(broadcast_checked(shared.df), GROUP, "left")
        piece = F.rpad(F.hex(F.substring(term, F.coalesce("__same", F.lit(0)) + 1, F.lit(width))), 2 * width, "0")
        step(known, -F.conv(piece, 16, 10).cast("long"))
        open_rows, before = Stage(stage.df.drop("__same"), "candidates"), stage
        stage = open_rows
        before.drop()
    return stage.df.drop("__in")


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two binary values share at their beginning."""
    a, b = F.hex(a), F.hex(b)
    short = F.least(F.length(a), F.length(b)) / 2
    steps = F.sequence(F.lit(1), F.greatest(short.cast("int"), F.lit(1)))
    differs = F.filter(steps, lambda i: F.substring(a, i * 2 - 1, F.lit(2)) != F.substring(b, i * 2 - 1, F.lit(2)))
    return F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, short.cast("int"))


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS, bits: int = RADIX_BITS) -> DataFrame:
    """lang, source, part, item, value and rank of every group (lang, source) of `docs` (text, lang, source).

    Null text, lang and source are empty. Terms are runs of ASCII letters (A-Z as a-z) and of other than ASCII characters; a
    language keeps those in at least `least` of its documents. In part `pair`, a row for each other source of the language and the sum of
    how far the group's shares are from that source's, all ranks; in part `term`, the terms that the group uses more than its language
    does, up to rank `top`. Of equal values the least item in UTF-8 comes first. Repeated rows are documents each; a source
    without terms has pairs; a language without terms has pairs of value 0; a language of one source has none; an empty table gives no
    rows. Other columns aren't looked at. bits changes the work, never the result.
    """
    kept = kept_terms(docs, least)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    langs = kept.df.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.sum(F.col("lead").cast("long")).alias("n_terms"))
    totals = kept.df.groupBy(*GROUP).agg(F.sum("count").alias("group_total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    facts = named.join(langs, "lang", "left").join(totals, GROUP, "left").select(*GROUP, *[zero(c).alias(c) for c in ("lang_total", "n_terms", "group_total")])
    # without terms nothing is shared out; a share of 1 on both sides gives 0
    groups = Stage(facts.withColumn("p0", F.when(F.col("n_terms") > 0, share(F.lit(0).cast("long"), F.col("group_total"), F.col("n_terms"))).otherwise(1)), "groups").df
    shares = kept.df.join(broadcast_checked(groups), GROUP)
    terms = Stage(shares.select(*GROUP, "term", "sources", share(F.col("count"), F.col("group_total"), F.col("n_terms")).alias("p"), "p0", share(F.col("total"), F.col("lang_total"), F.col("n_terms")).alias("q")), "shares")
    kept.drop()
    above = terms.df.where("p > q").select(*GROUP, "term", apart(F.col("p"), F.col("q")).alias("value"))
    rows = pairs(terms.df, groups).select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    rows = rows.unionByName(top_terms(above, top, bits).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    order = Window.partitionBy(*GROUP, "part").orderBy(F.col("value").desc(), "item")  # other sources, or k terms
    return rows.withColumn("rank", F.row_number().over(order))
