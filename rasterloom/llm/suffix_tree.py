"""Language-model scoring with a probabilistic suffix tree over words.

Contexts of up to `longest` words are candidates when they are seen often enough, and are retained when the distribution of
what follows them diverges from that of their suffix (the context without its first word; at last, the words' own
distribution) by more than chance would have it. Each retained context has its own next-word counts, smoothed towards its
suffix's distribution; a word is scored in the longest retained suffix of what stands before it.

How often is enough grows as the root of the corpus: a context needs `root` times the square root of all tokens. The tree
thus grows with the input, and no level has more than sqrt(tokens) / root contexts, which is the bound on what tasks and
driver hold of it: 8 million for the 1.5e13 words of 100 TB. Next-word counts are never gathered.

All counts are exact and over all training documents. Divergence is worked out from tables of summed counts. For scoring,
groups of neighbouring documents ask for every n-gram they need once, with their own count; the counts are summed by n-gram,
and sums that differ from a group's own come back to it. A common n-gram costs a row for each group, whatever its count, and
no table is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Stage, crc32_mod5, settled
from rasterloom.llm.hashing import hashes_at, mix

END = np.uint64(0x5EED0F7E871E9D01)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keys that are looked up at a time, rows of a batch that a task gives, and bytes of text that are made tokens at a time.
PLACED, BATCH, BYTES = 1 << 18, 1 << 17, 400_000
#: Keys are sorted by ranges of so many of their first bits, so that one range at a time is copied.
RANGE_BITS = 3


@dataclass
class Contexts:
    """Contexts of one length: their hashes, ascending, how often each is seen, and the place of its suffix among those that are
    one word shorter."""

    hashes: np.ndarray
    counts: np.ndarray
    suffix: np.ndarray

    def some(self, at: np.ndarray) -> Contexts:
        return Contexts(self.hashes[at], self.counts[at], self.suffix[at])


@dataclass
class TreeShape:
    """Training tokens, distinct ones, and the retained contexts of one word, two, and so on."""

    tokens: int = 0
    distinct: int = 0
    levels: list[Contexts] = field(default_factory=list)


@dataclass(frozen=True)
class Options:
    #: A context, and a follower by which divergence is judged, is seen at least max(least, root * sqrt(tokens)) times.
    root: float = 0.7
    least: int = 8
    #: Words of the longest contexts.
    longest: int = 3
    #: Least divergence, in nats a token, of a retained context, beyond what chance alone is expected to give.
    divergence: float = 0.02
    #: Counts that the suffix's distribution is worth, times the root of the context's own, by the context's length.
    prior: tuple[float, ...] = (40.0, 10.0, 10.0)
    #: Tokens of a group of documents.
    group_tokens: int = 2_500_000


def join(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * _STEP + word)


def place(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Where each x stands in an ascending array; -1 where it isn't there."""
    if not len(ordered):
        return np.full(len(x), -1)
    found = np.empty(len(x), np.int64)
    for i in range(0, len(x), PLACED):  # so that the arrays in between stay small
        part = x[i : i + PLACED]
        at = np.minimum(np.searchsorted(ordered, part), len(ordered) - 1)
        found[i : i + PLACED] = np.where(ordered[at] == part, at, -1)
    return found


def found_at(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Where each x stands in an ascending array that has all of them. They are looked up in their order, which keeps to the cache."""
    order = np.argsort(x)
    at = np.empty(len(x), np.int64)
    at[order] = np.searchsorted(ordered, x[order])
    return at


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of one row or of at most BYTES of text."""
    ends = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, BYTES + (ends[start - 1] if start else 0), "right")))
        yield batch.slice(start, end - start)
        start = end


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts (null is empty), each text's end after its words, and the number of tokens of each."""
    texts = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bounds, first = bounds - bounds[0], int(bounds[0])
    size = int(bounds[-1])
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(texts.buffers()[2], np.uint8, size, first)
    data |= ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)  # A-Z
    white = (data[:size] == 32) | ((data[:size] - np.uint8(9)) < 5)
    starting, ending = ~white, ~white
    starting[1:] &= white[:-1]
    ending[:-1] &= white[1:]
    for marks, at in ((starting, bounds[:-1][bounds[:-1] < size]), (ending, bounds[1:][bounds[1:] > 0] - 1)):
        marks[at] = ~white[at]  # no word goes on in the next text
    starts = np.flatnonzero(starting)
    before = np.searchsorted(starts, bounds[1:])
    return np.insert(hashes_at(data, starts, np.flatnonzero(ending) + 1 - starts), before, END), np.diff(before, prepend=0) + 1


class Grams:
    """The n-grams that end at each token. `one` has the words' own hashes, and `reach` the tokens before each in its document: an
    n-gram is whole where that is n - 1 or more."""

    def __init__(self, one: np.ndarray, counts: np.ndarray):
        self.one, self.counts = one, counts
        self.starts = np.concatenate(([0], counts.cumsum()[:-1])).astype(np.int64)[: len(counts)]

    @cached_property
    def reach(self) -> np.ndarray:
        return (np.arange(len(self.one)) - np.repeat(self.starts, self.counts)).astype(np.int32)

    def before(self, words: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the so many words before each of these tokens, which must have as many before them."""
        found = self.one[at - words]
        for k in range(words - 1, 0, -1):
            found = join(found, self.one[at - k])
        return found

    def needed(self, shape: TreeShape) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level, the tokens in its contexts, the places of these contexts, and the hashes of the n-grams that scoring
        looks up for them. A tree has the suffixes of its contexts, so what is in none of a level is in none of the next."""
        found: list[list] = [[] for _ in shape.levels]
        for start in range(0, len(self.one), PLACED):  # so that the arrays in between stay small
            inside = np.arange(start, min(start + PLACED, len(self.one)))
            for d, level in enumerate(shape.levels, 1):
                inside = inside[self.reach[inside] >= d]
                before = self.before(d, inside)
                at = place(before, level.hashes)
                chosen = at >= 0
                inside = inside[chosen]
                found[d - 1].append((inside, at[chosen], join(before[chosen], self.one[inside])))
        return [tuple(map(np.concatenate, zip(*parts))) for parts in found]

    def parts(self) -> Iterator[tuple[slice, Grams]]:
        """Ranges of documents with their n-grams, each of one document or of at most PLACED tokens."""
        bounds = np.append(self.starts, len(self.one))
        first = 0
        while first < len(self.counts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PLACED, "right")) - 1)
            yield slice(first, last), Grams(self.one[bounds[first] : bounds[last]], self.counts[first:last])
            first = last

    def tallied(self, shape: TreeShape, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of all tokens and of those in contexts, ascending, and how often each is in a training document (`training`
        has a flag for each document)."""
        trained, others = [], []
        for documents, grams in self.parts():
            flags = np.repeat(training[documents], grams.counts)
            for keys, mine in ((grams.one, flags), *((key, flags[inside]) for inside, _, key in grams.needed(shape))):
                trained.append(np.sort(keys[mine]))
                others.append(distinct_keys(keys[~mine]))
        tops = np.arange(1, 1 << RANGE_BITS, dtype=np.uint64) << np.uint64(64 - RANGE_BITS)
        ranges = lambda parts: zip(*(np.split(keys, np.searchsorted(keys, tops)) for keys in parts))
        found, counts = [], []
        for mine, rest in zip(ranges(trained), ranges(others)):
            seen, n = np.unique(np.concatenate(mine), return_counts=True)
            found.append(distinct_keys(np.concatenate([seen, *rest])))
            counts.append(np.zeros(len(found[-1]), np.int64))
            counts[-1][np.searchsorted(found[-1], seen)] = n
        return np.concatenate(found), np.concatenate(counts)


def distinct_keys(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending; sorts the array given."""
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def gathered_grams(held: list) -> Grams:
    """Of the parts that tokens_of gave; empties the list."""
    one, counts = map(np.concatenate, zip(*held))
    held.clear()
    return Grams(one, counts)


def in_batches(keys: np.ndarray, n: np.ndarray, **same: int) -> Iterator[pa.RecordBatch]:
    """key, the columns that have the same value in all rows, and n."""
    for start in range(0, len(keys), BATCH):
        key, count = keys[start : start + BATCH].view(np.int64), n[start : start + BATCH].astype(np.int64)
        yield pa.RecordBatch.from_pydict({"key": pa.array(key), **{name: pa.array(np.full(len(key), value, np.int64)) for name, value in same.items()}, "n": pa.array(count)})


def counted(rows: DataFrame, keys: Callable[[Grams], np.ndarray], options: Options) -> DataFrame:
    """key, n: how often each key of the training documents' tokens occurs. Blocks fold what they have of a key into one row,
    and leave none out."""

    def count(held: list) -> Iterator[pa.RecordBatch]:
        return in_batches(*np.unique(np.concatenate([keys(grams) for _, grams in gathered_grams(held).parts()]), return_counts=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            for piece in pieces_of(batch):
                held.append(tokens_of(piece.column("text")))
                size += len(held[-1][0])
                if size >= options.group_tokens:
                    yield from count(held)
                    size = 0
        if held:
            yield from count(held)

    return rows.where(~F.col("held_out")).select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a frame that is bounded by sqrt(tokens) / root rows, by key."""
    found = df.select("key", "n").toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys.view(np.uint64))
    return keys[order], n[order]


def diverging(counts: DataFrame, shorter: DataFrame | None, level: Contexts, below: Contexts | None, words: np.ndarray, shares: np.ndarray, options: Options) -> np.ndarray:
    """Places of the contexts whose followers diverge from those of their suffix. counts, shorter: key (place of the context, times
    the number of words, and place of the follower among the words) and n, of the level and of the one below."""
    own = level.counts

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            context, follower = key // len(words), key % len(words)
            p = batch.column("n").to_numpy() / own[context]
            up, q = (np.zeros(len(key), np.int64), shares[follower]) if below is None else (level.suffix[context] * len(words) + follower, 1 / below.counts[level.suffix[context]])
            yield pa.RecordBatch.from_arrays([pa.array(context.astype(np.int64)), pa.array(p), pa.array(up.astype(np.int64)), pa.array(q)], names=["context", "p", "up", "q"])

    rows = counts.mapInArrow(facts, "context long, p double, up long, q double")
    if shorter is not None:
        rows = rows.join(shorter.select(F.col("key").alias("up"), F.col("n").alias("m")), "up").withColumn("q", F.col("q") * F.col("m"))
    sums = rows.groupBy("context").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("d"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.count("*").alias("k"))
    found = sums.toArrow()  # a row for each context
    context, d, p, q, k = (found.column(c).to_numpy() for c in ("context", "d", "p", "q", "k"))
    rest_p, rest_q = np.maximum(1 - p, 1e-9), np.maximum(1 - q, 1e-9)
    # chance alone is expected to give half the number of followers, over the count
    beyond = d + rest_p * np.log(rest_p / rest_q) - k / (2 * own[context])
    return np.sort(context[np.round(beyond, 9) >= options.divergence])


def learn_shape(rows: DataFrame, options: Options) -> TreeShape:
    """Counts all training words, and then, while there are common contexts, which of the common words follow them; common
    n-grams are the next contexts. An n-gram occurs no more often than its parts, so none is missed."""
    stage = Stage(counted(rows, lambda g: g.one, options), "word-counts")
    tokens, distinct = stage.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(options.least, options.root * tokens**0.5)
    keys, n = gathered(stage.df.where(F.col("n") >= least))
    stage.drop()
    words = keys.view(np.uint64)
    shares = n / max(tokens, 1)
    at = np.flatnonzero(words != END)
    levels, kept, tables = [Contexts(words[at], n[at], np.zeros(len(at), np.int64))], [], []
    while len(levels[-1].hashes):
        d, level = len(levels), levels[-1]
        ordered = level.hashes

        def followers(grams: Grams) -> np.ndarray:
            follower = place(grams.one, words)
            common = follower >= 0
            whole = common & (grams.reach >= d)
            for k in range(1, d + 1):  # a context has common words only
                whole[k:] &= common[:-k]
            at = np.flatnonzero(whole)
            context = place(grams.before(d, at), ordered)
            return context[context >= 0] * len(words) + follower[at[context >= 0]]

        tables.append(Stage(counted(rows, followers, options), "followers"))
        below = levels[-2] if d > 1 else None
        kept.append(diverging(tables[-1].df, tables[-2].df if d > 1 else None, level, below, words, shares, options))
        if d == options.longest:
            break
        keys, n = gathered(tables[-1].df.where(F.col("n") >= least))
        context, follower = keys // len(words), keys % len(words)
        go = np.flatnonzero(words[follower] != END)
        context, follower, n = context[go], follower[go], n[go]
        suffix = words[follower] if d == 1 else join(below.hashes[level.suffix[context]], words[follower])
        more = Contexts(join(level.hashes[context], words[follower]), n, place(suffix, level.hashes))
        levels.append(more.some(np.argsort(more.hashes)))
    for table in tables:
        table.drop()
    for d in range(len(kept) - 1, 0, -1):  # a tree has the suffixes of its contexts
        kept[d - 1] = np.union1d(kept[d - 1], levels[d].suffix[kept[d]])
    return TreeShape(int(tokens), int(distinct), [level.some(at) for level, at in zip(levels, kept) if len(at)])


def score_documents(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_context of every row of `docs` (doc_id, text).

    Learns from the rows whose crc32(doc_id as text) mod 5 isn't 1. Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased,
    and one end. base_score: the words' own smoothed distribution; score: the tree's log10 probability of the whole text;
    n_context: tokens scored in a retained context. Null and empty texts are one end; a null id counts as the empty id;
    repeated rows stay (and train, each); without training rows all words are unknown; an empty table gives no rows; other
    columns aren't looked at. Ids are whole numbers, or texts of them.
    """
    rows = settled(docs).select(F.col("__rasterloom_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", crc32_mod5("doc_id") == 1)
    shape = learn_shape(rows, options)
    # neighbours in a file are a group, of as many rows as have so many tokens on the average
    size = max(1, round(options.group_tokens * rows.count() / max(1, shape.tokens * 1.25)))
    dealt = rows.select(F.expr(f"row div {size}L").alias("dealt"), "doc_id", "text", "held_out")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, training, tokens = None, [], [], 0

        def asked() -> Iterator[pa.RecordBatch]:
            grams = gathered_grams(held)
            keys, n = grams.tallied(shape, np.concatenate(training))
            del grams
            return in_batches(keys, n, dealt=group)

        for batch in batches:
            for piece in pieces_of(batch):
                groups, texts, trains = piece.column("dealt").to_numpy(), piece.column("text"), ~piece.column("held_out").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1), len(groups)]
                for start, end in zip(cuts, cuts[1:]):
                    if held and (groups[start] != group or tokens >= options.group_tokens):
                        yield from asked()
                        training, tokens = [], 0
                    group = groups[start]
                    held.append(tokens_of(texts[start:end])), training.append(trains[start:end])
                    tokens += len(held[-1][0])
        if held:
            yield from asked()

    questions = dealt.select("dealt", "text", "held_out").mapInArrow(ask, "key long, dealt long, n long")
    # a key has a row for each group, or two where a scan cuts a group
    summed = questions.withColumn("total", F.sum("n").over(Window.partitionBy("key"))).where("total <> n").select("dealt", "key", "total")

    def score(documents: pa.Table, answers: pa.Table) -> pa.Table:
        grams = gathered_grams([tokens_of(piece.column("text")) for batch in documents.to_batches() for piece in pieces_of(batch)])
        keys, n = grams.tallied(shape, ~documents.column("held_out").to_numpy())
        for batch in answers.to_batches():
            n[found_at(batch.column("key").to_numpy().view(np.uint64), keys)] = batch.column("total").to_numpy()
        find = lambda x: n[found_at(x, keys)]
        sums = []
        for _, part in grams.parts():
            count = find(part.one)
            p = (count + 0.5) / (shape.tokens + 0.5 * (shape.distinct + 1))
            base = np.log10(p)
            known = np.zeros(len(p), bool)
            for d, (level, (inside, at, key)) in enumerate(zip(shape.levels, part.needed(shape)), 1):
                own = level.counts[at]
                worth = options.prior[min(d, len(options.prior)) - 1] * np.sqrt(own)
                p[inside] = (find(key) + worth * p[inside]) / (own + worth)
                known[inside] = True
            sums.append([np.add.reduceat(x, part.starts) for x in ((count > 0).astype(np.int64), base, np.log10(p), known.astype(np.int64))])
        n_known, base, total, n_context = map(np.concatenate, zip(*sums))
        return pa.table({
            "doc_id": documents.column("doc_id"), "held_out": documents.column("held_out"), "n_tokens": pa.array(grams.counts.astype(np.int64)), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(grams.counts), shape.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(total), "n_context": pa.array(n_context),
        })

    def scored(documents: pa.Table, answers: pa.Table) -> pa.Table:
        return score(documents, answers) if documents.num_rows else EMPTY

    EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()), "n_context": pa.array([], pa.int64())})
    return dealt.groupBy("dealt").cogroup(summed.groupBy("dealt")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_context long")
