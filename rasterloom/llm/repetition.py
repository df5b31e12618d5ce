"""Repetition of a text within itself: characters inside duplicated n-grams and lines.

Words become numbers, and hashes of all n-grams are rolled from those of n-1 in numpy: one multiplication and one addition
for each word. Where an n-gram occurs twice, the (n-1)-grams at its place and at the next do, so only such places are put in
order for the next length. Equal hashes are compared word for word; should two different n-grams share one, the places are
named exactly instead. A text is taken in slices, so what is held of it is a number for each word and its distinct words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import white_slices
from rasterloom.llm.hashing import mix

#: Window of the base rule, in words, and the most per cent of words in such windows found twice.
BASE_WIDTH, BASE_PERCENT, LEAST_WORDS = 5, 20, 10
#: Most per cent of the characters of words in the most frequent n-gram, by n.
MOST_TOP = {2: 20, 3: 18, 4: 16}
#: Most per cent of the characters of words in n-grams found twice or more, by n. The first of them counts too, so the shares are
#: twice those that are usual for later ones alone.
MOST_DUPLICATED = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Most per cent of the characters of words in lines equal to an earlier one.
MOST_LINE_CHARS = 20

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]
NAMES = [*COUNTS, *[f"top_{n}_chars" for n in MOST_TOP], *[f"dup_{n}_chars" for n in MOST_DUPLICATED]]


def numbered_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word in order, and the code points of each number's word."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts = [np.fromiter(map(numbers.__getitem__, piece.split()), np.int32) for piece in white_slices(data)]
    lengths = np.fromiter(map(len, b" ".join(numbers).decode("utf-8", "replace").split(" ")), np.int64)[: len(numbers)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32), lengths


def same_grams(words: np.ndarray, n: int, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of n-grams at the places `at`: the places in the order of their grams (and of the text within a gram), and where in that order a
    gram begins. `hashes` are of these places."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    left, right = at[order[:-1][~new[1:]]], at[order[1:][~new[1:]]]
    if any((words[left + j] != words[right + j]).any() for j in range(n)):
        grams = np.lib.stride_tricks.sliding_window_view(words, n)[at]
        named = np.unique(grams, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(named, kind="stable")
        new[1:] = named[order][1:] != named[order][:-1]
    return at[order], new


def covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Whether each word is in an n-gram that begins at one of the places."""
    edge = np.zeros(n_words + 1, np.int32)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def duplicated(words: np.ndarray, lengths: np.ndarray) -> dict[str, int]:
    """n_repeat_words, and characters in the most frequent and in duplicated n-grams (each word once)."""
    found = dict.fromkeys(NAMES[6:], 0)
    size = len(words)
    sizes = lengths[words]
    values = mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rolled, at = values, np.arange(size)
    for n in range(2, max(MOST_DUPLICATED) + 1):
        if n > size:
            break
        rolled = rolled[: size - n + 1] * np.uint64(0xD6E8FEB86659FD93) + values[n - 1 :]
        at = at[at <= size - n]
        placed, new = same_grams(words, n, mix(rolled[at]), at)
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(placed)))
        twice = np.repeat(counts > 1, counts)
        again = np.sort(placed[twice])
        if not len(again):
            break
        if n in MOST_TOP:
            often = starts[counts == counts.max()]
            chars = sum(sizes[placed[often] + j] for j in range(n))
            best = often[chars == chars.max()]
            best = best[np.argmin(placed[best])]  # of ties in both, the first in the text
            found[f"top_{n}_chars"] = int(sizes[covered(size, placed[best : best + counts.max()], n)].sum())
        if n == BASE_WIDTH or n in MOST_DUPLICATED:
            inside = covered(size, again, n)
            if n == BASE_WIDTH:
                found["n_repeat_words"] = int(inside.sum())
            if n in MOST_DUPLICATED:
                found[f"dup_{n}_chars"] = int(sizes[inside].sum())
        # an (n+1)-gram found twice has n-grams found twice at its place and at the next
        known = np.zeros(size + 1, bool)
        known[again] = True
        at = again[known[again + 1]]
    return found


def lines(data: bytes) -> tuple[int, int, int]:
    """Lines with a word; those equal to an earlier one; the code points of words in these."""
    seen, n, again, chars = set(), 0, 0, 0
    start = 0
    while start <= len(data):
        end = data.find(b"\n", start)
        line = data[start : end if end >= 0 else len(data)]
        start = end + 1 if end >= 0 else len(data) + 1
        if not line or line.isspace():
            continue
        n += 1
        if line in seen:
            again += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        else:
            seen.add(line)
    return n, again, chars


def measure(data: bytes) -> list[int]:
    """The counts of NAMES for one text."""
    words, lengths = numbered_words(data)
    n_lines, again, chars = lines(data)
    found = duplicated(words, lengths)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    first = {"n_words": len(words), "word_chars": int(lengths[words].sum()) if len(words) else 0, "n_symbols": symbols, "n_lines": n_lines, "n_dup_lines": again, "dup_line_chars": chars}
    return [(first | found)[name] for name in NAMES]


def measured(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id and the counts of NAMES for every row."""
    schema = pa.schema([(id_column, pa.int64()), *[(name, pa.int64()) for name in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text.as_py() or b"") for text in batch.column(1)]
            columns = np.array(rows, np.int64).reshape(-1, len(NAMES))
            yield pa.record_batch([batch.column(0), *[pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(NAMES))]], schema=schema)

    rows = docs.select(F.col(id_column).cast("long").alias(id_column), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"{id_column} long, " + ", ".join(f"{name} long" for name in NAMES))


def judged(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, the counts of NAMES, base_failed, `broken` (the first rule that the text
    breaks, else null) and kept.

    Words are runs of other than ASCII white space, told apart by case; null counts as the empty text. A line counts if it has a
    word, and is equal to another if all its characters are. n_repeat_words are words in 5-word windows found twice or more, the first
    included; base_failed says of a text that it has under 10 words, or over 20 % of them in such windows. A kept text also
    holds all shares of MOST_TOP, MOST_DUPLICATED and MOST_LINE_CHARS. Repeated rows have a row each, an empty table none, and
    other columns aren't looked at.
    """
    percent = lambda part, most, whole: F.col(part) * 100 > F.col(whole) * most
    failed = (F.col("n_words") < LEAST_WORDS) | percent("n_repeat_words", BASE_PERCENT, "n_words")
    rules = {"base": failed, "line_chars": percent("dup_line_chars", MOST_LINE_CHARS, "word_chars")}
    rules |= {f"top_{n}": percent(f"top_{n}_chars", most, "word_chars") for n, most in MOST_TOP.items()}
    rules |= {f"dup_{n}": percent(f"dup_{n}_chars", most, "word_chars") for n, most in MOST_DUPLICATED.items()}
    broken = F.coalesce(*[F.when(test, name) for name, test in rules.items()])
    return measured(docs, id_column).withColumns({"base_failed": failed, "broken": broken}).withColumn("kept", F.col("broken").isNull())
