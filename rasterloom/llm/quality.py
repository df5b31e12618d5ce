"""Quality classifier by compression.

Two zstandard dictionaries are built from texts labelled good and bad. A text is compressed with either; the difference of
the two sizes, normalised by the length and by their sum, and the sizes themselves go through a quadratic logistic
calibration that becomes a score from 0 to 1. Dictionaries and calibration are fitted on a bounded sample of the labelled
rows (`SampleBounds`), chosen by the order of a hash of the id; every row is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import batches_of, crc32_mod5

THRESHOLD = 0.3
LEVEL = 3
#: Smaller dictionaries than this aren't worth training.
LEAST_TRAINED = 32_768


@dataclass(frozen=True)
class SampleBounds:
    """At most so many labelled rows of a class are fitted on; longer texts than max_chars aren't chosen for the fit."""

    dictionary_rows: int = 800
    good_rows: int = 6000
    bad_rows: int = 2500
    max_chars: int = 50_000
    dictionary_bytes: int = 112_640


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    raw: bool
    mean: list[float] = field(default_factory=lambda: [0.0] * 5)
    scale: list[float] = field(default_factory=lambda: [1.0] * 5)
    weights: list[float] = field(default_factory=lambda: [0.0] * 21)

    def compressors(self):
        import zstandard

        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]

    def sizes(self, texts: list[str]) -> np.ndarray:
        """Per text: its bytes, and its compressed bytes with either dictionary."""
        good, bad = self.compressors()
        found = np.empty((len(texts), 3))
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass")
            found[i] = max(len(data), 1), len(good.compress(data)), len(bad.compress(data))
        return found

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        n, good, bad = sizes.T
        return np.column_stack([(bad - good) / n, (bad - good) / (bad + good), np.log(good / n), np.log(bad / n), np.log(n)])

    def expand(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        squares = [x[:, i] * x[:, j] for i in range(5) for j in range(i, 5)]
        return np.column_stack([np.ones(len(x)), x, *squares])

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.expand(self.features(sizes)) @ np.asarray(self.weights), -30, 30)))

    def calibrate(self, sizes: np.ndarray, labels: np.ndarray, row_weights: np.ndarray, ridge: float = 1.0) -> None:
        """Logistic regression by Newton steps that are halved until the penalised likelihood grows."""
        x = self.features(sizes)
        self.mean, self.scale = x.mean(0).tolist(), np.maximum(x.std(0), 1e-6).tolist()
        x, w = self.expand(x), np.zeros(21)

        def objective(w: np.ndarray) -> float:
            z = x @ w
            return float(row_weights @ (labels * z - np.logaddexp(0, z)) - 0.5 * ridge * w @ w)

        best = objective(w)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (row_weights * (labels - p)) - ridge * w
            step = np.linalg.solve((x * (row_weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(21), gradient)
            while (now := objective(w + step)) < best and np.abs(step).max() > 1e-9:
                step /= 2
            if now - best < 1e-9:
                break
            w, best = w + step, now
        self.weights = w.tolist()


def build_dictionaries(texts: dict[int, list[bytes]], most: int) -> tuple[dict[int, bytes], bool]:
    """A dictionary of each class, of one size: trained, and a quarter of the smaller class at most; where that is too
    little to train on, the texts themselves. Also whether they are the latter."""
    import zstandard

    size = min(most, min(sum(map(len, t)) for t in texts.values()) // 4)
    if size >= LEAST_TRAINED:
        try:
            return {c: zstandard.train_dictionary(size, t).as_bytes() for c, t in texts.items()}, False
        except zstandard.ZstdError:
            pass
    return {c: (b"\n".join(t) or b"\n")[-most:].ljust(8) for c, t in texts.items()}, True


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bounds: SampleBounds = SampleBounds()) -> CompressionModel:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 isn't 0. Without rows of both classes every score is the prior."""
    training = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc32_mod5("doc_id") != 0))
    totals = dict(training.groupBy("label").count().collect())
    most = {1: bounds.dictionary_rows + bounds.good_rows, 0: bounds.dictionary_rows + bounds.bad_rows}
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = None
    for label, n in most.items():
        rows = training.where(F.col("label") == label).select("doc_id", "label", order.alias("at")).orderBy("at", "doc_id").limit(n)
        chosen = rows if chosen is None else chosen.unionAll(rows)
    ids = {}
    for doc_id, label, _ in chosen.collect():  # at most most[0] + most[1] rows
        ids.setdefault(doc_id, label)
    queue = {c: [i for i, x in ids.items() if x == c] for c in (0, 1)}
    first = {c: set(queue[c][: min(bounds.dictionary_rows, (len(queue[c]) + 1) // 2)]) for c in (0, 1)}
    rest = {i for i in ids if i not in first[ids[i]]}

    def texts(wanted: set) -> DataFrame:
        side = docs.sparkSession.createDataFrame([(i, ids[i]) for i in sorted(wanted)], "doc_id long, label int")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        near = rows.join(F.broadcast(side), "doc_id").where(F.length("text") <= bounds.max_chars)
        return near.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # an id that is repeated has one text

    samples: dict[int, list] = {0: [], 1: []}
    if first[0] or first[1]:
        for doc_id, label, text in texts(first[0] | first[1]).collect():  # at most 2 * dictionary_rows texts of max_chars
            samples[label].append((doc_id, text.encode("utf-8", "surrogatepass")))
    built, raw = build_dictionaries({c: [t for _, t in sorted(samples[c])] for c in (0, 1)}, bounds.dictionary_bytes)
    model = CompressionModel(built[1], built[0], raw)
    good, bad = totals.get(1, 0), totals.get(0, 0)
    model.weights[0] = float(np.log((good + 1) / (bad + 1)))
    found = np.array(with_sizes(texts(rest), model, "label long").select("doc_id", "label", "n_bytes", "good_bytes", "bad_bytes").orderBy("doc_id").collect(), dtype=float) if rest else np.empty((0, 5))
    if len(found) and 0 < found[:, 1].sum() < len(found):
        ones = found[:, 1] == 1
        weights = np.where(ones, good / ones.sum(), bad / (~ones).sum())
        model.calibrate(found[:, 2:], found[:, 1], weights * len(found) / weights.sum())
    return model


def with_sizes(rows: DataFrame, model: CompressionModel, extra: str = "") -> DataFrame:
    """Sizes and score of the texts of (doc_id, text), with the column `extra` passed on."""
    name = extra.split(" ")[0]
    source = rows.select("doc_id", "text", *[F.col(name).cast("long").alias(name)] * bool(extra))
    schema = pa.schema([("doc_id", pa.int64())] + [(name, pa.int64())] * bool(extra) + [("n_bytes", pa.int64()), ("good_bytes", pa.int64()), ("bad_bytes", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in batches_of(batch, "text"):
                sizes = model.sizes(texts)
                kept = [piece.column(c) for c in ["doc_id", *[name] * bool(extra)]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(sizes[:, i].astype(np.int64)) for i in range(3)), pa.array(model.scores(sizes))], schema=schema)

    return source.mapInArrow(score, "doc_id long, " + (f"{extra}, " if extra else "") + "n_bytes long, good_bytes long, bad_bytes long, score double")


def score_documents(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """Score and prediction of every whole text.

    Null and empty texts get the score of an empty text; repeated rows and ties are kept, a row for each row; an empty
    table gives no rows; a null id is held_out as the empty id's checksum says; other columns aren't looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_sizes(rows, model).select("doc_id", (crc32_mod5("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_bytes", "good_bytes", "bad_bytes")


def keep_good(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """The rows of `docs`, all columns, whose score isn't below the threshold; decided in one pass, without a join."""
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in batches_of(batch, "text"):
                yield piece.filter(pa.array(model.scores(model.sizes(texts)) >= THRESHOLD))

    return docs.mapInArrow(keep, schema)
