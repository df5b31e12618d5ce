"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one numpy pass takes at most (a longer text goes alone, in slices where the operator can).
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, as in
    tests; on a cluster, whose executors wouldn't see such a folder, it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


class Stage:
    """A table in the shared folder; cuts lineage, so that a lost executor costs a reread and no recomputation."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        self.schema = df.schema
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stage(df, name).df


#: Rows of a file are numbered below this; the file's place in the order of names is counted in it.
FILE_ROWS = 1 << 40


def settled(df: DataFrame) -> DataFrame:
    """The rows of `df`, and as `__rasterloom_row` a number of each that stays with it however often, and in whatever partitions, the frame
    is evaluated: of a parquet scan with projections and filters, by file and place in the file; anything else is written with
    its numbers to a table. What numbers rows more than once starts from this."""
    if "__rasterloom_row" in df.columns:
        return df
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m for m in re.findall(r"^[\s:+\-|']*(\w+)", plan, re.M)}
    if "Relation" in nodes <= {"Project", "Filter", "Relation"} and re.search(r"Relation \[.*\] parquet", plan):
        names = df.columns
        # with its own name for each, so that no column of the frame is meant
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
        files = sorted(r[0] for r in placed.select("__file").distinct().collect())
        order = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(files)), "__nth long, __file string"))
        return placed.join(order, "__file").select(*[F.col(f"`{c}`") for c in names], (F.col("__nth") * FILE_ROWS + F.col("__index")).alias("__rasterloom_row"))
    return stored(df.withColumn("__rasterloom_row", F.monotonically_increasing_id()), "settled")


#: Up to so many row numbers (of 8 bytes) are broadcast; beyond, rows are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def checked(side: DataFrame) -> DataFrame:
    """A stored frame of row numbers, broadcast where it is small enough."""
    return F.broadcast(side) if side.count() <= MOST_BROADCAST else side


#: Up to so many characters, as JSON, of a table of facts are broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST_CHARS = 8_000_000


def broadcast_checked(side: DataFrame) -> DataFrame:
    """A stored frame of groups and facts, broadcast where all its rows together are short."""
    size = side.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(side) if size <= MOST_BROADCAST_CHARS else side


def kept_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs`, a settled frame, that the decisions (row, kept) keep; all columns but the number."""
    dropped = stored(decisions.where("not kept").select(F.col("row").alias("__rasterloom_row")), "dropped")
    return docs.join(checked(dropped), "__rasterloom_row", "left_anti").drop("__rasterloom_row")


def in_slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts, each of one text or of at most `limit` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def batches_of(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts (null as empty), bounded in characters, so that big batches don't meet in memory."""
    lengths = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield part(batch, column, start, i)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield part(batch, column, start, len(sizes))


def part(batch: pa.RecordBatch, column: str, start: int, end: int) -> tuple[pa.RecordBatch, list[str]]:
    piece = batch.slice(start, end - start)
    return piece, [t or "" for t in piece.column(column).to_pylist()]


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def white_slices(data: bytes, limit: int = 4_000_000) -> Iterator[bytes]:
    """Slices of about `limit` bytes, cut at white space (a longer word stays whole)."""
    start = 0
    while start < len(data):
        cut = _WHITE.search(data, start + limit) if len(data) - start > limit else None
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def crc32_mod5(column: str):
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def words_bytes(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, in UTF-8 (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()
