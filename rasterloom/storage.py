"""Cutting lineage in loops, and broadcasts of a checked size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a stored table of numbers that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written as a table to the folder that driver and executors share (spark.checkpoint.dir), so that a lost executor costs
    a reread, and its size is that of the table. (A checkpoint keeps what was guessed of its size; over the joins of a loop, guesses
    multiply.) Where the setting is unset, it is a folder of our own in local mode, as in tests; on a cluster it raises."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_few(side: DataFrame) -> DataFrame:
    """A stored frame of short rows, broadcast if it has few."""
    return F.broadcast(side) if side.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else side
