"""Connected components of links, as tables: no link or label is gathered in the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Stage


#: Up to so many links (of 16 bytes) are solved in one task; more, by rounds of joins. Either gives the same components.
MOST_IN_A_TASK = 250_000


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the links, ascending, and the least id that each reaches: minima over links and pointer jumping."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, label[end], least)
        label = label[label]
        if (label == before).all():
            return ids, ids[label]


def components(links: DataFrame, name: str = "links", most_in_a_task: int = MOST_IN_A_TASK) -> Stage:
    """(id, component) for every id of links (a, b), a stored frame: the least id that links reach."""
    if links.count() > most_in_a_task:
        return by_rounds(links, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if parts:
            ids, found = solve(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], names=["id", "component"])

    return Stage(links.where("a <> b").select("a", "b").coalesce(1).mapInArrow(run, "id long, component long"), name)


def by_rounds(links: DataFrame, name: str = "links") -> Stage:
    """(id, component) for every id of links (a, b): the least id that links reach.

    Alternates two steps until nothing changes: large stars join every larger neighbour of an id to its least neighbour,
    small stars the others. Each step keeps components and at most doubles the links; the number of rounds grows as the
    logarithm of a component's size.
    """
    edges = Stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = Stage(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        least = large.df.groupBy("a").agg(F.min("b").alias("m"))
        small = large.df.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = Stage(small, name)
        edges.drop(), large.drop()
        edges = after
        # stars alone: no least id has a smaller neighbour, and no id two
        stars = edges.df.groupBy("a").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
        if (stars[1] or 0) <= 1 and edges.df.join(edges.df.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    found = edges.df.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    result = Stage(found.unionByName(roots), name)
    edges.drop()
    return result


def extended(labels: DataFrame, links: DataFrame, name: str = "labels") -> Stage:
    """(id, component) after further links (a, b). `labels` are those so far (an id without one is its own): only the
    components that links meet are solved anew."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("id").alias(end), F.col("component").alias("c" + end)), end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
    ends = Stage(ends.select("ca", "cb"), name).df
    merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), name).df
    before = labels.select("id", "component").unionByName(ends.select(F.col("ca").alias("id"), F.col("ca").alias("component"))).unionByName(ends.select(F.col("cb").alias("id"), F.col("cb").alias("component"))).distinct()
    return Stage(before.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component")), name)
