"""Spatial joins. Range joins become equi-joins on grid cells, so that Spark needs no nested loops."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.geometry import boxes_meet
from rasterloom.storage import checkpointed

BOX = ["xmin", "ymin", "xmax", "ymax"]


def cells(df: DataFrame, prefix: str, size: float) -> DataFrame:
    place = lambda c: F.floor(F.col(prefix + c) / size)
    out = df.withColumn("__cx", F.explode(F.sequence(place("xmin"), place("xmax"))))
    return out.withColumn("__cy", F.explode(F.sequence(place("ymin"), place("ymax"))))


def box_join(left: DataFrame, right: DataFrame, size: float, closed: bool = True) -> DataFrame:
    """Pairs of rows whose boxes meet. Columns get the prefixes a_ and b_.

    Each box stands in all cells it covers; a pair is kept in the least cell that both cover, so no pair comes twice and
    none has to be made distinct afterwards. Cells of about a box's size bound both copies and candidates.
    """
    a = left.select([F.col(c).alias("a_" + c) for c in left.columns])
    b = right.select([F.col(c).alias("b_" + c) for c in right.columns])
    # the pairs are many more than the rows, by whose size Spark would choose the number of tasks
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, p: cells(df, p, size).repartition(tasks, "__cx", "__cy")
    joined = dealt(a, "a_").join(dealt(b, "b_"), ["__cx", "__cy"]).where(boxes_meet("a_", "b_", closed))
    owner = lambda c: F.greatest(F.floor(F.col(f"a_{c}") / size), F.floor(F.col(f"b_{c}") / size))
    return joined.where((F.col("__cx") == owner("xmin")) & (F.col("__cy") == owner("ymin"))).drop("__cx", "__cy")


def box_semi(left: DataFrame, right: DataFrame, size: float, key: str, anti: bool = False) -> DataFrame:
    """Rows of `left` that meet some box of `right` (or none). A box stands once among those of `right`, and the first that a row meets
    in a cell is enough, so no pairs are made."""
    a = cells(left.select(F.col(key).alias(key), *[F.col(c).alias("a_" + c) for c in BOX]), "a_", size)
    b = cells(right.select([F.col(c).alias("b_" + c) for c in BOX]).distinct(), "b_", size).withColumnsRenamed({"__cx": "__bx", "__cy": "__by"})
    met = (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by")) & boxes_meet("a_", "b_")
    hits = a.join(b, met, "left_semi").select(key).distinct()
    return left.join(hits, key, "left_anti" if anti else "left_semi")


def layer_box(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def close_size(points: DataFrame, k: int) -> float:
    """Size of a cell that would hold 2 * k points (x, y) if these were spread over their box, or, without a height or width, along it."""
    n, x1, x2, y1, y2 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n or x1 is None or y1 is None:
        return math.inf
    wide, tall = x2 - x1, y2 - y1
    found = math.sqrt(wide * tall * 2 * k / n) if wide and tall else max(wide, tall) * 2 * k / n
    return found if found > 0 and math.isfinite(found) else math.inf


def nearest(queries: DataFrame, points: DataFrame, k: int, size: float) -> DataFrame:
    """The k nearest points (id, x, y, z) of each query (q, x, y), ties by id: q, id, z, d, rank,
    and their places px, py.

    A query takes the points of the nine cells around it, of `size` at first, or less where points lie closer. What lies within a
    cell's size is certain; queries with fewer than k certain points go on with cells four times as large. A round's findings and
    the queries that go on are stored, so that no round is evaluated again.
    """
    spread = points.agg(F.count("*"), F.max(F.abs(F.col("x"))), F.max(F.abs(F.col("y")))).first()
    size = min(size, close_size(points, k))
    least = queries.agg(F.max(F.abs(F.col("x"))), F.max(F.abs(F.col("y")))).first()
    reach = max(v or 0 for v in (*spread[1:], *least)) * 2
    wanted = min(k, spread[0])
    left, out = queries.select("q", "x", "y"), None
    rank = Window.partitionBy("q").orderBy("d", "id")
    while True:
        cell = lambda c, size=size: F.floor(F.col(c) / size).cast("long")
        p = points.select(F.col("id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z"), cell("x").alias("__cx"), cell("y").alias("__cy"))
        around = left.withColumn("__cx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("__cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
        d = F.sqrt(F.pow(F.col("px") - F.col("x"), F.lit(2.0)) + F.pow(F.col("py") - F.col("y"), F.lit(2.0)))
        ranked = around.join(p, ["__cx", "__cy"]).withColumn("d", d).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        last = size > reach
        # a little less than the size, for rounding at the edges of cells
        sure = ranked.withColumn("__n", F.sum(F.when(F.col("d") <= size * (1 - 1e-9), 1).otherwise(0)).over(Window.partitionBy("q")))
        found = (ranked if last else sure.where(F.col("__n") >= wanted).where(F.col("rank") <= wanted)).select("q", "id", "z", "d", "rank", "px", "py")
        if not last:
            found = checkpointed(found)
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        left = checkpointed(left.join(found.select("q").distinct(), "q", "left_anti"))
        if left.isEmpty():
            return out
        size *= 4


def inverse_distance(neighbours: DataFrame, p: float = 1.0) -> DataFrame:
    """Weighted mean of the neighbours (q, z, d) of each query; a point at distance 0 gives its own value."""
    exact = F.min_by(F.when(F.col("d") < 1e-10, F.col("z")), F.when(F.col("d") < 1e-10, F.col("d")))
    far = F.col("d") >= 1e-10
    return neighbours.groupBy("q").agg(F.coalesce(exact, F.try_divide(F.sum(F.when(far, F.try_divide(F.lit(1.0), F.pow(F.col("d"), F.lit(float(p)))) * F.col("z"))), F.sum(F.when(far, F.try_divide(F.lit(1.0), F.pow(F.col("d"), F.lit(float(p)))))))).alias("value"))


#: Vectors of a block of queries and of descriptors.
QUERY_BLOCK, BLOCK = 1024, 2048


def vector_blocks(vectors: DataFrame, key: str, prefix: str, rows: int) -> DataFrame:
    """Vectors (key, v) in blocks of up to so many rows of one length: columns ids and v, as bytes, and dim."""

    def pack(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column("v"))
            for dim in sorted(pc.unique(size).to_pylist()):
                some = batch.filter(pc.equal(size, dim))
                for k in range(0, some.num_rows, rows):
                    part = some.slice(k, rows)
                    ids, v = part.column(key).to_numpy(zero_copy_only=False).astype(np.int64), part.column("v").flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([v.astype(np.float64).tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=[prefix + c for c in ("ids", "v", "dim")])

    whole = vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col("v").cast("array<double>").alias("v"))
    return whole.mapInArrow(pack, f"{prefix}ids binary, {prefix}v binary, {prefix}dim int")


def two_nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, ids and distances of the two vectors nearest to each query, but for itself; ties by id. Products tell which vectors may be
    among the two, within what rounding makes of them; only these get their distance, summed up in order."""
    length = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :]
    rough = length - 2 * (q @ v.T)
    rough, slack = np.where(np.isnan(rough), np.inf, rough), np.nan_to_num(1e-12 * (length + 1), posinf=0.0)
    same = q_ids[:, None] == ids[None, :]
    rough[same] = np.inf
    if rough.shape[1] > 2:
        most = np.partition(rough + slack, 1, axis=1)[:, 1][:, None]
        at, to = np.nonzero((rough - slack <= most) & ~same)
    else:
        at, to = np.nonzero(~same)
    total = np.zeros(len(at))
    for c in range(q.shape[1]):
        step = q[at, c] - v[to, c]
        total += step * step
    d = np.sqrt(total)
    order = np.lexsort((ids[to], d, at))
    at, to, d = at[order], to[order], d[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    first = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    keep = first < 2
    return q_ids[at[keep]], ids[to[keep]], d[keep]


def ratio_matches(queries: DataFrame, descriptors: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Nearest descriptor (id, v) of each query (q, v) where it is nearer than `ratio` times the second: q, id, d1, d2.

    Both sets are cut into blocks, and a task compares a block with a block by a product of matrices, which leaves two distances of each
    query and pair of blocks for the shuffle. The query set is stated, but none is held as a whole.
    """
    asked, held = checkpointed(vector_blocks(queries, "q", "q_", QUERY_BLOCK)), checkpointed(vector_blocks(descriptors, "id", "", BLOCK))
    tasks = min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(held.count(), 1))

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["q_dim"] != r["dim"] or not r["dim"]:
                    continue
                q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                found = two_nearest(q_ids, np.frombuffer(r["q_v"]).reshape(len(q_ids), -1), ids, np.frombuffer(r["v"]).reshape(len(ids), -1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["q", "id", "d"])

    pairs = held.repartition(tasks).crossJoin(asked)
    near = pairs.mapInArrow(compare, "q long, id long, d double")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where("r <= 2")
    two = ranked.groupBy("q").agg(F.max(F.when(F.col("r") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2"))
    return two.where(F.col("d1") < ratio * F.col("d2"))


def latest_before(facts: DataFrame, key: str, year: str, now: int | Column) -> DataFrame:
    """The row of the latest year up to now, for each key (an as-of lookup)."""
    others = [c for c in facts.columns if c != key]
    best = facts.where(F.col(year) <= now).groupBy(key).agg(F.max_by(F.struct(*others), F.col(year)).alias("__best"))
    return best.select(key, *[F.col("__best")[c].alias(c) for c in others])
