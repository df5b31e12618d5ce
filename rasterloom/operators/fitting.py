"""Least squares, kriging, RANSAC and RPC: sums are aggregates; small dense systems are solved with numpy in one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.geometry import polynomial_terms
from rasterloom.operators.spatial import nearest
from rasterloom.storage import broadcast_few, checkpointed


def polynomial_fit(points: DataFrame, target: str, degree: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """One row with the coefficients of a polynomial in x and y. The normal equations are sums over all points, so what is
    solved is (terms x terms) whatever the number of points."""
    n = (degree + 1) * (degree + 2) // 2
    rows = points.select(polynomial_terms(F.col(x), F.col(y), degree).alias("t"), F.col(target).alias("b"))
    sums = [F.sum(F.col("t")[i] * F.col("t")[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(F.col("t")[i] * F.col("b")).alias(f"b{i}") for i in range(n)]

    def solve(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
                out.append(np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(n)], float), rcond=None)[0].tolist())
            yield pd.DataFrame({"coefficients": out})

    return rows.agg(*sums).mapInPandas(solve, "coefficients array<double>")


def residuals(points: DataFrame, target: str, fit: DataFrame, degree: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    terms = polynomial_terms(F.col(x), F.col(y), degree)
    predicted = F.aggregate(F.zip_with(terms, "coefficients", lambda t, c: t * c), F.lit(0.0), lambda s, v: s + v)
    return points.crossJoin(F.broadcast(fit)).withColumn("residual", F.col(target) - predicted).drop("coefficients")


def helmert_fit(pairs: DataFrame, limit: float = 1e-10, rounds: int = 100) -> DataFrame:
    """Seven parameters from pairs (x, y, z, u, v, w) by repeated linear solutions about the points' centres, and the residual
    standard deviation. What is solved comes from centres and co-moments, which are aggregates over all pairs."""
    names = ["x", "y", "z", "u", "v", "w"]
    rows = pairs.select(*[F.col(c).cast("double").alias(c) for c in names])
    moments = [F.covar_pop(a, b).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[i:]]

    def turn(p: np.ndarray) -> np.ndarray:
        return np.array([[1, p[5], -p[4]], [-p[5], 1, p[3]], [p[4], -p[3], 1]])

    def solve(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                if not r["n"]:
                    continue
                # means of products of (1, x, y, z, u, v, w), each about its centre
                m = np.zeros((7, 7))
                m[0, 0] = 1
                for i, a in enumerate(names):
                    for j, b in enumerate(names[i:], i):
                        m[i + 1, j + 1] = m[j + 1, i + 1] = r[a + b]
                p = np.zeros(7)
                for _ in range(rounds):
                    k = 1 + p[6]
                    # rows: coordinates; what is missed, and its derivatives by parameter, as weights of the seven
                    miss = np.column_stack([-p[:3], -k * turn(p), np.eye(3)])
                    design = np.zeros((3, 7, 7))
                    for i in range(3):
                        design[i, i, 0] = 1
                    design[0, 4, 3], design[0, 5, 2] = -k, k
                    design[1, 3, 3], design[1, 5, 1] = k, -k
                    design[2, 3, 2], design[2, 4, 1] = -k, k
                    design[:, 6, 1:4] = turn(p)
                    normal, right = sum(d @ m @ d.T for d in design), sum(d @ m @ e for d, e in zip(design, miss))
                    step = np.linalg.lstsq(normal, right, rcond=None)[0]
                    p += step
                    if np.abs(step).sum() <= limit:
                        break
                out.append([*p, *(r["m" + c] for c in names), *(1 + p[6]) * turn(p).ravel()])
            yield pd.DataFrame(out, columns=columns + turned)

    columns = ["dx", "dy", "dz", "rx", "ry", "rz", "scale", "sx", "sy", "sz", "tx", "ty", "tz"]
    turned = [f"r{i}{j}" for i in range(3) for j in range(3)]
    fit = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias("m" + c) for c in names], *moments).mapInPandas(solve, ", ".join(f"{c} double" for c in columns + turned))
    missed = [F.col("uvw"[i]) - F.col("t" + "xyz"[i]) - F.col("d" + "xyz"[i]) - sum(F.col(f"r{i}{j}") * (F.col("xyz"[j]) - F.col("s" + "xyz"[j])) for j in range(3)) for i in range(3)]
    # sigma by a pass of its own: taken from the moments, it would cancel
    return rows.crossJoin(F.broadcast(fit)).groupBy(*columns).agg(F.sqrt(F.sum(sum(e * e for e in missed)) / F.greatest(F.lit(1), 3 * F.count("*") - 7)).alias("sigma"))


def covariance(d: np.ndarray, model: str, nugget: float, sill: float, reach: float) -> np.ndarray:
    r = np.minimum(d / reach, 1)
    c = {"exponential": np.exp(-3 * d / reach), "spherical": 1 - r * (1.5 - 0.5 * r * r), "gaussian": np.exp(-3 * (d / reach) ** 2), "linear": 1 - r}[model]
    return np.where(d == 0, nugget + sill, sill * c)


def krige(points: DataFrame, queries: DataFrame, model: str = "exponential", nugget: float = 0.0, sill: float = 1.0, reach: float = 1.0, near: int = 16) -> DataFrame:
    """Ordinary kriging of each query (q, x, y) from its `near` nearest points (id, x, y, z): q, value, variance. With at least as many as
    there are points, it is one system of all points; without points there are no rows."""
    n, w, h = points.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if not n:
        return queries.select("q", F.lit(0.0).alias("value"), F.lit(0.0).alias("variance")).where("false")
    # cells of about as many points as are wanted, however many there are in all
    size = float(np.sqrt(max(w, 1e-9) * max(h, 1e-9) * near / n))
    found = nearest(queries, points, near, size)
    point = F.struct("rank", F.col("px").alias("x"), F.col("py").alias("y"), "z", "d")
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(point)).alias("p")).select("q", *[F.col("p")[c].alias(c) for c in ("x", "y", "z", "d")])

    def run(batches):
        for df in batches:
            value, variance = np.zeros(len(df)), np.zeros(len(df))
            sizes = df["z"].map(len).to_numpy()
            for k in np.unique(sizes):
                at = np.flatnonzero(sizes == k)
                x, y, z, d = (np.stack(df[c].to_numpy()[at]).astype(float) for c in "xyzd")
                a, b = np.ones((len(at), k + 1, k + 1)), np.ones((len(at), k + 1))
                a[:, :k, :k] = covariance(np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :]), model, nugget, sill, reach)
                a[:, k, k] = 0
                b[:, :k] = covariance(d, model, nugget, sill, reach)
                weights = (np.linalg.pinv(a) @ b[:, :, None])[:, :, 0]
                value[at], variance[at] = (z * weights[:, :k]).sum(1), nugget + sill - (weights * b).sum(1)
            yield pd.DataFrame({"q": df["q"], "value": value, "variance": variance})

    return lists.mapInPandas(run, "q long, value double, variance double")


def ransac(pairs: DataFrame, threshold: float, by: list[str], rounds: int = 200, seed: int = 7) -> DataFrame:
    """Control points (x, y, xr, yr) of each group that agree with the best of `rounds` seeded homographies.

    Homographies come from up to 4 * rounds points of a group, chosen by hash; all points of all groups are judged by each of
    their group's, which is an aggregate. Groups of fewer than four points are kept as they are.
    """
    coordinates = ["x", "y", "xr", "yr"]

    def homography(s: np.ndarray, t: np.ndarray) -> np.ndarray:
        rows = []
        for (x, y), (u, v) in zip(s, t):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
        return np.linalg.svd(np.array(rows))[2][-1]

    def models(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(coordinates).reset_index(drop=True)
        s, t = df[["x", "y"]].to_numpy(float), df[["xr", "yr"]].to_numpy(float)
        rng, out = np.random.default_rng(seed), []
        for k in range(rounds if len(df) >= 4 else 0):
            pick = rng.choice(len(df), 4, replace=False)
            out.append([*df.loc[0, by], k, *homography(s[pick], t[pick])])
        return pd.DataFrame(out, columns=[*by, "__round", *cells])

    cells = [f"__h{i}" for i in range(9)]
    hashed = pairs.select(*by, *coordinates, F.xxhash64(F.lit(seed), *coordinates).alias("__hash")).withColumn("__bucket", F.pmod("__hash", F.lit(rounds)))
    order = Window.partitionBy(*by, "__bucket").orderBy("__hash", *coordinates)
    chosen = hashed.withColumn("__r", F.row_number().over(order)).where("__r <= 4").select(*by, *coordinates)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*by).schema)
    found = checkpointed(chosen.groupBy(*by).applyInPandas(models, f"{kinds}, __round int, " + ", ".join(f"{c} double" for c in cells)))

    h = [F.col(c) for c in cells]
    row = lambda i: h[i] * F.col("x") + h[i + 1] * F.col("y") + h[i + 2]
    miss = lambda i, to: F.try_divide(row(i), row(6)) - F.col(to)
    inside = F.coalesce(F.sqrt(miss(0, "xr") * miss(0, "xr") + miss(3, "yr") * miss(3, "yr")) < threshold, F.lit(False))
    counts = pairs.join(broadcast_few(found), by).groupBy(*by, "__round").agg(F.sum(inside.cast("long")).alias("__n"))
    best = counts.groupBy(*by).agg(F.max_by("__round", F.struct("__n", -F.col("__round"))).alias("__round"))
    chosen_model = found.join(best, [*by, "__round"])
    small = checkpointed(pairs.groupBy(*by).agg(F.count("*").alias("__n")).where("__n < 4").select(*by, F.lit(True).alias("__few")))
    judged = pairs.join(broadcast_few(checkpointed(chosen_model)), by, "left").join(broadcast_few(small), by, "left")
    return judged.where(F.col("__few") | inside).select(*pairs.columns)
