"""Geometry and interpolation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a literal ring."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        crossings = crossings + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting against an array of structs (x, y)."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        spans = (a.y > y) != (b.y > y)
        return F.when(spans & (x < F.try_divide((b.x - a.x) * (y - a.y), b.y - a.y) + a.x), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crossing), F.lit(0), lambda s, v: s + v) % 2 == 1


def boxes_meet(a: str, b: str, closed: bool = True) -> Column:
    """Whether boxes with the columns <prefix>xmin.. overlap; touching counts if closed."""
    c = lambda p, n: F.col(p + n)
    if closed:
        return (c(a, "xmin") <= c(b, "xmax")) & (c(a, "xmax") >= c(b, "xmin")) & (c(a, "ymin") <= c(b, "ymax")) & (c(a, "ymax") >= c(b, "ymin"))
    return (c(a, "xmin") < c(b, "xmax")) & (c(a, "xmax") > c(b, "xmin")) & (c(a, "ymin") < c(b, "ymax")) & (c(a, "ymax") > c(b, "ymin"))


def bilinear(x: Column, y: Column, corners: Column) -> Column:
    """Value at a point in a rectangle of four corners (x, y, value), in any order; refuses other shapes and points outside."""
    p = F.array_sort(corners)
    a, b, c, d = (F.get(p, i) for i in range(4))
    rectangle = (a.x == b.x) & (c.x == d.x) & (a.y == c.y) & (b.y == d.y)
    inside = x.between(a.x, c.x) & y.between(a.y, b.y)
    value = (a.value * (c.x - x) * (b.y - y) + c.value * (x - a.x) * (b.y - y) + b.value * (c.x - x) * (y - a.y) + d.value * (x - a.x) * (y - a.y)) / ((c.x - a.x) * (b.y - a.y))
    return F.when(~rectangle, F.raise_error(F.lit("corners don't form a rectangle"))).when(~inside, F.raise_error(F.lit("point is outside"))).otherwise(value)


def covariance(model: str, d: Column, nugget: float, sill: float, reach: float) -> Column:
    """Covariance at a distance: exponential, spherical, gaussian or linear; nugget + sill at distance 0."""
    r = F.least(d / reach, F.lit(1.0))
    shapes = {"exponential": F.exp(-3.0 * d / reach), "spherical": 1 - r * (1.5 - 0.5 * r * r), "gaussian": F.exp(-3.0 * (d / reach) * (d / reach)), "linear": 1 - r}
    return F.when(d == 0, nugget + sill).otherwise(sill * shapes[model])


def rounded(v: Column, digits: int) -> Column:
    """A value from 0 on, rounded half up as DuckDB does; round() goes through decimals, which takes many times as long."""
    t = v * 10.0**digits
    whole = F.floor(t)
    return (whole + F.when(t - whole >= 0.5, 1).otherwise(0)) / 10.0**digits


def polynomial_terms(x: Column, y: Column, degree: int) -> Column:
    """x^(n-i) y^i for degrees n = 0..degree."""
    return F.array(*[F.pow(x, F.lit(float(n - i))) * F.pow(y, F.lit(float(i))) for n in range(degree + 1) for i in range(n + 1)])


def corner_box(lons: list[Column], lats: list[Column]) -> tuple[Column, Column, Column, Column]:
    return F.least(*lons), F.least(*lats), F.greatest(*lons), F.greatest(*lats)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of structs (x, y)."""
    n = F.size(ring)
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i).x * F.get(ring, F.pmod(i + 1, n)).y - F.get(ring, F.pmod(i + 1, n)).x * F.get(ring, i).y)
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2


def rle_box(rle: Column, height: int = 768, width: int = 768) -> Column:
    """Centre, height and width (as fractions of 768) of a column-major run-length text `start length ...`."""
    v = F.transform(F.split(F.trim(rle), r"\s+"), lambda s: s.cast("long"))
    starts = F.transform(F.filter(v, lambda x, i: i % 2 == 0), lambda x: x - 1)
    lengths = F.filter(v, lambda x, i: i % 2 == 1)
    rows = F.zip_with(starts, lengths, lambda s, n: s % height + n)
    tall = F.array_max(rows) > height
    y0 = F.when(tall, 0).otherwise(F.array_min(F.transform(starts, lambda s: s % height)))
    y1 = F.when(tall, height).otherwise(F.array_max(rows))
    x0 = F.array_min(F.transform(starts, lambda s: F.floor(s / height)))
    x1 = F.array_max(F.zip_with(starts, lengths, lambda s, n: F.floor((s + n) / height)))
    box = F.array((x0 + x1) / 1536.0, (y0 + y1) / 1536.0, F.abs(y1 - y0) / 768.0, F.abs(x1 - x0) / 768.0)
    return F.when(x1 > width, F.raise_error(F.lit("run lengths exceed the image"))).otherwise(box)


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column, size: int = 256) -> tuple[Column, Column, Column, Column]:
    return (cx - w / 2) * size, (cy - h / 2) * size, (cx + w / 2) * size, (cy + h / 2) * size


def interleaved(c: Column) -> Column:
    """x1..x4, y1..y4 as x1, y1, x2, y2, ..."""
    return F.array(*[F.get(c, i) for i in (0, 4, 1, 5, 2, 6, 3, 7)])


def points_box(points: Column) -> tuple[Column, Column, Column, Column]:
    """Box of an array of `x, y` texts."""
    xs = F.transform(points, lambda p: F.trim(F.split_part(p, F.lit(","), F.lit(1))).cast("double"))
    ys = F.transform(points, lambda p: F.trim(F.split_part(p, F.lit(","), F.lit(2))).cast("double"))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
