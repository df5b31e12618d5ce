"""Polygons with holes: intersections, masks and unions, against plain versions and known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import polygons as G
from rasterloom.operators.reprojection import Grid

SCHEMA = "id long, rings array<array<struct<x: double, y: double>>>"


def star(r, x, y, big, n):
    """A ring around a place that sees all of it; concave as a rule."""
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + big * s * math.cos(t), y + big * s * math.sin(t)) for t, s in ((t, r.uniform(0.5, 1)) for t in turns)]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def full(rings):
    return abs(area(rings[0])) - sum(abs(area(h)) for h in rings[1:])


def inside(rings, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:] + r[:1])) % 2 == 1


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(8)
    out = {}
    for i in range(30):
        x, y, n = r.uniform(0, 20), r.uniform(0, 20), r.randrange(5, 12)
        outer = star(r, x, y, 4, 12)
        rings = [outer, star(r, x, y, 0.6, n)] if i % 2 else [outer]
        if abs(area(outer)) < 4 or not all(inside([outer], *p) for p in rings[-1] if i % 2):
            rings = [[(x - 3, y - 3), (x + 3, y - 3), (x + 3, y + 3), (x - 3, y + 3)], rings[-1]] if i % 2 else [outer]
        out[i] = [ring[::-1] if r.random() < 0.5 else ring for ring in rings]  # either direction
        if i % 3 == 0:
            out[i] = [[*ring, ring[0]] for ring in out[i]]  # closed
    return out


def table(spark, shapes):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in shapes.items()], SCHEMA)


@pytest.mark.parametrize(("cell", "slab"), [(5.0, 3.0), (50.0, 0.5), (1.5, 40.0)])
def test_areas_add_up(spark, shapes, cell, slab):
    """What a polygon shares with itself is its area; what it shares with the tiles of a plane adds up to its area."""
    a = table(spark, shapes)
    own = {r.a_id: r.area for r in G.intersection_areas(a, a, cell, slab).where("a_id = b_id").collect()}
    assert set(own) == set(shapes) and all(abs(own[i] - full(shapes[i])) < 1e-9 for i in shapes)
    tiles = {k: [[(x, y), (x + 7, y), (x + 4, y + 7)]] for k, (x, y) in enumerate((x, y) for x in range(-14, 35, 7) for y in range(-14, 35, 7))}
    # the other half of each tile, so that they cover the plane
    tiles |= {1000 + k: [[(t[0][2][0], t[0][2][1]), (t[0][0][0], t[0][0][1] + 0.0), (t[0][0][0] - 3, t[0][2][1])]] for k, t in list(tiles.items())}
    sums = {}
    for r in G.intersection_areas(a, table(spark, tiles), cell, slab).collect():
        sums[r.a_id] = sums.get(r.a_id, 0) + r.area
    assert all(abs(sums[i] - full(shapes[i])) < 1e-9 for i in shapes)


def test_areas_by_counting_points(spark, shapes):
    found = {(r.a_id, r.b_id): r.area for r in G.intersection_areas(table(spark, shapes), table(spark, shapes), 5.0, 2.0).where("a_id < b_id").collect()}
    step = 0.05
    for (i, j) in random.Random(1).sample(sorted(found), 12):
        xs = [p[0] for p in shapes[i][0]]
        ys = [p[1] for p in shapes[i][0]]
        n = sum(inside(shapes[i], x, y) and inside(shapes[j], x, y) for x in (min(xs) + step * (k + 0.5) for k in range(int((max(xs) - min(xs)) / step) + 1)) for y in (min(ys) + step * (k + 0.5) for k in range(int((max(ys) - min(ys)) / step) + 1)))
        assert abs(n * step * step - found[i, j]) < 0.35
        assert abs(found[i, j]) <= min(full(shapes[i]), full(shapes[j])) + 1e-9


def test_area_without_python(spark, shapes):
    plan = G.intersection_areas(table(spark, shapes), table(spark, shapes), 5.0, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_pairs_of_small_polygons_are_not_shuffled(spark, shapes):
    plan = G.intersection_areas(table(spark, shapes), table(spark, shapes), 5.0, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a_id" not in plan and "hashpartitioning(b_id" not in plan


def test_large_polygons_by_slabs(spark, shapes, monkeypatch):
    """Whether a polygon brings its edges along or has them joined by slabs, areas are the same; boxes are among both."""
    some = {**dict(list(shapes.items())[:12]), 90: [[(1.0, 1.0), (9.0, 1.0), (9.0, 8.0), (1.0, 8.0)]], 91: [[(4.0, 3.0), (4.0, 15.0), (14.0, 15.0), (14.0, 3.0), (4.0, 3.0)]], 92: [[(2.0, 2.0), (12.0, 2.0), (2.0, 9.0)]]}
    found = []
    for few in (64, 12, 0):
        monkeypatch.setattr(G, "FEW", few)
        found.append({(r.a_id, r.b_id): r.area for r in G.intersection_areas(table(spark, some), table(spark, some), 5.0, 2.0).collect()})
    assert found[0].keys() == found[1].keys() == found[2].keys() and len(found[0]) > 40
    assert all(abs(found[0][k] - other[k]) < 1e-9 for other in found[1:] for k in other)
    assert found[0][90, 91] == 25.0 and abs(found[0][92, 92] - 35.0) < 1e-9


def test_burning_many_polygons(spark, shapes):
    grid = Grid(0, -3.0, 27.0, 0.25, 0.5, 120, 60)
    got = {(r.row, r.col) for r in G.covered_cells(table(spark, shapes), grid).collect()}
    want = {(row, col) for row in range(60) for col in range(120) if any(inside(s, -3 + (col + 0.5) * 0.25, 27 - (row + 0.5) * 0.5) for s in shapes.values())}
    assert got == want
    assert G.covered_cells(table(spark, shapes), grid).count() == len(want)  # each once
    px = spark.createDataFrame([(0, 0), (30, 60), (1000, 5)], "row long, col long")
    masks = {(r.row, r.col): r.mask for r in G.burn_table(px, table(spark, shapes), grid).collect()}
    assert masks == {k: 0 if k in want else 1 for k in [(0, 0), (30, 60), (1000, 5)]}


def test_clips_by_bands(spark, shapes, monkeypatch):
    """Pixels under each polygon, over several bands and parts, with pixels twice, beyond the grid, and values that are null; no run of a
    polygon is dealt out by itself."""
    monkeypatch.setattr(G, "BAND", 8)
    monkeypatch.setattr(G, "SPAN", 32)
    grid = Grid(0, -3.0, 27.0, 0.25, 0.5, 120, 60)
    rows = [(r, c, None if c % 7 == 0 else f"{r}") for r in range(-1, 61) for c in range(-1, 121, 2)] + [(30, 61, "again")]
    found = G.clip_by_table(spark.createDataFrame(rows, "row long, col int, name string"), table(spark, shapes), grid)
    assert found.dtypes == [("row", "bigint"), ("col", "int"), ("name", "string"), ("id", "bigint")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    want = [(r, c, n, i) for r, c, n in rows for i, s in shapes.items() if 0 <= r < 60 and 0 <= c < 120 and inside(s, -3 + (c + 0.5) * 0.25, 27 - (r + 0.5) * 0.5)]
    key = lambda x: (x[3], x[0], x[1], str(x[2]))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key) and len(want) > 1000


def test_spans_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "SPAN", 4)
    square = {1: [[(1.0, 0.0), (11.0, 0.0), (11.0, 2.0), (1.0, 2.0)]], 2: [[(2.0, 0.0), (3.0, 0.0), (3.0, 2.0), (2.0, 2.0)]], 3: [[(-5.0, 1.0), (99.0, 1.0), (99.0, 1.9), (-5.0, 1.9)]]}
    got = sorted((r.row, r.first, r.last) for r in G.spans(table(spark, square), Grid(0, 0.0, 2.0, 1.0, 1.0, 13, 2)).collect())
    assert got == [(0, 0, 3), (0, 4, 7), (0, 8, 11), (0, 12, 12), (1, 1, 3), (1, 4, 7), (1, 8, 10)]


def test_plan_does_not_grow_with_polygons(spark, shapes):
    grid = Grid(0, 0.0, 100.0, 1.0, 1.0, 100, 100)
    sizes = [len(G.covered_cells(table(spark, dict(list(shapes.items())[:n])), grid)._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 30)]
    assert sizes[0] == sizes[1]


def test_gml(spark):
    xml = """<eop:Mask xmlns:gml="x"><gml:Polygon gml:id="a"><gml:exterior><gml:LinearRing><gml:posList srsDimension="2">0 0 10 0 10 10 0 10 0 0</gml:posList></gml:LinearRing></gml:exterior>
      <gml:interior><gml:LinearRing><gml:posList srsDimension="2">2 2 2 4
      4 4 4 2 2 2</gml:posList></gml:LinearRing></gml:interior></gml:Polygon>
      <gml:Polygon><gml:exterior><gml:LinearRing><gml:posList srsDimension="3">20 20 5 21 20 5 21 21 5 20 20 5</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></eop:Mask>"""
    rows = G.gml_polygons(spark.createDataFrame([("one", xml), ("none", "<eop:Mask/>"), ("null", None)], "scene string, xml string")).orderBy("id").collect()
    assert [(r.scene, r.id, [len(x) for x in r.rings]) for r in rows] == [("one", 0, [5, 5]), ("one", 1, [4])]
    assert [(p.x, p.y) for p in rows[1].rings[0]] == [(20, 20), (21, 20), (21, 21), (20, 20)]
    cells = G.covered_cells(G.gml_polygons(spark.createDataFrame([(xml,)], "xml string")), Grid(0, 0.0, 30.0, 1.0, 1.0, 30, 30)).count()
    assert cells == 100 - 4 + 1


# unions


def cells_table(spark, cells):
    return spark.createDataFrame([(f, [[{"x": float(x), "y": float(y)} for x, y in ((c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1))]]) for f, r, c in cells], "field string, rings array<array<struct<x: double, y: double>>>")


def parsed(wkt):
    return [[tuple(map(float, p.split())) for p in ring.split(", ")] for ring in wkt.removeprefix("POLYGON ((").removesuffix("))").split("), (")]


def connected(cells):
    """Sets of cells that meet in sides."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    part.add(n)
                    todo.append(n)
        out.append(part)
    return out


def test_dissolve(spark):
    r = random.Random(6)
    cells = [(r.choice(["a", "b", "b", None]), row, col) for row in range(24) for col in range(24)]
    cells += [("ring", row, col) for row in range(30, 41) for col in range(30, 41) if max(abs(row - 35), abs(col - 35)) in (5, 3, 1)]  # nested rings
    cells += cells[:50]  # copies
    rows = G.dissolve_polygons(cells_table(spark, cells), "field").collect()
    for field in ("a", "b", None, "ring"):
        mine = {(row, col) for f, row, col in cells if f == field}
        parts = [x for x in rows if x.field == field]
        covered = []
        for x in parts:
            rings = parsed(x.wkt)
            assert all(ring[0] == ring[-1] for ring in rings) and x.holes == len(rings) - 1
            xs, ys = zip(*rings[0])
            assert (x.xmin, x.ymin, x.xmax, x.ymax) == (min(xs), min(ys), max(xs), max(ys))
            part = {(row, col) for row in range(int(x.ymin), int(x.ymax)) for col in range(int(x.xmin), int(x.xmax)) if inside(rings, col + 0.5, row + 0.5)}
            assert x.area == len(part)
            covered.append(part)
        assert sorted(map(sorted, covered)) == sorted(map(sorted, connected(mine)))


def test_dissolve_of_triangles(spark):
    """Shapes need not be cells: a square of four triangles loses its inner sides."""
    c = (1.0, 1.0)
    corners = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [("t", [[{"x": x, "y": y} for x, y in tri]]) for tri in ([a, b, c] if i % 2 else [c, b, a] for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])))]
    got = G.dissolve_polygons(spark.createDataFrame(rows, "field string, rings array<array<struct<x: double, y: double>>>"), "field").collect()
    assert [(x.field, x.area, x.holes) for x in got] == [("t", 4.0, 0)]
    assert sorted(set(parsed(got[0].wkt)[0])) == sorted(corners)


def test_long_rings(spark):
    """A comb of 300 teeth: one ring of over a thousand sides, over several partitions."""
    cells = [("comb", 0, c) for c in range(600)] + [("comb", 1, c) for c in range(0, 600, 2)]
    got = G.dissolve_polygons(cells_table(spark, cells).repartition(4), "field").collect()
    assert [(x.area, x.holes) for x in got] == [(900.0, 0)]
    assert 1190 < len(parsed(got[0].wkt)[0]) < 1210


def test_holes_find_their_part_without_rings(spark, monkeypatch):
    """Holes behind holes, an island in a hole that bends around it, and a part far longer than the rest; no ring is joined."""
    monkeypatch.setattr(G, "box_join", None)
    gone = {(2, c) for c in range(2, 400, 3)} | {(r, c) for r in range(5, 12) for c in range(50, 57) if max(abs(r - 8), abs(c - 53)) in (2, 3)} | {(8, 53)} | {(6, 70), (7, 71)}
    cells = [("wide", r, c) for r in range(14) for c in range(402) if (r, c) not in gone] + [("wide", 30 + 2 * i, 2 * i) for i in range(20)]
    got = G.dissolve_polygons(cells_table(spark, cells), "field").collect()
    assert sorted(((x.area, x.holes) for x in got), reverse=True)[:2] == [(14 * 402 - len(gone) - 8, 133 + 1 + 1), (8.0, 1)]
    assert len(got) == 22 and sum(x.area for x in got) == len(cells)


def test_nothing_to_dissolve(spark):
    assert G.dissolve_polygons(cells_table(spark, []), "field").collect() == []
    assert G.intersection_areas(table(spark, {}), table(spark, {}), 1.0, 1.0).collect() == []
    assert G.covered_cells(table(spark, {}), Grid(0, 0.0, 1.0, 1.0, 1.0, 1, 1)).collect() == []
