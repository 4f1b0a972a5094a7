"""Operators against brute force and closed forms."""

import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reachspark.functions import algebra
from reachspark.grid import Grid
from reachspark.operators import align, cellstats, knn, nearest, order, polygons, regions, routes, stencil, volume
from reachspark.session import cut

R, C = 40, 50
GRID = Grid(R, C)


@pytest.fixture(scope="module")
def mask(spark):
    rng = np.random.default_rng(0)
    m = rng.random((R, C)) < 0.55
    r, c = np.nonzero(m)
    pdf = pd.DataFrame({"r": r.astype("int32"), "c": c.astype("int32"), "v": rng.random(len(r))})
    return m, spark.createDataFrame(pdf).cache()


def flood_fill(m, connectivity):
    label = -np.ones(m.shape, int)
    for i in range(m.shape[0]):
        for j in range(m.shape[1]):
            if not m[i, j] or label[i, j] >= 0:
                continue
            stack = [(i, j)]
            label[i, j] = i * m.shape[1] + j
            while stack:
                a, b = stack.pop()
                for da in (-1, 0, 1):
                    for db in (-1, 0, 1):
                        if connectivity == 4 and da and db:
                            continue
                        x, y = a + da, b + db
                        if 0 <= x < m.shape[0] and 0 <= y < m.shape[1] and m[x, y] and label[x, y] < 0:
                            label[x, y] = label[i, j]
                            stack.append((x, y))
    return label


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("options", [{"tile": 128}, {"tile": 8}, {"tile": 8, "one_task_edges": 3}])
def test_regions_equal_flood_fill(mask, connectivity, options):
    m, cells = mask
    want = flood_fill(m, connectivity)
    got = regions.label_regions(cells, GRID, connectivity, **options).toPandas()
    assert len(got) == m.sum()
    assert (want[got.r, got.c] == got.label).all()


def test_regions_are_labelled_per_key(grid_table):
    cells = grid_table([[1, 1, None, 1]], q=1.0).unionByName(grid_table([[1, 1, 1, 1]], q=2.0))
    got = regions.label_regions(cells, Grid(1, 4), keys=["q"], tile=2)
    assert sorted((x["q"], x["c"], x["label"]) for x in got.collect()) == [(1, 0, 0), (1, 1, 0), (1, 3, 3), (2, 0, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)]


def test_disconnected_rules(grid_table):
    cells = grid_table([[1, 1, 1, None, 1, None, 1, 1]])
    labelled = regions.label_regions(cells, Grid(1, 8))
    assert {x["c"] for x in regions.disconnected(labelled).collect()} == {4, 6, 7}
    target = cells.filter("c = 4")
    assert {x["c"] for x in regions.disconnected(labelled, target).collect()} == {0, 1, 2, 6, 7}
    nowhere = target.withColumn("c", F.lit(5))
    assert {x["c"] for x in regions.disconnected(labelled, nowhere).collect()} == {4, 6, 7}
    assert regions.disconnected(labelled.filter("c > 99")).count() == 0


def test_nearest_source_is_exact_with_ties(mask):
    _, cells = mask
    sources = cells.filter("v < 0.03")
    got = nearest.nearest_source(stencil.grid_cells(cells, GRID), sources, GRID, block_cells=300).toPandas()
    s = sources.toPandas().sort_values(["r", "c"]).reset_index(drop=True)
    d2 = (got.r.to_numpy()[:, None] - s.r.to_numpy()) ** 2 + (got.c.to_numpy()[:, None] - s.c.to_numpy()) ** 2
    pick = d2.argmin(axis=1)
    assert len(got) == R * C
    assert np.allclose(np.sqrt(d2.min(axis=1)), got.dist)
    assert (s.r[pick].to_numpy() == got.src_r).all() and (s.c[pick].to_numpy() == got.src_c).all()
    assert np.allclose(s.v[pick], got.v)


def test_nearest_source_on_anisotropic_cells_and_keys(grid_table):
    g = Grid(3, 3, dx=2.0, dy=0.5)
    cells = grid_table([[1, None, None], [None, None, None], [None, None, 5]], q=1.0).unionByName(grid_table([[None, 7, None]], q=2.0))
    got = nearest.nearest_source(stencil.grid_cells(cells, g, ["q"]), cells, g, keys=["q"])
    rows = {(x["q"], x["r"], x["c"]): (x["v"], x["dist"]) for x in got.collect()}
    assert len(rows) == 18
    assert rows[(1.0, 2, 0)] == (1.0, 1.0) and rows[(1.0, 0, 2)] == (5.0, 1.0)
    assert rows[(2.0, 2, 1)] == (7.0, 1.0)


@pytest.mark.parametrize("tile", [4, 64])
def test_nearest_k_is_exact(mask, tile):
    _, cells = mask
    sources = cells.filter("v < 0.03")
    got = knn.nearest_k(stencil.grid_cells(cells, GRID), sources, GRID, 5, tile=tile).toPandas().sort_values(["r", "c", "rank"])
    s = sources.toPandas()
    one = got[got["rank"] == 1]
    want = np.sort(np.sqrt((one.r.to_numpy()[:, None] - s.r.to_numpy()) ** 2 + (one.c.to_numpy()[:, None] - s.c.to_numpy()) ** 2), axis=1)[:, :5]
    assert len(got) == R * C * 5
    assert np.allclose(want.ravel(), got.d)


def test_sources_in_one_corner(spark, monkeypatch):
    """Far targets see the near side of a crowd in chunks of bounded size; the result stays exact."""
    grid, rng = Grid(200, 200), np.random.default_rng(4)
    crowd = spark.createDataFrame([(int(r), int(c), float(r + c)) for r in range(48) for c in range(48)], "r int, c int, v double")
    ask = spark.createDataFrame([(int(r), int(c)) for r, c in {*map(tuple, rng.integers(0, 200, (60, 2)).tolist()), (199, 199), (0, 0)}], "r int, c int")
    pairs = knn.tile_pairs(ask, crowd, grid, 7, (), 16).groupBy("tr", "tc").agg(F.sum("n").alias("n")).toPandas()
    far = pairs[(pairs.tr > 5) | (pairs.tc > 5)]
    assert (far.n < 48 * 48).all() and far.n.max() >= 7
    monkeypatch.setattr(knn, "SOURCES", 100)
    got = knn.nearest_k(ask, crowd, grid, 7).toPandas().sort_values(["r", "c", "rank"])
    s = crowd.toPandas().sort_values(["r", "c"])
    for (r, c), mine in got.groupby(["r", "c"]):
        d = np.hypot(s.r - r, s.c - c).to_numpy()
        pick = np.argsort(d, kind="stable")[:7]
        assert np.allclose(mine.d, d[pick])
        assert list(zip(mine.src_r, mine.src_c)) == list(zip(s.r.iloc[pick], s.c.iloc[pick]))
    assert len(got) == 7 * ask.count()


def test_variogram_covers_all_lags(mask):
    _, cells = mask
    bins = knn.variogram_bins(cells, GRID, 5, sample=400, max_lag=20.0).orderBy("lag").toPandas()
    assert bins.lag.tolist() == [0, 1, 2, 3, 4] and bins.d.is_monotonic_increasing and (bins.pairs > 100).all()
    again = knn.variogram_bins(cells, GRID, 5, sample=400, max_lag=20.0).orderBy("lag").toPandas()
    assert again.equals(bins)


def test_fewer_sources_than_k(grid_table):
    cells = grid_table([[2.0, None, None, 4.0]])
    got = {x["c"]: x["v"] for x in knn.idw(stencil.grid_cells(cells, Grid(1, 4)), cells, Grid(1, 4), tile=1).collect()}
    assert got[0] == pytest.approx(2.0) and got[3] == pytest.approx(4.0)
    assert got[1] == pytest.approx((2.0 / 1 + 4.0 / 4) / (1 + 1 / 4))


def test_kriging_honours_data_and_bounds(mask):
    _, cells = mask
    sources = cells.filter("v < 0.2")
    got = knn.kriging(stencil.grid_cells(cells, GRID), sources, GRID, parameters=(1.0, 12.0, 0.0)).toPandas()
    at = got.merge(sources.toPandas(), on=["r", "c"], suffixes=("", "_s"))
    assert len(got) == R * C
    assert np.allclose(at.v, at.v_s, atol=1e-9)
    assert (got.variance > -1e-9).all()
    flat = knn.kriging(sources, sources.withColumn("v", F.lit(3.0)), GRID, parameters=(1.0, 12.0, 0.1)).toPandas()
    assert np.allclose(flat.v, 3.0)


def test_kriging_fits_every_model(mask):
    _, cells = mask
    bins = knn.variogram_bins(cells.filter("v < 0.1"), GRID, 6).cache()
    for model in knn.VARIOGRAMS:
        p, span, nugget = knn.fit_variogram(bins, model)
        assert p > 0 and span > 0 and nugget >= 0


def dijkstra(m, seeds, connectivity, may, towards):
    dist = np.full(m.shape, np.inf)
    heap = []
    for a, b in seeds:
        dist[a, b] = 0
        heapq.heappush(heap, (0.0, a, b))
    steps = routes.STEPS[:4] if connectivity == 4 else routes.STEPS
    while heap:
        d, a, b = heapq.heappop(heap)
        if d > dist[a, b]:
            continue
        for i, (da, db) in enumerate(steps):
            x, y = (a - da, b - db) if towards else (a + da, b + db)
            if not (0 <= x < m.shape[0] and 0 <= y < m.shape[1] and m[x, y]):
                continue
            if (may[x, y, i] if towards else may[a, b, i]) and d + math.hypot(da, db) < dist[x, y] - 1e-12:
                dist[x, y] = d + math.hypot(da, db)
                heapq.heappush(heap, (dist[x, y], x, y))
    return dist


@pytest.mark.parametrize("connectivity,towards,u_max", [(4, False, None), (8, True, None), (8, False, 0.8), (4, True, 0.8)])
@pytest.mark.parametrize("tile", [128, 16])
def test_routes_equal_dijkstra(spark, connectivity, towards, u_max, tile):
    rng = np.random.default_rng(1)
    m = rng.random((R, C)) < 0.8
    ux, uy = rng.normal(size=(R, C)), rng.normal(size=(R, C))
    r, c = np.nonzero(m)
    cells = spark.createDataFrame(pd.DataFrame({"r": r.astype("int32"), "c": c.astype("int32"), "ux": ux[m], "uy": uy[m]}))
    seeds = [(int(r[0]), int(c[0])), (int(r[700]), int(c[700]))]
    source = spark.createDataFrame(pd.DataFrame(seeds, columns=["r", "c"]).astype("int32"))
    may = np.ones((R, C, 8), bool)
    rule = None
    if u_max is not None:
        rule = routes.travel_rule(GRID, u_max)
        for i, (da, db) in enumerate(routes.STEPS):
            may[:, :, i] = (ux * db - uy * da) / math.hypot(da, db) >= -u_max
    want = dijkstra(m, seeds, connectivity, may, towards)
    got = routes.least_cost_distance(cells, source, GRID, connectivity, rule, towards, tile=tile).toPandas()
    assert len(got) == np.isfinite(want).sum()
    assert np.allclose(want[got.r, got.c], got.cost)


def test_corridor_writes_border_cells_only(spark, monkeypatch):
    """A corridor over 16 tiles: rounds write what crosses a border, not the cells."""
    written = []
    monkeypatch.setattr(routes, "cut", lambda df: written.append(kept := cut(df)) or kept)
    cells = spark.createDataFrame([(1, c) for c in range(320)], "r int, c int")
    got = routes.least_cost_distance(cells, cells.filter("c = 0"), Grid(3, 320), tile=32)
    assert {x["c"]: x["cost"] for x in got.collect()} == {c: float(c) for c in range(320)}
    assert written[0].count() == 10 and sum(t.count() for t in written[1:]) <= 12 * 10


@pytest.mark.parametrize("radius", [0.0, 0.5, 1.0, 2.5, 5.0, 19.0, 200.0])
def test_within_radius_equals_distances(mask, radius):
    m, cells = mask
    g = Grid(R, C, dx=1.0, dy=2.0)
    src = cells.filter("v < 0.02").union(cells.filter("v < 0.01"))
    s = src.toPandas()
    rr, cc = np.mgrid[:R, :C]
    near = np.sqrt(((rr[..., None] - s.r.to_numpy()) * 2.0) ** 2 + (cc[..., None] - s.c.to_numpy()) ** 2).min(axis=2) <= radius
    got = stencil.within_radius(src, g, radius).toPandas()
    assert len(got) == near.sum() and near[got.r, got.c].all() and not got.duplicated().any()


@pytest.mark.parametrize("window", [1, 4, 15, 60])
def test_focal_fraction_of_any_window(mask, window):
    m, cells = mask
    got = stencil.focal_fraction(cells.withColumn("present", F.col("v") > 0.7), GRID, window).toPandas()
    v = np.full((R, C), np.nan)
    t = cells.toPandas()
    v[t.r, t.c] = t.v > 0.7
    for row in got.sample(60, random_state=1).itertuples():
        box = v[max(row.r - window, 0) : row.r + window + 1, max(row.c - window, 0) : row.c + window + 1]
        assert row.fraction == pytest.approx(np.nanmean(box))
    assert not got.duplicated(["r", "c"]).any() and got.r.between(0, R - 1).all() and got.c.between(0, C - 1).all()
    assert len(got) == R * C if window > 4 else len(got) > 0


def test_slope_of_planes(grid_table):
    ramp = grid_table([[c for c in range(6)] for _ in range(5)])
    assert all(x["slope"] == pytest.approx(45.0) for x in stencil.slope(ramp, Grid(5, 6)).collect())
    flat = grid_table([[3.0] * 6] * 5)
    assert all(x["slope"] == 0 for x in stencil.slope(flat, Grid(5, 6), "PERCENT").collect())


def test_focal_fraction_counts_existing_neighbours(grid_table, as_grid):
    ones = grid_table([[1] * 5] * 5).withColumn("present", F.col("c") >= 3)
    got = as_grid(stencil.focal_fraction(ones, Grid(5, 5)), 5, 5, "fraction")
    assert got[0][4] == 1.0 and got[2][2] == pytest.approx(1 / 3) and got[0][0] == 0.0
    assert stencil.focal_fraction(ones, Grid(5, 5), 0).agg(F.sum("fraction")).first()[0] == 10


@pytest.mark.parametrize(
    "z,plane,dx,dy,expect,area",
    [
        (lambda r, c: 5.0, 0.0, 1, 1, 500.0, 100.0),
        (lambda r, c: float(c), 0.0, 1, 1, 500.0, 100.0),
        (lambda r, c: c - 5.0, 0.0, 1, 1, 125.0, 50.0),
        (lambda r, c: 5.0, 2.0, 1, 1, 300.0, 100.0),
        (lambda r, c: 4.0, 0.0, 2, 0.5, 400.0, 100.0),
        (lambda r, c: 5.0 if r else None, 0.0, 1, 1, 450.0, 90.0),
    ],
)
def test_volumes_in_closed_form(grid_table, z, plane, dx, dy, expect, area):
    cells = grid_table([[z(r, c) for c in range(11)] for r in range(11)])
    got = volume.surface_volume(cells, Grid(11, 11, dx, dy), plane).first()
    assert got["volume"] == pytest.approx(expect) and got["area_2d"] == pytest.approx(area)


def test_draped_area_of_tilted_planes(grid_table):
    one = grid_table([[float(c) for c in range(11)] for _ in range(11)])
    both = grid_table([[float(c + r) for c in range(11)] for r in range(11)])
    g = Grid(11, 11)
    assert volume.surface_volume(one, g, -1000).first()["area_3d"] == pytest.approx(100 * 2**0.5)
    assert volume.surface_volume(both, g, -1000).first()["area_3d"] == pytest.approx(100 * 3**0.5)
    old = volume.surface_volume(both, g, -1000, legacy_draped=True).first()
    assert old["area_3d"] == pytest.approx(50 * 3**0.5 + 50 * 2**0.5)
    below = volume.surface_volume(one, g, 5.0, "BELOW").first()
    assert below["volume"] == pytest.approx(125.0)


def test_row_major_numbers(mask):
    _, cells = mask
    got = order.row_major_index(cells, GRID, block=7).toPandas().sort_values(["r", "c"])
    assert (got.idx.to_numpy() == np.arange(len(got))).all()
    assert order.thin(cells, GRID, 3).count() == -(-len(got) // 3)


def test_cell_statistics_strict_range(table):
    stack = table([(1, 0, 0, 1.0), (2, 0, 0, 4.0), (1, 0, 1, 2.0)], "q int, r int, c int, v double")
    loose = {x["c"]: x["v"] for x in cellstats.cell_statistics(stack, "RANGE").collect()}
    strict = {x["c"]: x["v"] for x in cellstats.cell_statistics(stack, "RANGE", False, 2).collect()}
    assert loose == {0: 3.0, 1: 0.0} and strict == {0: 3.0, 1: None}
    with pytest.raises(ValueError):
        cellstats.cell_statistics(stack, "MODE")


def test_align_round_trip_and_bilinear_plane(mask):
    _, cells = mask
    fine = Grid(R * 2, C * 2, 0.5, 0.5)
    there = align.align_nearest(cells, GRID, fine)
    assert there.count() == cells.count() * 4
    back = align.align_nearest(there, fine, GRID)
    assert back.select("r", "c", "v").exceptAll(cells.select("r", "c", "v")).count() == 0 and back.count() == cells.count()
    plane = stencil.grid_cells(cells, GRID).withColumn("v", F.col("r") * 3.0 + F.col("c"))
    shifted = align.align_bilinear(plane, GRID, Grid(R - 2, C - 2, 1.0, 1.0, 0.75, -0.25))
    assert shifted.filter(F.abs(F.col("v") - ((F.col("r") + 0.25) * 3 + F.col("c") + 0.75)) > 1e-9).count() == 0
    assert shifted.count() == (R - 2) * (C - 2)


def test_rasterize_order_and_touch(table):
    box = lambda i, x, y, s: [(i, 0, k, float(a), float(b)) for k, (a, b) in enumerate([(x, y), (x + s, y), (x + s, y - s), (x, y - s), (x, y)])]
    shapes = table(box(1, 0, 0, 4) + box(2, 2, -2, 4), "poly_id int, ring int, seq int, x double, y double")
    names = table([(1, 10, 1), (2, 20, 2)], "poly_id int, gridcode int, seq int")
    got = {(x["r"], x["c"]): x["v"] for x in polygons.rasterize(shapes, names, Grid(8, 8)).collect()}
    assert len(got) == 28 and got[(0, 0)] == 10 and got[(2, 2)] == 20 and got[(5, 5)] == 20
    sliver = table(box(1, 1.1, -1.1, 0.2), "poly_id int, ring int, seq int, x double, y double")
    assert polygons.polygon_cells(sliver, Grid(4, 4)).count() == 0
    assert [(x["r"], x["c"]) for x in polygons.polygon_cells(sliver, Grid(4, 4), True).collect()] == [(1, 1)]


def ring_area(rows):
    rows = sorted(rows, key=lambda x: x["seq"])
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(rows, rows[1:])) / 2


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("limit", [500_000, 30])
def test_outlines_enclose_their_regions(mask, connectivity, limit):
    _, cells = mask
    labelled = regions.label_regions(cells, GRID, connectivity).cache()
    rings = {}
    for x in polygons.outlines(labelled, GRID, connectivity, one_task_sides=limit).collect():
        rings.setdefault((x["label"], x["ring"]), []).append(x)
    area, outer = {}, {}
    for (label, _), rows in rings.items():
        first, last = min(rows, key=lambda x: x["seq"]), max(rows, key=lambda x: x["seq"])
        assert (first["x"], first["y"]) == (last["x"], last["y"])
        a = ring_area(rows)
        area[label] = area.get(label, 0.0) - a
        outer[label] = outer.get(label, 0) + (a < 0)
    want = {x["label"]: x["cells"] for x in regions.region_sizes(labelled).collect()}
    assert {k: round(v) for k, v in area.items()} == want
    assert all(n == 1 for n in outer.values())


def test_curve_holds_left_and_drops_right(table):
    curve = [(2.4, 1.0), (0.25, 0.0), (0.8, 1.0), (5.0, 0.4), (7.9, 0.2)]
    df = table([(x,) for x in (0.0, 0.525, 1.0, 3.7, 7.9, 8.0, None)], "v double").select("v", algebra.apply_curve("v", curve).alias("y"))
    got = [x["y"] for x in df.collect()]
    assert got == [0.0, pytest.approx(0.5), 1.0, pytest.approx(0.7), pytest.approx(0.2), 0.0, None]
