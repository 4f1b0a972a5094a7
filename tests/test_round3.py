"""Findings of round 3: rounds of routes, rows of the nearest source."""

from __future__ import annotations

import numpy as np

from reachspark.grid import Grid
from reachspark.operators import nearest, polygons, regions, routes
from reachspark.plans import lifespan, recruitment
from reachspark.queries.q_plans import lifespans
from reachspark.queries.registry import Data
from reachspark.sources.lookup import RecruitmentParameters


def test_small_tiles_do_not_cost_a_round_each(spark, monkeypatch):
    """A route through 16 small tiles needs no round between them; with every tile on its own the costs are the same."""
    cells = spark.range(4 * 64).selectExpr("cast(id div 64 as int) r", "cast(id % 64 as int) c")
    written = []
    monkeypatch.setattr(routes, "cut", lambda df, keep=routes.cut: written.append(1) or keep(df))
    ways = lambda: {(x["r"], x["c"]): x["cost"] for x in routes.least_cost_distance(cells, cells.filter("c = 0"), Grid(4, 64), tile=4).collect()}
    joined, rounds = ways(), len(written)
    assert rounds <= 3 and joined[3, 63] == 63.0 and len(joined) == 256
    written.clear()
    monkeypatch.setattr(routes, "JOINED", 1)
    assert ways() == joined and len(written) > 10


def test_best_columns_of_many_rows_at_once():
    rng = np.random.default_rng(3)
    tc, sc, row_t, row_s = [], [], [], []
    for row in range(40):
        t, s = (np.flatnonzero(rng.random(30) < p) for p in (0.6, 0.3))
        t, s = (x if len(x) else np.array([row % 30]) for x in (t, s))
        tc.append(t), sc.append(s), row_t.append(np.full(len(t), row)), row_s.append(np.full(len(s), row))
    tc, sc, row_t, row_s = (np.concatenate(x) for x in (tc, sc, row_t, row_s))
    source = rng.integers(0, 40, len(sc))
    g2, rank = (source - row_s) ** 2, source * 30 + sc
    rows, lo, size = np.unique(row_t, return_index=True, return_counts=True)
    ranges = lo, lo + size, np.searchsorted(row_s, rows), np.searchsorted(row_s, rows, "right") - 1
    best, d2 = nearest._best_columns(tc, sc, g2, rank, 1.0, ranges)
    for i in range(len(tc)):
        own = np.flatnonzero(row_s == row_t[i])
        least = min(own, key=lambda j: ((tc[i] - sc[j]) ** 2 + g2[j], rank[j]))
        assert (d2[i], rank[best[i]]) == ((tc[i] - sc[least]) ** 2 + g2[least], rank[least])


def test_all_seasons_meet_a_tile_in_one_row(spark):
    """A tile's cells are shuffled once for all its seasons, not once for each."""
    dem = spark.range(16).selectExpr("cast(id div 4 as int) r", "cast(id % 4 as int) c", "10.0D v")
    wle = dem.selectExpr("r", "c", "explode(array(1000D, 2000D)) q").selectExpr("*", "q / 100 wle")
    flow = spark.sql("select explode(sequence(date '1994-01-01', date '1996-12-31')) d").selectExpr("d", "1000D + dayofyear(d) q")
    p = RecruitmentParameters()
    tiles, _ = recruitment._season_tiles(dem, wle, flow, p, (1995, 1996), "us", None, [], [], "error")
    assert tiles.count() == 1
    crop = recruitment.crop_area(dem, wle, flow, p, (1995, 1996), discharges=[1000.0, 2000.0])
    assert sorted(crop.select("year").distinct().collect()) == sorted(recruitment.crop_area(dem, wle, flow, p, (1995, 1996)).select("year").distinct().collect())


def test_regions_are_measured_in_their_tiles(spark, table):
    """Cells, area and perimeter of regions across tile borders are those of the labelled cells."""
    rng = np.random.default_rng(5)
    rows = [(k, r, c, int(rng.random() < 0.55)) for k in "ab" for r in range(21) for c in range(19) if rng.random() < 0.9]
    cells, grid = table(rows, "k string, r int, c int, gridcode int"), Grid(21, 19)
    for way in (4, 8):
        labelled = regions.label_regions(cells, grid, way, "gridcode", ["k"], tile=8)
        want = polygons.polygonize(cells, grid, keys=["k"], labelled=labelled)
        got = regions.region_measures(cells, grid, way, "gridcode", ["k"], tile=8)
        sides = {(x["k"], x["label"]): (x["gridcode"], x["cells"], x["flat"] * abs(grid.dx) + x["steep"] * abs(grid.dy)) for x in got.collect()}
        assert sides == {(x["k"], x["label"]): (x["gridcode"], x["cells"], x["perimeter"]) for x in want.collect()}


def test_best_features_are_chosen_before_they_become_rows(spark):
    data = Data(spark, "/root/testdata/sf0.001")
    got = lifespans(data, best=True)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    rows = lambda df: sorted((x["r"], x["c"], x["fid"], x["lifespan"]) for x in df.collect())
    assert rows(got) == rows(lifespan.best_cells(lifespans(data)))
