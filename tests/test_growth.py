"""Steps whose tasks or files once grew with the table."""

import pandas as pd

from reachspark.operators import polygons
from reachspark.grid import Grid
from reachspark.plans import channels
from reachspark.session import deal
from reachspark.sources import definitions, flow


def test_equal_reaches_are_designed_once(table):
    sizes = pd.DataFrame({"a": [1.0, 2.0, 1.0, None, None], "b": [3.0, 4.0, 3.0, 5.0, 5.0]})
    distinct, place = channels.distinct_sizes(sizes)
    assert len(distinct) == 3 and place.tolist() == [0, 1, 0, 2, 2]
    rows = [(i, 0.05, 0.005, 10.0, 2.58, 0.3 if i % 2 else 50.0) for i in range(6)]
    reaches = table(rows, "reach_id bigint, d50 double, slope double, base_width double, bank_slope double, target_depth double")
    got = {x["reach_id"]: x for x in channels.design_pool_riffle(reaches).collect()}
    assert [got[i]["converged"] for i in range(6)] == [False, True] * 3 and got[1]["iterations"] == got[5]["iterations"] == 2852


def test_stored_curves_make_no_folder_a_gauge(spark, table, tmp_path):
    rows = table([(g, f"2000-01-{d:02d}", float(d * g)) for g in range(1, 40) for d in range(1, 4)], "gauge int, d string, q double")
    flow.write_duration(flow.numbered_curve(rows, ["gauge"]), str(tmp_path / "curves"), keys=["gauge"])
    assert not [p for p in (tmp_path / "curves").iterdir() if p.is_dir()]
    got = flow.read_duration(spark.read.parquet(str(tmp_path / "curves")), ["gauge"])
    assert got.count() == 117 and sorted(x["q"] for x in got.filter("gauge = 7").collect()) == [7.0, 14.0, 21.0]


def test_dealt_rows_keep_their_width(spark):
    rows = deal(spark.range(100), "id")
    assert rows.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    curve = flow.numbered_curve(spark.range(100).selectExpr("id % 9 gauge", "id d", "double(id) q"), ["gauge"])
    assert curve.rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_polygons_are_dealt_out_before_they_become_cells(spark, table):
    corners = [(0, 0.2, -0.2), (1, 3.7, -0.2), (2, 3.7, -3.7), (3, 0.2, -3.7), (4, 0.2, -0.2)]
    shapes = table([(p, 0, s, x, y) for p in (1, 2) for s, x, y in corners], "poly_id bigint, ring int, seq int, x double, y double")
    codes = table([(1, 5, 1), (2, 6, 2)], "poly_id bigint, gridcode int, seq int")
    burned = polygons.rasterize(shapes, codes, Grid(8, 8), all_touched=True)
    assert burned.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert {(x["r"], x["c"], x["v"]) for x in burned.collect()} == {(r, c, 6) for r in range(4) for c in range(4)}
    assert polygons.polygon_cells(shapes, Grid(8, 8), True).count() == 32


def test_problems_without_a_condition_or_twice(table):
    told = table([(1, "depth_rasters", 0, "h1"), (1, "depth_rasters", 1, "h1"), (1, "dem_raster", 0, "x")], "condition int, attribute string, pos int, item string")
    there = table([(1, "x.tif"), (2, "h000100.tif"), (2, "dem.tif"), (2, "dmean.tif"), (None, "dem.tif")], "condition int, name string")
    got = sorted((x["condition"] or 0, x["problem"], x["detail"]) for x in definitions.validate(told, there).collect())
    assert got == [
        (0, "missing dem", "dem.tif"), (0, "missing dmean", "dmean.tif"), (0, "no definitions", ""), (0, "no depth layer", ""), (0, "no velocity layer", ""),
        (1, "missing dmean", "dmean.tif"), (1, "named but absent", "h1.tif"), (1, "named but absent", "h1.tif"), (1, "no depth layer", ""), (1, "no velocity layer", ""),
        (2, "depth without velocity", "100"), (2, "no definitions", ""), (2, "no velocity layer", ""),
    ]
