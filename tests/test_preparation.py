"""Preparation of conditions: inputs that are invalid everywhere, and grids stored as text."""

import pytest
from pyspark.sql import functions as F

from reachspark.grid import Grid
from reachspark.plans import preparation, recruitment
from reachspark.session import Guard, scratch_path
from reachspark.sources import textgrids


@pytest.mark.parametrize("h,fails", [(0.0, True), (1.0, False)])
def test_shear_that_is_invalid_everywhere_fails_after_the_pass(table, h, fails):
    hyd = table([(q, 0, c, h, 1.0) for q in (1.0, 2.0) for c in range(3)], "q double, r int, c int, h double, u double")
    grain = table([(0, c, 0.05) for c in range(3)], "r int, c int, v double")
    guard = Guard("bed shear is invalid at every discharge")
    preparation.bed_shear_stress(hyd, grain, guard=guard).collect()
    other = Guard("bed shear is NoData everywhere")
    recruitment.mobilising_discharge(hyd, grain, {"q_full": 0.047}, guard=other).collect()
    for g in (guard, other):
        if fails:
            with pytest.raises(ValueError, match="bed shear is"):
                g.verify()
        else:
            g.verify()


def test_text_grids_in_many_splits(spark, tmp_path):
    """Lines keep their rows when files are cut in small splits; headers differ in form."""
    rows = [[r * 10 + c if (r + c) % 3 else -9999 for c in range(5)] for r in range(300)]
    text = "NCOLS 5\nNROWS 300\nXLLCENTER 10\nYLLCENTER 20\nCELLSIZE 2\nNODATA_VALUE -9999\n"
    (tmp_path / "dem one.asc").write_text(text + "\n".join("  ".join(map(str, x)) for x in rows) + "\n\n")
    (tmp_path / "tiny.txt").write_text("ncols 2\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 1\n1.5 -999\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        cells, grids = textgrids.read_text_grids(spark, str(tmp_path))
        got = {(x["layer"], x["r"], x["c"]): x["v"] for x in cells.collect()}
        heads = {x["layer"]: x for x in grids.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("dem one", r, c): float(v) for r, line in enumerate(rows) for c, v in enumerate(line) if v != -9999}
    assert got == want | {("tiny", 0, 0): 1.5}
    one = heads["dem one"]
    assert (one["x0"], one["y0"], one["dx"], one["nrows"], one["ncols"]) == (9.0, 619.0, 2.0, 300, 5)


def test_text_grids_round_trip(spark, table):
    """Empty rows, NULL and NaN cells, and a layer name with a space."""
    cells = table([("a b", 0, 0, 1.25), ("a b", 2, 1, -3e-7), ("z", 1, 2, None), ("z", 0, 2, float("inf")), ("z", 0, 1, 7.0)], "layer string, r int, c int, v double")
    cells = cells.withColumn("v", F.when(F.col("v") == float("inf"), F.lit(float("nan"))).otherwise(F.col("v")))
    grids = table([("a b", 3, 2, 0.5, 9.0, 1.0, 1.0), ("z", 2, 3, 0.0, 0.0, 3.0, 2.0), ("none", 2, 2, 0.0, 0.0, 1.0, 1.0)], "layer string, nrows int, ncols int, x0 double, y0 double, dx double, dy double")
    path = scratch_path(spark)
    textgrids.write_text_grids(cells, grids, path)
    back, heads = textgrids.read_text_grids(spark, path)
    assert {tuple(x) for x in back.collect()} == {("a b", 0, 0, 1.25), ("a b", 2, 1, -3e-7), ("z", 0, 1, 7.0)}
    assert {tuple(x)[:7] for x in heads.collect()} == {(x["layer"], x["nrows"], x["ncols"], x["x0"], x["y0"], x["dx"], x["dy"]) for x in grids.collect()}


def test_products_by_name(spark, table):
    """Every product is dispatched; a missing input is named."""
    days = spark.sql("SELECT make_date(2020, 1, 1) + CAST(id AS INT) d, CAST(id % 50 AS DOUBLE) q FROM range(0, 366)")
    seasons = table([("Chinook", "fry", 1, 1, 3, 31)], "species string, lifestage string, start_m int, start_d int, end_m int, end_d int")
    qs = table([(10.0,), (20.0,)], "q double")
    found = preparation.build_product("flows", flow=days, seasons=seasons, discharges=qs)["duration"].collect()
    assert {x["q"] for x in found} == {10.0, 20.0} and all(0 < x["exceedance"] < 100 for x in found)
    lines = preparation.build_product("inp", discharges=table([(1, 10.0), (1, 20.0)], "condition int, q double"))["definitions"]
    assert lines.filter("line LIKE '%h000010.tif%h000020.tif%'").count() == 1
    layers = table([("a", r, c, 1.0) for r in range(4) for c in range(4)], "layer string, r int, c int, v double")
    moved = preparation.build_product("align", layers=layers, layer_grids={"a": Grid(4, 4, 1.0, 1.0, 0.0, 4.0)}, grid=Grid(2, 2, 2.0, 2.0, 0.0, 4.0))["layers"]
    assert moved.count() == 4 and {x["status"] for x in moved.collect()} == {"aligned"}
    with pytest.raises(ValueError, match="needs seasons, discharges"):
        preparation.build_product("flows", flow=days)
    with pytest.raises(ValueError, match="unknown product"):
        preparation.build_product("none")
