"""Domain pipelines on small cases with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachspark import constants as K
from reachspark.functions import channel, shear
from reachspark.grid import Grid
from reachspark.plans import channels, cost, duration, habitat, lifespan, preparation, recruitment, stranding, terrain
from reachspark.sources import definitions, flow, layers, lookup
from reachspark.sources.lookup import RecruitmentParameters, default_features


@pytest.fixture(scope="module")
def reach(spark):
    """8 x 10 cells of 1 m; velocity doubles with every flood, the right half lies high."""
    cells = spark.range(80).select(F.floor(F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"))
    hyd = cells.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    hyd = hyd.select(((F.col("k") + 1) * 1000.0).alias("q"), "r", "c", F.lit(2.0).alias("h"), F.pow(F.lit(2.0), "k").alias("u"))
    ground = cells.select("r", "c", F.lit(0.05).alias("dmean"), F.when(F.col("c") < 5, 3.0).otherwise(30.0).alias("d2w"))
    floods = [lifespan.Flood(i, (i + 1) * 1000.0, p) for i, p in enumerate((2.0, 5.0, 10.0, 25.0))]
    return hyd, ground, floods


def test_lifespans_of_a_known_reach(reach):
    hyd, ground, floods = reach
    features = default_features()
    got = lifespan.lifespan_cells(hyd, floods, ground, [features["wil"], features["whi"], features["cot"]], "si")
    rows = {(x["fid"], x["c"]): x["lifespan"] for x in got.collect()}
    assert {c for _, c in rows} == set(range(5))
    theta = {}
    for k, u in enumerate((1, 2, 4, 8)):
        x = 2.0 / 0.11
        rr = 4.416 * x**1.904 * (1 + (x / 1.283) ** 1.618) ** -1.083
        chi = x / 2
        t = min(max((chi - 7) / 13, 0), 1)
        w = t * t * (3 - 2 * t)
        ll = 5.75 * math.log10(12.2 * chi)
        theta[k] = u * u * ((1 - w) / rr**2 + w / ll**2) / (9.81 * 1.68 * 0.11)
    period = lambda tau: next(p for k, p in enumerate((2, 5, 10, 25)) if theta[k] >= tau)
    assert rows[("wil", 0)] == period(0.1) == 25
    assert rows[("whi", 0)] == period(0.06) == 10
    assert rows[("cot", 0)] == 10  # u >= 3 first at the third flood
    split = lifespan.lifespan_cells(hyd, floods, ground, [features["wil"], features["whi"], features["cot"]], "si", per_pass=2)
    assert split.exceptAll(got).count() == 0 and split.count() == got.count()
    summary = lifespan.lifespan_summary(got, 1.0).filter("fid = 'wil'").first()
    assert summary["area"] == 40 and summary["median_lifespan"] == 25


def test_no_hydraulic_criterion_uses_the_longest_period(reach):
    hyd, ground, floods = reach
    f = lookup.Feature("x", "x", d2w_max=5.0)
    got = lifespan.lifespan_cells(hyd, floods, ground, [f], "si")
    assert {x["lifespan"] for x in got.collect()} == {25.0} and got.count() == 40
    with pytest.raises(ValueError):
        lifespan.lifespan_cells(hyd, floods, ground, [lookup.Feature("y", "y", det_min=1.0)], "si")


def test_best_feature_keeps_ties(table):
    life = table([(0, 0, "a", 5.0), (0, 0, "b", 5.0), (0, 1, "a", 2.0), (0, 1, "b", 9.0), (0, 1, "c", 1.0)], "r int, c int, fid string, lifespan double")
    assert sorted((x["c"], x["fid"]) for x in lifespan.best_cells(life).collect()) == [(0, "a"), (0, "b"), (1, "b")]
    rows = [(x["fid"], x["area"], x["share"], x["max_lifespan"]) for x in lifespan.best_summary(life, 2.0).collect()]
    assert rows == [("b", 4.0, 100.0, 9.0), ("a", 2.0, 50.0, 5.0), ("c", 0.0, 0.0, None)]


def strip(table, *flows):
    rows = [(q, 0, c, float(h)) for q, line in flows for c, h in enumerate(line)]
    return table(rows, "q double, r int, c int, h double")


def test_stranding_strip(table):
    hyd = strip(table, (2000.0, [1] * 9), (1000.0, [1, 1, 1, 1, 1, 1, 0, 1, 1]))
    got = stranding.stranding(hyd, Grid(1, 9), 0.5)
    rows = {x["q"]: x for x in got.per_discharge.collect()}
    assert (rows[2000.0]["pools"], rows[1000.0]["pools"]) == (0, 1)
    assert rows[1000.0]["stranded_area"] == 2 and rows[1000.0]["percent_stranded"] == 25.0
    assert rows[1000.0]["percent_of_max_wetted"] == pytest.approx(200 / 9)
    summary = got.summary.first()
    assert summary["worst_discharge"] == 1000.0 and summary["total_disconnected_area"] == 2
    assert [x["area"] for x in stranding.pools(got.stranded, Grid(1, 9), 1000.0).collect()] == [2.0]


def test_stranding_target_rule(table):
    hyd = strip(table, (3000.0, [1, 1, 1, 0, 1, 1, 1, 1, 1]), (500.0, [1, 1, 1, 0, 0, 0, 0, 0, 0]))
    low = {x["q"]: x["stranded_area"] for x in stranding.stranding(hyd, Grid(1, 9), 0.5).per_discharge.collect()}
    own = {x["q"]: x["stranded_area"] for x in stranding.stranding(hyd, Grid(1, 9), 0.5, target_q=False).per_discharge.collect()}
    assert low == {3000.0: 5.0, 500.0: 0.0} and own == {3000.0: 3.0, 500.0: 0.0}


@pytest.mark.parametrize("speed,lost", [(5.0, 5), (-5.0, 0)])
def test_stranding_chute(table, speed, lost):
    """A fast throat at column 4 (flow to the east) keeps fish from the mainstem on the left."""
    rows = [(500.0, 1, c, 1.0, 0.0, 0.0) for c in range(3)]
    rows += [(1000.0, 1, c, 1.0, speed if c == 4 else 0.0, 0.0) for c in range(9)]
    hyd = table(rows, "q double, r int, c int, h double, ux double, uy double")
    got = stranding.stranding(hyd, Grid(3, 9), 0.5, u_max=2.0)
    at = {x["q"]: (x["stranded_area"], x["pools"]) for x in got.per_discharge.collect()}
    assert at[1000.0] == (lost, 1 if lost else 0)
    if not lost:
        target = stranding.main_channel(got.labelled)
        cost_of = {x["c"]: x["cost"] for x in stranding.escape_routes(hyd, got.labelled, Grid(3, 9), target, 2.0).filter("q = 1000").collect()}
        assert [cost_of[c] for c in range(9)] == [0, 0, 0, 1, 2, 3, 4, 5, 6]


def test_components_agree_with_routes(spark):
    rng = np.random.default_rng(3)
    rows = [(float(q), r, c, 1.0) for q in (1, 2) for r in range(20) for c in range(20) if rng.random() < 0.6]
    hyd = spark.createDataFrame(rows, "q double, r int, c int, h double")
    g = Grid(20, 20)
    plain = stranding.stranding(hyd, g, 0.5)
    target = stranding.main_channel(plain.labelled)
    reached = stranding.escape_routes(hyd, plain.labelled, g, target)
    lost = plain.labelled.join(reached, ["q", "r", "c"], "left_anti").select("q", "r", "c")
    mine = plain.stranded.select("q", "r", "c")
    assert lost.exceptAll(mine).count() == 0 and mine.exceptAll(lost).count() == 0


def test_habitat_strip(table):
    rows = [(1000.0, 0, c, 0.0 if c == 0 else 1.0, 0.5) for c in range(4)] + [(2000.0, 0, c, 0.0 if c == 0 else 3.0, 2.0) for c in range(4)]
    hyd = table(rows, "q double, r int, c int, h double, u double")
    curve_h, curve_u = [(0.0, 0.0), (1.0, 1.0), (5.0, 0.0)], [(0.0, 1.0), (1.0, 1.0), (3.0, 0.0)]
    areas, total = habitat.habitat(hyd, curve_h, curve_u, 2.0, table([(1000.0, 100.0), (2000.0, 25.0), (9.0, 1.0)], "q double, exceedance double"))
    rows = {x["q"]: (x["usable_area"], x["mean_chsi"]) for x in areas.collect()}
    assert rows == {1000.0: (6.0, pytest.approx(1.0)), 2000.0: (6.0, pytest.approx(0.5))}
    assert total.first()[0] == pytest.approx(0.25 * 6 + 0.75 * 6)


def test_seasonal_area_orders_ties_by_discharge(table):
    areas = table([(3.0, 30.0), (1.0, 10.0), (2.0, 20.0)], "q double, usable_area double")
    curve = table([(3.0, 0.0), (2.0, 0.0), (1.0, 50.0)], "q double, exceedance double")
    assert habitat.seasonal_area(areas, curve).first()[0] == pytest.approx(5.0)
    assert habitat.seasonal_area(areas.filter("q > 9"), curve).first()[0] == 0.0


@pytest.mark.parametrize("rule,cells", [("fraction", 9), ("radius", 1)])
def test_cover_rules(grid_table, rule, cells):
    grain = grid_table([[0.1 if (r, c) == (4, 4) else 0.001 for c in range(9)] for r in range(9)]).withColumn("cover", F.lit("substrate"))
    got = habitat.cover_suitability(grain, {"cobbles": [(0.1, 0.4)]}, Grid(9, 9), "si", mineral_rule=rule)
    assert got.count() == cells and {x["cover"] for x in got.collect()} == {0.4}


def test_duration_curve_and_interpolation(table):
    days = table([(dt.date(2020, 1, i + 1).isoformat(), q) for i, q in enumerate((100.0, 200.0, 300.0, 400.0))], "t string, q double")
    record = days.select(F.to_date("t").alias("d"), "q")
    curve = duration.duration_curve(record)
    assert [(x["q"], x["exceedance"]) for x in curve.orderBy("rank").collect()] == [(400, 25), (300, 50), (200, 75), (100, 100)]
    asked = table([(150.0,), (400.0,), (50.0,), (500.0,), (100.0,)], "q double")
    got = {x["q"]: x["exceedance"] for x in duration.exceedance_at(curve, asked).collect()}
    assert got == {150.0: 87.5, 400.0: 25.0, 50.0: 100.0, 500.0: 0.0, 100.0: 100.0}


def test_flow_csv(spark, tmp_path):
    lines = ["Date,Mean daily", "yyyy-mm-dd,cfs", "2020-01-02,5", "2020-01-01,3", "2020-01-02,7", "bad,1", "2020-01-03,x"]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    got = flow.read_flow_csv(spark, str(tmp_path / "f.csv")).orderBy("d").collect()
    assert [(x["d"].isoformat(), x["q"]) for x in got] == [("2020-01-01", 3.0), ("2020-01-02", 7.0)]
    (tmp_path / "g.csv").write_text("a,b\nx,y\n")
    with pytest.raises(ValueError):
        flow.read_flow_csv(spark, str(tmp_path / "g.csv"))


def test_water_years_and_gumbel(table):
    record = table([("2019-09-30", 9.0), ("2019-10-01", 5.0), ("2020-09-30", 7.0), ("2020-10-01", 8.0)], "t string, q double").select(F.to_date("t").alias("d"), "q")
    assert {x["year"]: x["peak"] for x in duration.annual_peaks(record).collect()} == {2019: 9.0, 2020: 7.0, 2021: 8.0}
    assert {x["year"]: x["peak"] for x in duration.annual_peaks(record, (1, 1)).collect()} == {2019: 9.0, 2020: 8.0}
    peaks = table([(float(100 + 10 * i),) for i in range(20)], "peak double")
    got = {x["q"]: x["period"] for x in duration.return_periods(peaks).collect()}
    values = np.array([100 + 10 * i for i in range(20)], float)
    a = values.std(ddof=1) * 6**0.5 / math.pi
    u = values.mean() - K.GUMBEL_EULER * a
    assert got[290.0] == pytest.approx(1 / (1 - math.exp(-math.exp(-(290 - u) / a)))) and min(got.values()) >= 1
    with pytest.raises(Exception, match="at least 10"):
        duration.return_periods(peaks.limit(5)).collect()


def bench_reach(table):
    dem = table([(0, c, 100.0 + c) for c in range(4)], "r int, c int, v double")
    grain = table([(0, c, 0.01) for c in range(4)], "r int, c int, v double")
    hyd = table(
        [(100.0, 0, 0, 0.5, 0.3)] + [(100.0, 0, c, 0.0, 0.3) for c in (1, 2, 3)] + [(5000.0, 0, c, h, 3.0) for c, h in enumerate((2.5, 1.5, 0.5, 0.0))],
        "q double, r int, c int, h double, u double",
    )
    wle = table([(100.0, 0, c, 100.5) for c in range(4)] + [(5000.0, 0, c, 102.5) for c in range(4)], "q double, r int, c int, wle double")
    return dem, wle, hyd, grain


def record(spark, level):
    """Daily flow from 2019-10-01 on for a year; ``level`` maps a date to a flow."""
    first = dt.date(2019, 10, 1)
    return spark.createDataFrame([(first + dt.timedelta(days=i), float(level(first + dt.timedelta(days=i)))) for i in range(366)], "d date, q double")


def walk_day_by_day(dem, surfaces, days, p, year, scale):
    """The recession walk one day at a time, for one cell."""
    start, end = dt.date(year, *p.seed_start), dt.date(year, *p.seed_end)
    total = sum(d >= start for d in days)
    stress = lethal = run = longest = elapsed = 0
    tracked, dry = total, True
    for i, d in enumerate(days):
        was, dry = dry, not surfaces[i] > dem
        if d <= end and dry and not was:
            tracked, stress, lethal, longest = max(total - elapsed, 1), 0, 0, 0
        if i >= 3 and d >= start and dry:
            drop = (surfaces[i - 3] - surfaces[i]) / 3 * scale
            lethal += drop >= p.recession_lethal
            stress += p.recession_stress <= drop < p.recession_lethal
        run = 0 if dry else run + 1
        longest = max(longest, run)
        elapsed += d >= start
    return (lethal / tracked * 100 * 3 + stress / tracked * 100) / 3, longest


def test_recession_equals_a_daily_walk(spark, table):
    rng = np.random.default_rng(5)
    noise = {dt.date(2019, 10, 1) + dt.timedelta(days=i): 2500 + 2400 * math.sin(i / 9) + 300 * rng.random() for i in range(366)}
    flow_record = record(spark, noise.get)
    dem, wle, hyd, grain = bench_reach(table)
    p = RecruitmentParameters(band_lower=-1e6, band_upper=1e6)  # all cells
    days = sorted((d, q) for d, q in noise.items() if dt.date(2020, 4, 29) <= d <= dt.date(2020, 9, 15))
    modelled = [100.0, 5000.0]
    got = {x["c"]: (x["mortality"], x["longest"]) for x in recruitment.recession(dem, wle, flow_record, p, 2020).collect()}
    level = []
    for _, q in days:
        lo, hi, w = recruitment.bracket(modelled, q)
        level.append((100.5, 102.5)[lo] * (1 - w) + (100.5, 102.5)[hi] * w)
    for c in range(4):
        want = walk_day_by_day(100.0 + c, level, [d for d, _ in days], p, 2020, 30.48)
        assert got[c] == (pytest.approx(want[0]), want[1])


@pytest.mark.parametrize("wet,score", [(list(range(40, 60)), 0.5), ([40 + 3 * i for i in range(20)], 1.0), (list(range(30, 60)), 0.0)])
def test_inundation_counts_consecutive_days(spark, table, wet, score):
    high = {dt.date(2020, 6, 21) + dt.timedelta(days=i - 30) for i in wet}
    flow_record = record(spark, lambda d: 5000 if d in high or d == dt.date(2020, 5, 3) else 100)
    dem, wle, hyd, grain = bench_reach(table)
    p = RecruitmentParameters(seed_end=(5, 10))
    got = recruitment.recruitment(dem, wle, hyd, grain, flow_record, 1.0, 2020, p)
    rows = {x["c"]: x for x in got.cells.collect()}
    assert set(rows) == {1, 2} and rows[1]["inundation"] == score
    assert got.summary.first()["crop_area"] == 2.0


def test_recruitment_masks(spark, table):
    flow_record = record(spark, lambda d: 5000 if d == dt.date(2020, 5, 3) else 100)
    dem, wle, hyd, grain = bench_reach(table)
    one = table([(0, 1)], "r int, c int")
    got = recruitment.recruitment(dem, wle, hyd, grain, flow_record, 1.0, 2020, vegetated=one)
    assert [x["c"] for x in got.cells.collect()] == [2]
    graded = recruitment.recruitment(dem, wle, hyd, grain, flow_record, 1.0, 2020, graded=one)
    assert {x["c"]: x["bed"] for x in graded.cells.collect()}[1] == 1.0
    with pytest.raises(Exception, match="no day in the 2015 seed season"):
        recruitment.recruitment(dem, wle, hyd, grain, flow_record, 1.0, 2015).cells.collect()
    assert recruitment.recruitment(dem, wle, hyd, grain, flow_record, 1.0, 2015, missing="skip").cells.count() == 0


def test_recruitment_of_many_seasons_equals_single_ones(spark, table):
    """Two conditions, two gauges and two years in one job, one of them without a record."""
    dem, wle, hyd, grain = bench_reach(table)
    plain = record(spark, lambda d: 5000 if d == dt.date(2020, 5, 3) else 100 + 7 * d.day)
    wet = record(spark, lambda d: 5000 if d.month in (4, 5) and d.day % 3 else 300)
    flow_record = plain.withColumn("gauge", F.lit("a")).unionByName(wet.withColumn("gauge", F.lit("b")))
    both = lambda df, **shift: df.withColumn("site", F.lit(1)).unionByName(df.withColumns({k: F.col(k) + v for k, v in shift.items()}).withColumn("site", F.lit(2)))
    got = recruitment.recruitment(
        both(dem), both(wle, wle=0.5), both(hyd), both(grain), flow_record, 1.0, (2020, 2021), keys=["site"], flow_keys=["gauge"], missing="skip"
    )
    rows = got.cells.collect()
    assert {x["year"] for x in rows} == {2020}
    for site, gauge, one in ((1, "a", plain), (1, "b", wet), (2, "a", plain), (2, "b", wet)):
        moved = wle.withColumn("wle", F.col("wle") + (0.5 if site == 2 else 0.0))
        want = recruitment.recruitment(dem, moved, hyd, grain, one, 1.0, 2020).cells.collect()
        assert want and sorted(tuple(x)[3:] for x in rows if x["site"] == site and x["gauge"] == gauge) == sorted(map(tuple, want))
    assert got.summary.count() == 4


def test_terraforming_lands_on_the_limit(table):
    ground = table([(r, c, z, w) for r in range(2) for c, (z, w) in enumerate(((100.0, 2.0), (105.0, 5.0), (110.0, 10.0), (120.0, 20.0)))], "r int, c int, dem double, d2w double")
    masks = table([(f, i, r, c) for i, f in enumerate(("b", "a")) for r in range(2) for c in range(4) if f == "a" or c == 3], "fid string, ord int, r int, c int")
    got = terrain.lowered_cells(ground, masks, 7.0)
    rows = {(x["r"], x["c"]): x for x in got.collect()}
    assert rows[(0, 3)]["dem_new"] == 107.0 and rows[(0, 3)]["d2w_new"] == 7.0 and rows[(0, 3)]["fid"] == "b"
    assert rows[(0, 2)]["fid"] == "a" and rows[(0, 0)]["cut"] == 0
    # one feature after the other gives the same
    dem, d2w = {k: x["dem"] for k, x in rows.items()}, {k: x["d2w"] for k, x in rows.items()}
    for fid in ("b", "a"):
        for x in masks.filter(F.col("fid") == fid).collect():
            k = (x["r"], x["c"])
            excess = max(d2w[k] - 7.0, 0.0)
            dem[k], d2w[k] = dem[k] - excess, d2w[k] - excess
    assert {k: x["dem_new"] for k, x in rows.items()} == dem
    total = terrain.terraforming_total(got, 1.0).first()
    assert total["cut_volume"] == 2 * (3 + 13) and total["max_cut"] == 13


def test_detrended_reach(grid_table, as_grid):
    dem = grid_table([[100 - 0.5 * c + abs(r - 2) for c in range(9)] for r in range(5)])
    depth = grid_table([[1.0 if r == 2 else None for _ in range(9)] for r in range(5)], "h")
    got = as_grid(preparation.detrended_dem(dem, depth, Grid(5, 9)), 5, 9)
    assert [got[r][4] for r in range(5)] == [2, 1, 0, 1, 2]
    water = preparation.water_surface(dem, depth, Grid(5, 9))
    level = as_grid(water, 5, 9)
    assert level[0][4] == level[2][4] == 99.0
    assert as_grid(preparation.depth_to_water(dem, water), 5, 9)[0][4] == 1.0
    assert preparation.extended_depth(dem, water).count() == 9


def test_water_surfaces_of_many_discharges_match_single_ones(spark):
    rng = np.random.default_rng(7)
    dem = spark.createDataFrame([(r, c, float(rng.random())) for r in range(12) for c in range(9)], "r int, c int, v double").cache()
    hyd = spark.createDataFrame([(q, r, c, float(rng.random() - 0.7)) for q in (1.0, 2.0) for r in range(12) for c in range(9)], "q double, r int, c int, h double").cache()
    many = preparation.water_surface(dem, hyd, Grid(12, 9), step=2, keys=["q"])
    for q in (1.0, 2.0):
        one = preparation.water_surface(dem, hyd.filter(F.col("q") == q).drop("q"), Grid(12, 9), step=2)
        assert many.filter(F.col("q") == q).drop("q").exceptAll(one).count() == 0 and one.count() == 108


def test_shear_regimes(table):
    df = table([(1.0, 0.1, 0.1), (2.0, 2.6, 0.1), (2.0, 5.0, 0.1), (-1.0, 1.0, 0.1), (1.0, 0.0, 0.1), (1.0, None, 0.1)], "u double, h double, d84 double")
    rows = shear.with_bed_shear(df, "d84").collect()
    assert [x["regime"] for x in rows] == [1, 2, 3, 0, 0, 0]
    assert rows[2]["theta84"] == pytest.approx(4 / (5.75 * math.log10(12.2 * 25)) ** 2 / (9.81 * 1.68 * 0.1))
    assert rows[3]["theta84"] is None and rows[4]["ustar2"] is None
    with pytest.raises(ValueError):
        shear.with_bed_shear(df, "d84", density=1.0)


def test_cost_report(table):
    given = table([("p", "wood", 6250.0), ("p", "gravin", 10.0), ("p", "earthworks_volume", 270.0)], "project string, source string, amount double")
    asked = cost.quantities(given)
    assert {x["key"]: x["quantity"] for x in asked.collect()} == {"streamwood": 10.0, "gravel": None, "earthworks": 10.0}
    lines = cost.bill(asked)
    totals = cost.grand_total(cost.construction(lines)).first()
    assert totals["construction"] == 7980.0 and totals["total"] == pytest.approx(7980 * 1.1 * 1.1 * 1.165 * 1.35)
    amounts = [x["amount"] for x in cost.applied_rates(cost.construction(lines)).orderBy("pos").collect()]
    assert amounts == [pytest.approx(798.0), pytest.approx(877.8), pytest.approx(1593.207), pytest.approx(7980 * 1.21 * 1.165 * 0.35)]
    gain = cost.habitat_gain(table([("p", 0.0)], "project string, sharea double"), table([("p", 5.0)], "project string, sharea double"))
    assert gain.first()["relative"] == float("inf")
    assert cost.report(lines, gains=gain).filter("section = 'HABITAT'").count() == 4
    with pytest.raises(Exception, match="like for like"):
        cost.habitat_gain(table([("p", None)], "project string, sharea double"), table([("p", 5.0)], "project string, sharea double")).collect()


def test_pool_riffle_design(table):
    reaches = table([(1, 0.05, 0.005, 10.0, 2.58, 0.3), (2, 0.05, 0.005, 10.0, 2.58, 50.0)], "reach_id bigint, d50 double, slope double, base_width double, bank_slope double, target_depth double")
    got = {x["reach_id"]: x for x in channels.design_pool_riffle(reaches).collect()}
    d = got[1]
    assert d["converged"] and d["residual_depth"] == pytest.approx(0.3, rel=1e-3) and d["caamano_satisfied"]
    assert d["iterations"] == 2852
    assert d["pool_width"] == pytest.approx(10 - 0.001 * d["iterations"]) and d["riffle_width"] == pytest.approx(10 + 0.001 * d["iterations"])
    n = 0.05 ** (1 / 6) / 21.1
    assert channel.manning_q(d["pool_depth"], 2.58, n, d["pool_width"], 0.005) == pytest.approx(d["reversal_discharge"])
    assert not got[2]["converged"] and got[2]["pool_width"] <= 1e-9
    with pytest.raises(Exception, match="positive"):
        channels.design_pool_riffle(reaches.withColumn("d50", F.lit(0.0))).collect()


def test_depth_and_width_solvers():
    rng = np.random.default_rng(2)
    b, m, n, s, h = (rng.uniform(*x, 200) for x in ((0.01, 40), (0.5, 4), (0.02, 0.08), (1e-4, 0.05), (0.01, 9)))
    q = channel.manning_q(h, m, n, b, s)
    assert np.allclose(channel.normal_depths(q, m, n, b, s), h)
    assert np.allclose(channel.base_widths(q, h, m, n, s), b, atol=1e-7)
    assert np.isnan(channel.base_widths(np.array([1e-6]), 1.0, 1.0, 0.03, 0.01)).all()


def test_features_and_grouping(spark, table):
    features = default_features()
    assert len(features) == 21 and lookup.planting_depth_limit() == 7.0 and lookup.planting_depth_limit(fids=["wood"]) == 10.0
    again = lookup.load_features(lookup.features_table(spark))
    assert again == list(features.values())
    groups = [x["grp"] for x in lookup.feature_groups(lookup.features_table(spark)).select("grp", "first").distinct().orderBy("first").collect()]
    assert groups[0] == "Terraforming" and len(groups) == 5
    codes = lookup.load_codes(lookup.unit_codes(table([("Agricultural plain", 3), ("swamp", 4)], "name string, code int")))
    assert codes == {"agricultural plain": 3, "swamp": 4, "agriplain": 3, "backswamp": 4}


def test_definition_files_round_trip(spark, table, tmp_path):
    periods = table([("x", 0, 2.0), ("x", 1, 5.0)], "condition string, pos int, period double")
    made = definitions.definition_lines(table([("x", 1000.0), ("x", 1.06)], "condition string, q double"), periods)
    parsed = definitions.parse_definitions(made)
    items = {(x["attribute"], x["pos"]): x["item"] for x in parsed.collect()}
    assert items[("depth_rasters", 0)] == "h000001_060.tif" and items[("velocity_rasters", 1)] == "u001000.tif" and items[("dem_raster", 0)] == "dem"
    catalog = table([("x", n) for n in ("h000001_060.tif", "u000001_060.tif", "h001000.tif", "u001000.tif", "dem.tif", "dmean.tif")], "condition string, name string")
    pairs = definitions.hydraulic_pairs(parsed, catalog).orderBy("pos").collect()
    assert [(x["period"], x["q"]) for x in pairs] == [(2.0, 1.06), (5.0, 1000.0)]
    assert definitions.validate(parsed, catalog).count() == 0
    assert {x["problem"] for x in definitions.validate(parsed, catalog.filter("name <> 'u001000.tif'")).collect()} == {"depth without velocity", "named but absent"}
    with pytest.raises(Exception, match="differ in number"):
        definitions.definition_lines(table([("x", 1.0)], "condition string, q double"), periods).collect()


def test_layer_store_round_trip(spark, grid_table, tmp_path):
    cells = grid_table([[1.0, float("inf"), 3.0]]).withColumn("layer", F.lit("dem"))
    layers.write_layers(cells, str(tmp_path / "store"))
    back = layers.read_layer(layers.read_layers(spark, str(tmp_path / "store"), ["dem"]), "dem")
    assert sorted((x["c"], x["v"]) for x in back.collect()) == [(0, 1.0), (2, 3.0)]
    layers.write_csv(cells, str(tmp_path / "csv"))
    text = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert {x["v"] for x in text.collect()} == {"1.0", "-999.0", "3.0"}


def test_lifespans_per_condition(reach):
    hyd, ground, floods = reach
    two = lambda df: df.withColumn("condition", F.lit("a")).unionByName(df.withColumn("condition", F.lit("b")))
    deep = two(hyd).withColumn("u", F.when(F.col("condition") == "b", F.lit(0.1)).otherwise(F.col("u")))
    got = lifespan.lifespan_cells(deep, floods, two(ground), [default_features()["cot"]], "si", keys=["condition"])
    assert {x["condition"] for x in got.collect()} == {"a"} and got.count() == 40


def test_scratch_folder_is_local_only_here(spark, table):
    from reachspark import session

    kept = session.cut(table([(1,)], "a int"))
    assert kept.collect()[0][0] == 1
    assert session.scratch_dir(spark) == session.scratch_dir(spark)


def test_missing_surface_is_dry(spark, table):
    wle = table([(0, 0, 1.0, 5.0), (0, 0, 2.0, 6.0), (0, 1, 2.0, 6.5)], "r int, c int, q double, wle double")
    for known in (None, [1.0, 2.0]):
        packed = recruitment.surfaces(wle, known).collect()
        assert {tuple(x["m"]) for x in packed} == {(1.0, 2.0)}
        assert {(x["r"], x["c"]): x["w"] for x in packed} == {(0, 0): [5.0, 6.0], (0, 1): [None, 6.5]}


def test_literals_keep_infinity(spark, table):
    assert [x["v"] for x in table([(float("inf"),), (float("-inf"),)], "v double").collect()] == [float("inf"), float("-inf")]
