"""Riparian recruitment: can a seedling establish at a cell in a given year?

Four objectives are scored per cell: bed preparation, desiccation, inundation and scour. The
two that follow the daily water surface are computed from one array of modelled surfaces per
cell and one array of days per season; days are never exploded into rows. All conditions, gauges and
years are scored in one job: a season is a row of a table that meets the tiles of its condition by a join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import shear
from ..functions.algebra import ladder
from ..functions.season import date_in
from ..session import Guard, spread
from ..sources.lookup import RecruitmentParameters

#: Days of one season at most, and the width of the square tiles a season is walked in.
MAX_DAYS, TILE = 400, 64
#: Seasons that meet a tile at once; their cells are shuffled and read once for all of them.
SEASONS = 16
#: Cells walked at once.
CELLS = 256


def mobilising_discharge(
    hydraulics: DataFrame, grain: DataFrame, taus: dict[str, float], unit: str = "us", keys: Sequence[str] = (), guard: Guard | None = None
) -> DataFrame:
    """``keys, r, c`` and, per name in ``taus``, the lowest discharge whose Shields stress reaches it.

    Absent where no modelled discharge does. All thresholds share one pass, which a ``guard`` watches for stress that is NoData everywhere.
    """
    flow = hydraulics.select(*keys, "q", "r", "c", F.when(F.col("h") > 0, F.col("h")).alias("h"), "u")
    rows = flow.join(grain.select(*keys, "r", "c", F.col("v").alias("_grain")), [*keys, "r", "c"])
    rows = shear.with_bed_shear(rows, shear.d84("_grain"), g=K.gravity(unit))
    rows = rows if guard is None else guard.watch(rows, "theta84")
    return rows.groupBy(*keys, "r", "c").agg(*[F.min(F.when(F.col("theta84") >= F.lit(tau), F.col("q"))).alias(name) for name, tau in taus.items()])


def bracket(modelled: list[float], q: float) -> tuple[int, int, float]:
    """Positions of the modelled discharges around ``q`` and the weight of the upper one."""
    if q <= modelled[0]:
        return 0, 0, 0.0
    if q >= modelled[-1]:
        return len(modelled) - 1, len(modelled) - 1, 0.0
    high = bisect_left(modelled, q)
    return high - 1, high, (q - modelled[high - 1]) / (modelled[high] - modelled[high - 1])


def brackets(m: Sequence[float], flows: Sequence[float]) -> tuple[np.ndarray, ...]:
    """Positions and weights of :func:`bracket` for many discharges."""
    modelled = list(m)
    lo, hi, weight = (np.array(x) for x in zip(*[bracket(modelled, q) for q in flows]))
    return lo, hi, weight


def flow_brackets(flow: DataFrame, discharges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``d, q, q_lo, q_hi, weight``: modelled discharges around every day's flow, clamped.

    The modelled discharges of a key form one short sorted array that is met by equality on the
    key; no range join is needed.
    """
    keys = keys or []
    listed = discharges.groupBy(*keys).agg(F.array_sort(F.collect_set("q")).alias("_m"))
    rows = flow.join(listed, keys) if keys else flow.withColumn("_m", listed.select("_m").scalar())
    lo = F.array_max(F.expr("filter(_m, m -> m < q)"))
    hi = F.array_min(F.expr("filter(_m, m -> m >= q)"))
    rows = rows.withColumn("q_lo", F.coalesce(lo, F.array_min("_m"))).withColumn("q_hi", F.coalesce(hi, F.array_max("_m")))
    rows = rows.withColumn("q_lo", F.when(F.col("q") <= F.array_min("_m"), F.array_min("_m")).otherwise(F.col("q_lo")))
    weight = F.when(F.col("q_hi") > F.col("q_lo"), (F.least("q", "q_hi") - F.col("q_lo")) / (F.col("q_hi") - F.col("q_lo"))).otherwise(F.lit(0.0))
    low_end = F.col("q") >= F.array_max("_m")
    rows = rows.withColumn("q_lo", F.when(low_end, F.array_max("_m")).otherwise(F.col("q_lo")))
    return rows.withColumn("weight", weight).drop("_m")


def surfaces(wle: DataFrame, discharges: list[float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, r, c, m, w``: the modelled discharges of a key in order, and a cell's water surfaces at them.

    A cell without a surface at some discharge has NULL there, which reads as dry. Pass the
    modelled ``discharges`` if all keys share known ones; else they are aggregated from the table.
    """
    keys = list(keys)
    at, q = [*keys, "r", "c"], F.col("q").cast("double")
    known = wle.filter("wle IS NOT NULL")
    if discharges is not None:
        # a cell's surfaces become one row before they are shuffled
        m = [float(x) for x in sorted(discharges)]
        packed = known.groupBy(*at).agg(*[F.first(F.when(q == F.lit(x), F.col("wle")), ignorenulls=True).alias(f"_w{i}") for i, x in enumerate(m)])
        return packed.select(*at, F.array(*map(F.lit, m)).alias("m"), F.array(*[F.col(f"_w{i}") for i in range(len(m))]).alias("w"))
    packed = spread(known, *at).groupBy(*at).agg(F.collect_list(F.struct(q.alias("q"), F.col("wle").cast("double").alias("wle"))).alias("_levels"))
    packed = with_list(packed, wle, F.array_sort(F.collect_set(q)), "m", keys)
    found = lambda q: F.get(F.filter("_levels", lambda x: x["q"] == q), F.lit(0))["wle"]
    return packed.select(*at, "m", F.transform("m", found).alias("w"))


def with_list(rows: DataFrame, other: DataFrame, made: Column, name: str, keys: list[str]) -> DataFrame:
    """``rows`` with an aggregate of the rows of ``other`` that have the same keys."""
    listed = other.groupBy(*keys).agg(made.alias(name))
    return rows.join(listed, keys) if keys else rows.withColumn(name, listed.select(name).scalar())


def water_levels(w: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Water surfaces of cells at any discharges: linear between the modelled ones, held beyond them."""
    lo, hi, weight = brackets(m, np.atleast_1d(q))
    return w[:, lo] * (1.0 - weight) + w[:, hi] * weight


def window_peaks(flow: DataFrame, year, p: RecruitmentParameters, keys: list[str] | None = None) -> DataFrame:
    """Peaks before the seeds (bed preparation) and between seeds and baseflow (scour), and the
    range of flows while seeds disperse."""
    start, end, base = (date_in(F.lit(year), b) for b in (p.seed_start, p.seed_end, p.baseflow_start))
    prep = date_in(F.lit(year - p.bed_prep_years), p.seed_start)
    d = F.col("d")
    pick = lambda test: F.when(test, F.col("q"))
    return flow.groupBy(*(keys or [])).agg(
        F.max(pick((d >= prep) & (d < start))).alias("prep_peak"),
        F.max(pick((d > end) & (d <= base))).alias("scour_peak"),
        F.min(pick((d >= start) & (d <= end))).alias("seed_low"),
        F.max(pick((d >= start) & (d <= end))).alias("seed_high"),
    )


def seasons(
    flow: DataFrame, p: RecruitmentParameters, years: int | Sequence[int] | None = None, keys: Sequence[str] = (), missing: str = "error"
) -> DataFrame:
    """One row per flow record and year: its peaks, the flow at baseflow, and the days of the recession in order.

    ``years`` defaults to each record's latest. The flow at baseflow is that of the nearest day on record, the earlier one on
    ties. A record that has no day in the seed season, or too few in the recession, raises an error when
    its rows are computed, or with ``missing="skip"`` has no season.
    """
    keys = list(keys)
    if years is None:
        dated = with_list(flow, flow, F.max(F.year("d")), "year", keys)
    else:
        listed = [int(y) for y in ([years] if isinstance(years, int) else years)]
        dated = flow.withColumn("year", F.explode(F.array(*[F.lit(y) for y in listed])))
    start, end, base = (date_in("year", bound) for bound in (p.seed_start, p.seed_end, p.baseflow_start))
    prep = date_in(F.col("year") - p.bed_prep_years, p.seed_start)
    d, day = F.col("d"), F.struct("d", "q")
    pick = lambda test, value="q": F.when(test, value if isinstance(value, Column) else F.col(value))
    found = dated.groupBy(*keys, "year").agg(
        F.max(pick((d >= prep) & (d < start))).alias("prep_peak"),
        F.max(pick((d > end) & (d <= base))).alias("scour_peak"),
        F.min(pick((d >= start) & (d <= end))).alias("seed_low"),
        F.max(pick((d >= start) & (d <= end))).alias("seed_high"),
        F.min_by("q", F.struct(F.abs(F.datediff("d", base)), d)).alias("base_flow"),
        F.sort_array(F.collect_list(pick((d >= F.date_sub(start, 3)) & (d <= base), day))).alias("days"),
    )
    few = (F.size("days") < 5) | (F.element_at(F.col("days.d"), -1) < start)
    text = lambda t: F.format_string(t, "year")
    wrong = (
        F.when(F.col("seed_low").isNull(), text("the record has no day in the %d seed season"))
        .when(few, text("the record has too few days in the %d recession period"))
        .when(F.size("days") > MAX_DAYS, F.lit("the flow record has more than one row per day"))
    )
    if missing == "skip":
        found = found.filter(wrong.isNull())
    else:
        found = found.withColumn("days", F.when(wrong.isNull(), F.col("days")).otherwise(F.raise_error(wrong)))
    return found.withColumns(
        {
            "flows": F.col("days.q"),
            "after": F.transform("days", lambda x: x["d"] >= start),
            "seeding": F.transform("days", lambda x: x["d"] <= end),
        }
    ).drop("days")


def _season_tiles(dem, wle, flow, p, years, unit, discharges, keys, flow_keys, missing, vegetated=None) -> tuple[DataFrame, str]:
    """Tiles of cells with the seasons of their key, some to a row, and the DDL of the columns that name a result's row."""
    keys, flow_keys = list(keys), list(flow_keys)
    ground = dem.select(*keys, "r", "c", F.col("v").cast("double").alias("dem")).join(surfaces(wle, discharges, keys), [*keys, "r", "c"])
    if vegetated is not None:
        ground = ground.join(vegetated.select(*keys, "r", "c").distinct(), [*keys, "r", "c"], "left_anti")
    tile = [*keys, F.floor(F.col("r") / TILE).alias("_tr"), F.floor(F.col("c") / TILE).alias("_tc")]
    cell = F.struct(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "dem", "w")
    tiles = ground.groupBy(*tile).agg(F.first("m").alias("m"), F.collect_list(cell).alias("cells"))
    table = seasons(flow, p, years, [k for k in keys if k in flow.columns] + flow_keys, missing)
    shared = [k for k in keys if k in flow.columns]
    own = [c for c in table.columns if c not in shared]
    listed = F.array_sort(F.collect_list(F.struct(*own)))
    tiles = with_list(tiles, table, listed, "_s", shared)
    chunk = F.sequence(F.lit(1), F.size("_s"), F.lit(SEASONS))
    tiles = tiles.filter(F.size("_s") > 0).withColumn("_from", F.explode(chunk)).withColumn("seasons", F.slice("_s", F.col("_from"), SEASONS))
    tiles = tiles.select(*keys, "_from", "seasons", "m", *[F.col(f"cells.{n}").alias(n) for n in ("r", "c", "dem")], F.flatten("cells.w").alias("w"))
    kinds = {f.name: f.dataType.simpleString() for f in [*dem.schema.fields, *table.schema.fields]}
    return spread(tiles, *keys, "_from", F.col("r")[0], F.col("c")[0]), ", ".join(f"{n} {kinds[n]}" for n in [*keys, *flow_keys, "year"])


def _each_season(batches, keys: Sequence[str]) -> Iterator[SimpleNamespace]:
    """Every tile with every one of its seasons."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            m, dem = np.asarray(row.m, dtype=float), np.asarray(row.dem, dtype=float)
            shared = {k: getattr(row, k) for k in keys} | {"r": row.r, "c": row.c, "m": m, "dem": dem, "w": np.asarray(row.w, dtype=float).reshape(len(dem), len(m))}
            for season in row.seasons:
                yield SimpleNamespace(**shared, **{k: season[k] for k in season})


def _crop(row, p: RecruitmentParameters, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which cells of a tile can recruit in its season, with all elevations and modelled surfaces."""
    w, dem, m = row.w, row.dem, row.m
    if p.band_lower is not None and p.band_upper is not None:
        above = dem - water_levels(w, m, row.base_flow)[:, 0]
        return (above >= p.band_lower / scale) & (above <= p.band_upper / scale), dem, w
    low, high = water_levels(w, m, np.array([row.seed_low, row.seed_high])).T
    return (dem <= high) & (dem >= low), dem, w


def crop_area(
    dem: DataFrame,
    wle: DataFrame,
    flow: DataFrame,
    p: RecruitmentParameters,
    years: int | Sequence[int] | None = None,
    unit: str = "us",
    discharges: list[float] | None = None,
    keys: Sequence[str] = (),
    flow_keys: Sequence[str] = (),
    missing: str = "error",
) -> DataFrame:
    """``keys, flow_keys, year, r, c, dem`` of the cells where recruitment is possible.

    An elevation band above the baseflow surface if the parameters give one, else the ground
    between the lowest and the highest water of the seed season.
    """
    tiles, ddl = _season_tiles(dem, wle, flow, p, years, unit, discharges, keys, flow_keys, missing)
    names, scale = [f.split()[0] for f in ddl.split(", ")], K.CM_PER_LENGTH[unit]

    def cut_out(batches):
        for row in _each_season(batches, keys):
            keep, z, _ = _crop(row, p, scale)
            yield pd.DataFrame({"r": row.r[keep], "c": row.c[keep], "dem": z[keep]}).assign(**{n: getattr(row, n) for n in names})[[*names, "r", "c", "dem"]]

    return tiles.mapInPandas(cut_out, f"{ddl}, r int, c int, dem double")


def recession(
    dem: DataFrame,
    wle: DataFrame,
    flow: DataFrame,
    p: RecruitmentParameters,
    years: int | Sequence[int] | None = None,
    unit: str = "us",
    vegetated: DataFrame | None = None,
    discharges: list[float] | None = None,
    keys: Sequence[str] = (),
    flow_keys: Sequence[str] = (),
    missing: str = "error",
) -> DataFrame:
    """``keys, flow_keys, year, r, c, mortality, longest, prep_peak, scour_peak, desiccation, inundation`` of the crop cells.

    Each cell's last drying during seed dispersal starts its count again; stress counts only on
    dry days; the longest run of consecutive wet days decides inundation.
    """
    tiles, ddl = _season_tiles(dem, wle, flow, p, years, unit, discharges, keys, flow_keys, missing, vegetated)
    names, scale = [f.split()[0] for f in ddl.split(", ")], K.CM_PER_LENGTH[unit]

    def walk(row) -> pd.DataFrame:
        keep, z, w = _crop(row, p, scale)
        after_start, seeding = np.asarray(row.after, dtype=bool), np.asarray(row.seeding, dtype=bool)
        n, total = len(after_start), int(after_start.sum())
        elapsed = np.concatenate(([0], np.cumsum(after_start)[:-1]))
        counted = after_start & (np.arange(n) >= 3)
        place = np.arange(n, dtype=np.int16)[:, None]
        lo, hi, weight = brackets(row.m, row.flows)
        cells = np.flatnonzero(keep)
        mortality, longest = np.zeros(len(cells)), np.zeros(len(cells), np.int32)
        # a line a day; some cells at a time, whose days fit a core's cache
        for at in range(0, len(cells), CELLS):
            some = cells[at : at + CELLS]
            modelled = np.ascontiguousarray(w[some].T)
            level = modelled[lo] * (1.0 - weight)[:, None] + modelled[hi] * weight[:, None]
            dry = ~(level > z[some])
            fell = dry[1:] & ~dry[:-1] & seeding[1:, None]
            reset = np.where(fell, place[1:], np.int16(-1)).max(axis=0, initial=-1)
            since = place >= reset
            drop = (level[:-3] - level[3:]) / 3.0 * scale
            counts = (dry & since & counted[:, None])[3:]
            lethal = (counts & (drop >= p.recession_lethal)).sum(axis=0)
            stress = (counts & (drop >= p.recession_stress) & (drop < p.recession_lethal)).sum(axis=0)
            tracked = np.where(reset >= 0, np.maximum(total - elapsed[reset], 1), total)
            last_dry = np.maximum.accumulate(np.where(dry, place, np.int16(-1)), axis=0)
            longest[at : at + CELLS] = np.where(since, place - last_dry, np.int16(0)).max(axis=0)
            mortality[at : at + CELLS] = (lethal / tracked * 100.0 * 3.0 + stress / tracked * 100.0) / 3.0
        out = pd.DataFrame({"r": row.r[cells], "c": row.c[cells], "mortality": mortality, "longest": longest})
        return out.assign(**{x: getattr(row, x) for x in names}, **{x: np.full(len(cells), getattr(row, x), float) for x in ("prep_peak", "scour_peak")})

    def run(batches):
        for row in _each_season(batches, keys):
            yield walk(row)

    tracked = tiles.mapInPandas(run, f"r int, c int, mortality double, longest int, {ddl}, prep_peak double, scour_peak double")
    tracked = tracked.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("prep_peak", "scour_peak")})
    desiccation = ladder("mortality", [(">", 30.0, 0.0), (">=", 20.0, 0.5)], 1.0)
    inundation = ladder("longest", [(">", p.inundation_lethal, 0.0), (">=", p.inundation_stress, 0.5)], 1.0)
    return tracked.withColumn("desiccation", desiccation).withColumn("inundation", inundation)


def peak_score(full: Column, partial: Column, peak: Column, hit: float, miss: float, absent: float) -> Column:
    """``hit`` where the peak mobilises the bed fully, 0.5 where partially, else ``miss``.

    Without any flow in the window the score is ``absent``; a bed never mobilised counts as
    infinitely strong.
    """
    return F.when(peak.isNull(), F.lit(absent)).when(full <= peak, F.lit(hit)).when(partial <= peak, F.lit(0.5)).otherwise(F.lit(miss))


@dataclass
class Recruitment:
    """Per-cell scores and their area summary."""

    cells: DataFrame
    summary: DataFrame


def recruitment(
    dem: DataFrame,
    wle: DataFrame,
    hydraulics: DataFrame,
    grain: DataFrame,
    flow: DataFrame,
    cell_area: float,
    year: int | Sequence[int] | None = None,
    parameters: RecruitmentParameters | None = None,
    unit: str = "us",
    vegetated: DataFrame | None = None,
    graded: DataFrame | None = None,
    discharges: list[float] | None = None,
    keys: Sequence[str] = (),
    flow_keys: Sequence[str] = (),
    missing: str = "error",
) -> Recruitment:
    """Score every crop cell in every season: ``bed, desiccation, inundation, scour, mortality, potential``.

    ``dem`` and ``grain`` are ``keys, r, c, v``; ``wle`` is ``keys, q, r, c, wle``; ``flow`` is ``keys, flow_keys, d, q``, where keys it
    lacks share its records. Each record and year gives a season of the cells with its keys; with ``keys`` and
    ``flow_keys`` these and ``year`` come first in the result. Vegetated cells are left out, graded cells count as prepared.
    """
    p = parameters or RecruitmentParameters()
    keys, flow_keys = list(keys), list(flow_keys)
    at = [*keys, "r", "c"]
    mobile = mobilising_discharge(hydraulics, grain, {"q_full": p.tau_cr_full, "q_partial": p.tau_cr_partial}, unit, keys)
    cells = recession(dem, wle, flow, p, year, unit, vegetated, discharges, keys, flow_keys, missing).join(mobile, at, "left")
    prep, full, partial = F.col("prep_peak"), F.col("q_full"), F.col("q_partial")
    bed = peak_score(full, partial, prep, 1.0, 0.0, 0.0)
    if graded is not None:
        cells = cells.join(graded.select(*at).distinct().withColumn("_g", F.lit(True)), at, "left")
        bed = F.when(F.col("_g") & prep.isNotNull(), F.lit(1.0)).otherwise(bed)
    cells = cells.withColumn("bed", bed).withColumn("scour", peak_score(full, partial, F.col("scour_peak"), 0.0, 1.0, 1.0))
    potential = F.col("bed") * F.col("desiccation") * F.col("inundation") * F.col("scour")
    by = [*keys, *flow_keys, "year"] if keys or flow_keys or not (year is None or isinstance(year, int)) else []
    cells = cells.withColumn("potential", potential).select(
        *by, "r", "c", "bed", "desiccation", "inundation", "scour", "mortality", "longest", "potential"
    )
    return Recruitment(cells, recruitment_summary(cells, cell_area, by))


def recruitment_summary(cells: DataFrame, cell_area: float, keys: Sequence[str] = ()) -> DataFrame:
    """Crop, full (1) and partial ([0.125, 1)) areas, and the full area of each objective."""
    area = lambda test: (F.count(F.when(test, True)) * F.lit(cell_area))
    v = F.col("potential")
    return cells.groupBy(*keys).agg(
        (F.count(F.lit(1)) * F.lit(cell_area)).alias("crop_area"),
        area(v >= 1.0).alias("recruitment_area"),
        area((v >= 0.125) & (v < 1.0)).alias("partial_area"),
        *[area(F.col(n) >= 1.0).alias(f"{n}_area") for n in ("bed", "desiccation", "inundation", "scour")],
    )
