"""Feature lifespans, design grain sizes and the best feature per cell.

All features and all floods are answered by one scan, one join and one aggregation: a feature's
lifespan is the smallest return period among the floods at which any of its criteria fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import algebra, shear
from ..session import deal, values_table
from ..sources.lookup import Feature


class Flood(NamedTuple):
    """One modelled flood: its place in the condition's list, discharge and return period."""

    pos: int
    q: float
    period: float


def load_floods(discharges: DataFrame, limit: int = 10_000) -> list[Flood]:
    """Floods of one condition as plan parameters (size checked)."""
    rows = discharges.orderBy("pos").select("pos", "q", "return_period").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} floods in one condition")
    return [Flood(*row) for row in rows]


def design_discharge(floods: Sequence[Flood], target: float | None) -> float | None:
    """First flood, in list order, that reaches the target period."""
    if target is None:
        return None
    return next((f.q for f in sorted(floods) if f.period >= target), None)


def design_discharges(floods: DataFrame, features: DataFrame) -> DataFrame:
    """The same for tables: ``fid, q`` per feature with a design frequency.

    Both tables are parameters of a few rows; targets meet floods by a running maximum over
    the list, not by comparing all pairs.
    """
    w = Window.partitionBy("condition").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rising = floods.withColumn("_top", F.max("return_period").over(w)).filter("_top IS NULL OR return_period > _top")
    steps = rising.groupBy("condition").agg(F.array_sort(F.collect_list(F.struct("pos", "q", "return_period"))).alias("steps"))
    asked = features.filter("design_frequency IS NOT NULL").select("condition", "fid", "design_frequency").join(steps, "condition")
    hits = F.expr("filter(steps, s -> s.return_period >= design_frequency)")
    return asked.select("condition", "fid", F.get(hits, F.lit(0))["q"].alias("q"))


def failure(feature: Feature, unit: str, manning_n: float, has_grain: bool) -> Column | None:
    """Does the flow on this row destroy the feature? NULL criteria do not."""
    g, n = K.gravity(unit), K.manning(unit, manning_n)
    tests: list[Column] = []
    if feature.h_max is not None:
        tests.append(F.col("h") >= F.lit(feature.h_max))
    if feature.u_max is not None:
        tests.append(F.col("u") >= F.lit(feature.u_max))
    if feature.froude_max is not None:
        tests.append(shear.froude("h", "u", g) >= F.lit(feature.froude_max))
    if feature.tau_cr is not None and has_grain:
        if feature.safety_factor is not None:
            tests.append(shear.critical_grain("h", "u", feature.tau_cr, n, feature.safety_factor) >= F.col("dmean"))
        else:
            tests.append(F.col("theta84") >= F.lit(feature.tau_cr))
    if not tests:
        return None
    out = F.coalesce(tests[0], F.lit(False))
    for test in tests[1:]:
        out = out | F.coalesce(test, F.lit(False))
    return out


def spatial_mask(feature: Feature, columns: Sequence[str], codes: dict[str, int] | None = None) -> Column | None:
    """Where the feature is admissible at all; None when nothing restricts it.

    A criterion whose layer is missing is skipped.
    """
    tests: list[Column] = []
    for layer, low, high in (
        ("d2w", feature.d2w_min, feature.d2w_max),
        ("dem_detrend", feature.det_min, feature.det_max),
        ("dmean", None, feature.grain_max),
        ("slope", feature.terrain_slope, None),
    ):
        if layer in columns and (low is not None or high is not None):
            tests.append(algebra.in_range(layer, low, high))
    change = algebra.change_mask(
        "scour" if "scour" in columns else None, "fill" if "fill" in columns else None, feature.scour_rate, feature.fill_rate, feature.inverse_tcd
    )
    if change is not None:
        tests.append(change)
    wanted = feature.mu_relevant if feature.mu_method == 1 else feature.mu_avoid
    if wanted and "mu" in columns and codes:
        known = [codes[name.strip().lower()] for name in wanted if name.strip().lower() in codes]
        tests.append(algebra.unit_mask("mu", known, keep=feature.mu_method == 1))
    if not tests:
        return None
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def unknown_units(features: Iterable[Feature], codes: dict[str, int]) -> dict[str, list[str]]:
    """Unit names of each feature that have no code; they take no part in its criterion."""
    out = {}
    for f in features:
        wanted = f.mu_relevant if f.mu_method == 1 else f.mu_avoid
        lost = [n for n in wanted if n.strip().lower() not in codes]
        if lost:
            out[f.fid] = lost
    return out


def lifespan_cells(
    hydraulics: DataFrame,
    floods: Sequence[Flood],
    terrain: DataFrame,
    features: Iterable[Feature],
    unit: str = "us",
    manning_n: float = K.MANNING_N,
    codes: dict[str, int] | None = None,
    keys: Sequence[str] = (),
    per_pass: int = 48,
    best: bool = False,
) -> DataFrame:
    """``r, c, fid, lifespan, design`` of every mapped cell.

    ``hydraulics`` is ``q, r, c, h, u``; ``terrain`` one row per cell with any of ``dmean, d2w,
    dem_detrend, mu, scour, fill, slope`` (slope as rise over run). A cell that survives every
    flood is not mapped. Without a hydraulic criterion the longest period of the list applies.
    ``design`` is the grain that just moves at the design flood, in inches for U.S. units.
    More than ``per_pass`` features are mapped in several passes, to keep generated code small.
    ``best`` keeps the features that reach a cell's longest lifespan, as ``best_cells`` does, before they become rows.
    """
    features = list(features)
    if len(features) > per_pass:
        parts = [
            lifespan_cells(hydraulics, floods, terrain, features[i : i + per_pass], unit, manning_n, codes, keys, per_pass, best)
            for i in range(0, len(features), per_pass)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return best_cells(out, keys) if best else out
    spark = hydraulics.sparkSession
    cell = [*keys, "r", "c"]
    has_grain = "dmean" in terrain.columns
    longest = max((f.period for f in floods), default=K.DEFAULT_MAX_LIFESPAN)
    plan = []
    for f in features:
        fail = failure(f, unit, manning_n, has_grain)
        mask = spatial_mask(f, terrain.columns, codes)
        if fail is None and mask is None:
            continue
        at = design_discharge(floods, f.design_frequency) if f.design_mapping and f.tau_cr is not None and has_grain else None
        plan.append((len(plan), f, fail, mask, at))
    if not plan:
        raise ValueError("no feature has an applicable criterion")

    admissible = [mask.alias(f"m{i}") for i, _, _, mask, _ in plan if mask is not None]
    ground = terrain.select(*cell, *(["dmean"] if has_grain else []), *admissible)
    periods = values_table(spark, [(f.q, f.period) for f in floods], "q double, period double")
    flow = hydraulics.select(*keys, "q", "r", "c", F.when(F.col("h") > 0, F.col("h")).alias("h"), "u").join(periods, "q")
    rows = deal(flow, *cell).join(deal(ground, *cell), cell, "full_outer")
    if has_grain and any(f.tau_cr is not None and f.safety_factor is None for _, f, _, _, _ in plan):
        rows = shear.with_bed_shear(rows, shear.d84("dmean"), g=K.gravity(unit))

    n = K.manning(unit, manning_n)
    inch = 12.0 if unit.lower() == "us" else 1.0
    found = []
    for i, f, fail, mask, at in plan:
        if fail is not None:
            found.append(F.min(F.when(fail, F.col("period"))).alias(f"l{i}"))
        if mask is not None:
            found.append(F.max(f"m{i}").alias(f"m{i}"))
        if at is not None:
            grain = shear.critical_grain("h", "u", f.tau_cr, n, f.safety_factor or 1.0) * F.lit(inch)
            found.append(F.max(F.when(F.col("q") == F.lit(at), grain)).alias(f"d{i}"))
    wide = rows.groupBy(*cell).agg(*found)

    results = []
    for i, f, fail, mask, at in plan:
        life = F.col(f"l{i}") if fail is not None else F.lit(float(longest))
        if mask is not None:
            life = F.when(F.col(f"m{i}"), life)
        grain = F.col(f"d{i}") if at is not None else F.lit(None).cast("double")
        results.append(F.struct(F.lit(f.fid).alias("fid"), life.cast("double").alias("lifespan"), grain.alias("design")))
    mapped = F.filter(F.array(*results), lambda s: s["lifespan"].isNotNull())
    if best:
        wide = wide.select(*cell, mapped.alias("_all")).withColumn("_top", F.array_max(F.col("_all.lifespan")))
        mapped = F.filter("_all", lambda s: s["lifespan"] == F.col("_top"))
    return wide.select(*cell, F.explode(mapped).alias("s")).select(*cell, "s.*")


def lifespan_summary(cells: DataFrame, cell_area: float, keys: Sequence[str] = ("fid",)) -> DataFrame:
    """Mapped area and lifespan range per feature."""
    return cells.groupBy(*keys).agg(
        (F.count(F.lit(1)) * F.lit(cell_area)).alias("area"),
        F.min("lifespan").alias("min_lifespan"),
        F.max("lifespan").alias("max_lifespan"),
        F.median("lifespan").alias("median_lifespan"),
    )


def best_cells(lifespans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every cell with its winning features: those that reach the cell's longest lifespan.

    Ties are kept. A cell holds at most one row per feature, so its window stays small.
    """
    w = Window.partitionBy(*keys, "r", "c")
    return lifespans.withColumn("best", F.max("lifespan").over(w)).filter("lifespan = best").drop("best")


def best_summary(lifespans: DataFrame, cell_area: float, keys: Sequence[str] = ()) -> DataFrame:
    """Won area, share of the mapped area and longest lifespan per feature, largest first.

    Features that win nowhere are listed with zero area.
    """
    keys = list(keys)
    cell = Window.partitionBy(*keys, "r", "c")
    ranked = lifespans.withColumn("_best", F.max("lifespan").over(cell)).withColumn("_k", F.row_number().over(cell.orderBy("fid")))
    won = F.when(F.col("lifespan") == F.col("_best"), F.col("lifespan"))
    # Each mapped cell is counted once, on its first feature row; the per-feature table is small.
    per = ranked.groupBy(*keys, "fid").agg(F.count(won).alias("_w"), F.max(won).alias("max_lifespan"), F.count(F.when(F.col("_k") == 1, True)).alias("_c"))
    mapped = F.sum("_c").over(Window.partitionBy(*(keys or [F.lit(0)])))
    out = per.withColumn("_t", mapped).select(
        *keys, "fid", (F.col("_w") * F.lit(cell_area)).alias("area"), (F.col("_w") / F.col("_t") * 100.0).alias("share"), "max_lifespan"
    )
    return out.orderBy(*keys, F.desc("area"), "fid")
