"""Map algebra on columns. NoData is NULL; NaN must not pass ingest (``no_data``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """Columns stay, strings name columns, anything else becomes a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def no_data(value, sentinel: float | None = None) -> Column:
    """NULL for NaN, infinities and the declared sentinel; the value otherwise."""
    v = as_col(value).cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    if sentinel is not None:
        bad = bad | (v == F.lit(float(sentinel)))
    return F.when(~bad, v)


def con(condition, true_value, false_value=None) -> Column:
    """``true_value`` where the condition holds, else NULL (or ``false_value``)."""
    picked = F.when(as_col(condition), as_col(true_value))
    return picked if false_value is None else picked.otherwise(as_col(false_value))


def is_null(value) -> Column:
    """True for NoData: NULL, NaN and both infinities."""
    v = as_col(value).cast("double")
    return v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def set_null(condition, value) -> Column:
    """NULL where the condition holds, the value elsewhere (also where it is unknown)."""
    return F.when(~F.coalesce(as_col(condition), F.lit(False)), as_col(value))


def class_index(value, breaks: Sequence[float], right: bool) -> Column:
    """0-based class of a value among ascending breaks, NULL for NoData."""
    v = as_col(value)
    out = None
    for i, b in enumerate(breaks):
        hit = (v <= F.lit(float(b))) if right else (v < F.lit(float(b)))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    last = F.lit(len(breaks))
    return F.when(v.isNotNull(), last if out is None else out.otherwise(last))


def reclassify(value, breaks: Sequence[float], values: Sequence[float], right: bool = True) -> Column:
    """Class value per interval; intervals are closed on the right unless ``right=False``."""
    if len(values) != len(breaks) + 1:
        raise ValueError(f"{len(breaks)} breaks make {len(breaks) + 1} classes, not {len(values)}")
    v = as_col(value)
    out = None
    for b, target in zip(breaks, values):
        hit = (v <= F.lit(float(b))) if right else (v < F.lit(float(b)))
        out = F.when(hit, F.lit(float(target))) if out is None else out.when(hit, F.lit(float(target)))
    last = F.lit(float(values[-1]))
    return F.when(v.isNotNull(), last if out is None else out.otherwise(last))


def apply_curve(value, curve: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear curve: first y held on the left, zero beyond the last x."""
    points = sorted((float(x), float(y)) for x, y in curve)
    v = as_col(value)
    out = F.when(v < points[0][0], F.lit(points[0][1]))
    for (xa, ya), (xb, yb) in zip(points, points[1:]):
        if xb > xa:
            slope = (yb - ya) / (xb - xa)
            out = out.when(v < xb, F.lit(ya) + (v - F.lit(xa)) * F.lit(slope))
    out = out.when(v == points[-1][0], F.lit(points[-1][1])).otherwise(F.lit(0.0))
    return F.when(v.isNotNull(), out)


def wet(depth, h_min: float = 0.0) -> Column:
    """Deeper than ``h_min``; NoData counts as dry."""
    return F.coalesce(as_col(depth), F.lit(0.0)) > F.lit(float(h_min))


def in_range(value, low: float | None = None, high: float | None = None) -> Column:
    """Closed range test; an absent end is open. NoData is outside."""
    v = as_col(value)
    test = v.isNotNull()
    if low is not None:
        test = test & (v >= F.lit(float(low)))
    if high is not None:
        test = test & (v <= F.lit(float(high)))
    return F.coalesce(test, F.lit(False))


def change_mask(scour=None, fill=None, scour_rate=None, fill_rate=None, inverse=False) -> Column | None:
    """Where topographic change reaches a rate (any), or stays below every rate (inverse)."""
    tests = []
    for layer, rate in ((scour, scour_rate), (fill, fill_rate)):
        if layer is not None and rate is not None:
            v, limit = as_col(layer), F.lit(float(rate))
            tests.append(F.coalesce(v < limit if inverse else v >= limit, F.lit(False)))
    if not tests:
        return None
    out = tests[0]
    for test in tests[1:]:
        out = (out & test) if inverse else (out | test)
    return out


def unit_mask(mu, codes: Sequence[int], keep: bool) -> Column:
    """Cells of the listed units (``keep``) or all others; NoData is an "other"."""
    hit = F.coalesce(as_col(mu).cast("int").isin([int(c) for c in codes]), F.lit(False)) if codes else F.lit(False)
    return hit if keep else ~hit


def ladder(value, steps: Sequence[tuple[str, float, float]], otherwise: float) -> Column:
    """Score ladder: the first matching ``(operator, limit, score)`` wins."""
    v, out = as_col(value), None
    for op, limit, score in steps:
        limit = F.lit(float(limit))
        test = {">": v > limit, ">=": v >= limit, "<": v < limit, "<=": v <= limit}[op]
        out = F.when(test, F.lit(score)) if out is None else out.when(test, F.lit(score))
    return out.otherwise(F.lit(otherwise))


def composite_hsi(depth, dsi, vsi, cover=None, method: str = "geometric_mean") -> Column:
    """Composite suitability of wet cells from depth, velocity and optional cover indices."""
    if method not in ("geometric_mean", "product"):
        raise ValueError(f"unknown combine method {method!r}")
    product = as_col(dsi) * as_col(vsi)
    if cover is not None:
        product = product * as_col(cover)
    if method == "geometric_mean":
        product = F.sqrt(product) if cover is None else F.cbrt(product)
    return con(wet(depth), product)


def level_of_detection(difference, limit: float) -> Column:
    """Elevation change with everything below the limit set to zero; NULL stays NULL."""
    d = as_col(difference)
    return F.when(F.abs(d) < F.lit(float(limit)), F.lit(0.0)).otherwise(d)


def lowered(dem, d2w, planned, d2w_max: float) -> Column:
    """Terrain lowered to the deepest tolerable depth to water where planned and too high."""
    high = F.coalesce(as_col(planned) & (as_col(d2w) > F.lit(float(d2w_max))), F.lit(False))
    return F.when(high, as_col(dem) - (as_col(d2w) - F.lit(float(d2w_max)))).otherwise(as_col(dem))
