"""Flow duration, annual peaks and return periods.

A flow record has one row per gauge and day (``sources.flow.clean_flow``), so windows per gauge
are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.naming import short_code
from ..functions.season import in_season, month_day, water_year
from ..sources.flow import numbered_curve


def years(flow: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct calendar years per key."""
    return flow.select(*keys, F.year("d").alias("year")).distinct()


def season_flows(flow: DataFrame, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None) -> DataFrame:
    """Days inside the season across all years; without bounds the whole record."""
    kept = flow.filter(F.col("q").isNotNull() & ~F.isnan("q"))
    return kept if start is None or end is None else kept.filter(in_season("d", start, end))


def duration_curve(flow: DataFrame, start=None, end=None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, q, rank, n, exceedance``: rank i of n, highest first, is exceeded i/n of the time."""
    return numbered_curve(season_flows(flow, start, end), keys)


def exceedance_at(curve: DataFrame, discharges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per cent exceedance of chosen discharges, interpolated on the curve.

    100 below the record, 0 above it. Equal flows act as one point with the highest
    exceedance. ``discharges`` has ``q`` and, if it differs by key, the keys.
    """
    keys = list(keys)
    none = F.lit(None).cast("double")
    if keys and set(keys) <= set(discharges.columns):
        points = curve.select(*keys, "q", F.col("exceedance").alias("e"), F.lit(None).cast("boolean").alias("asked"))
        both = points.unionByName(discharges.select(*keys, "q", none.alias("e"), F.lit(True).alias("asked")))
    else:
        # The first point of every curve carries the shared questions along: one scan, no join.
        shared = discharges.agg(F.collect_set(F.col("q").cast("double")).alias("l")).scalar()
        rows = F.when(F.col("rank") == 1, F.concat(F.array(none), shared)).otherwise(F.array(none))
        both = curve.select(*keys, "q", "exceedance", F.explode(rows).alias("_x")).select(
            *keys,
            F.coalesce("_x", "q").alias("q"),
            F.when(F.col("_x").isNull(), F.col("exceedance")).alias("e"),
            F.when(F.col("_x").isNotNull(), True).alias("asked"),
        )
    merged = both.groupBy(*keys, "q").agg(F.max("e").alias("e"), F.max("asked").alias("asked"))
    spec = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("q")
    point = F.when(F.col("e").isNotNull(), F.struct("q", "e"))
    before = F.last(point, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))
    placed = merged.withColumn("_a", before).withColumn("_b", after).filter("asked")
    slope = (F.col("_b.e") - F.col("_a.e")) / (F.col("_b.q") - F.col("_a.q"))
    value = (
        F.when(F.col("e").isNotNull(), F.col("e"))
        .when(F.col("_a").isNull(), F.lit(100.0))
        .when(F.col("_b").isNull(), F.lit(0.0))
        .otherwise(F.col("_a.e") + (F.col("q") - F.col("_a.q")) * slope)
    )
    return placed.select(*keys, "q", value.alias("exceedance"))


def annual_peaks(flow: DataFrame, start: tuple[int, int] = (10, 1), keys: Sequence[str] = ()) -> DataFrame:
    """Largest flow per water year, labelled by the year it ends in."""
    finite = flow.filter(F.col("q").isNotNull() & ~F.isnan("q"))
    return finite.groupBy(*keys, water_year("d", start).alias("year")).agg(F.max("q").alias("peak"))


def return_periods(peaks: DataFrame, discharges: DataFrame | None = None, keys: Sequence[str] = (), peak: str = "peak", minimum: int = 10) -> DataFrame:
    """``keys, q, period`` in years from a Gumbel fit by moments, never below 1.

    A series with fewer than ``minimum`` peaks, or without spread, fails when computed.
    """
    keys = list(keys)
    fit = peaks.filter(F.col(peak).isNotNull()).groupBy(*keys).agg(
        F.count(peak).alias("_n"), F.avg(peak).alias("_m"), F.stddev_samp(peak).alias("_s")
    )
    scale = F.col("_s") * (6.0**0.5 / 3.141592653589793)
    fit = fit.withColumn(
        "_scale",
        F.when(F.col("_n") < minimum, F.raise_error(F.lit(f"a Gumbel fit needs at least {minimum} peaks")).cast("double"))
        .when(F.col("_s") <= 0, F.raise_error(F.lit("the peaks have no spread")).cast("double"))
        .otherwise(scale),
    ).withColumn("_loc", F.col("_m") - F.lit(K.GUMBEL_EULER) * F.col("_scale"))
    asked = (peaks.select(*keys, F.col(peak).alias("q")) if discharges is None else discharges).distinct()
    shared = [k for k in keys if k in asked.columns]
    if shared:
        placed = asked.join(fit, shared)
    else:
        one = fit.select(F.struct("_scale", "_loc").alias("f")).scalar()
        placed = asked.withColumn("_f", one).select("*", "_f.*")
    below = F.exp(-F.exp(-(F.col("q") - F.col("_loc")) / F.col("_scale")))
    period = F.greatest(F.lit(1.0), F.lit(1.0) / (F.lit(1.0) - F.least(below, F.lit(1.0 - 1e-9))))
    return placed.select(*keys, "q", period.alias("period"))


def season_days(seasons: DataFrame) -> DataFrame:
    """``species, lifestage, md``: the calendar days of every season that has both bounds."""
    md = lambda p: F.col(f"{p}_m") * 100 + F.col(f"{p}_d")
    days = F.expr("sequence(date'2000-01-01', date'2000-12-31')")
    listed = seasons.filter("start_m IS NOT NULL AND end_m IS NOT NULL").select("species", "lifestage", md("start").alias("_s"), md("end").alias("_e"), F.explode(days).alias("_d"))
    return listed.filter(in_season("_d", "_s", "_e")).select("species", "lifestage", month_day("_d").alias("md"))


def seasonal_duration(flow: DataFrame, seasons: DataFrame, discharges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exceedance of the modelled discharges in every season of every species and lifestage.

    Seasons become calendar days first, so flows meet them by an equality join. Pairs the
    record does not cover are absent.
    """
    pair = ["species", "lifestage"]
    inside = season_flows(flow).withColumn("md", month_day("d")).join(season_days(seasons), "md")
    curve = numbered_curve(inside, [*keys, *pair])
    found = exceedance_at(curve, discharges, [*keys, *pair])
    size = curve.groupBy(*keys, *pair).agg(F.max("n").alias("days_in_season"))
    return found.join(size, [*keys, *pair]).withColumn("code", short_code("species", "lifestage"))
