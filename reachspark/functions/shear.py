"""Bed shear: grain mobility, flow resistance closures and the Shields stress.

The closure blends the variable-power law of Rickenmann and Recking (2011) for coarse,
shallow beds with the fully rough logarithmic law for deep flow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .algebra import as_col


def d84(grain, kind: str = "dmean", factor: float = K.D84_PER_DMEAN) -> Column:
    """D84 from a grain size: measured as is, mean or median scaled."""
    if kind == "d84":
        return as_col(grain)
    if kind in ("d50", "dmean"):
        return as_col(grain) * F.lit(factor)
    raise ValueError(f"unsupported grain kind {kind!r}")


def critical_grain(h, u, tau_cr: float, n: float, safety: float = 1.0) -> Column:
    """Largest grain the flow can move; NULL on dry cells."""
    h, u = as_col(h), as_col(u)
    mobile = F.pow(u * F.lit(n), 2.0) / (
        F.lit((K.RELATIVE_GRAIN_DENSITY - 1.0) * tau_cr) * F.pow(h, F.lit(1.0 / 3.0))
    )
    return F.when(h > 0, mobile / F.lit(safety))


def froude(h, u, g: float) -> Column:
    """Froude number; NULL on dry cells."""
    h = as_col(h)
    return F.when(h > 0, as_col(u) / F.sqrt(F.lit(g) * h))


def power_law_ratio(x) -> Column:
    """U/u* of the variable-power law at relative depth h/D84."""
    x = as_col(x)
    return F.lit(4.416) * F.pow(x, 1.904) * F.pow(1.0 + F.pow(x / F.lit(1.283), 1.618), -1.083)


def log_law_ratio(chi) -> Column:
    """U/u* of the logarithmic law at relative submergence h/ks."""
    return F.lit(5.75) * F.log10(F.lit(12.2) * as_col(chi))


def blend_weight(chi, low: float = K.SUBMERGENCE_LOW, high: float = K.SUBMERGENCE_HIGH) -> Column:
    """Smoothstep from 0 at ``low`` to 1 at ``high``."""
    if not 0.0 < low < high:
        raise ValueError("need 0 < low < high")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (as_col(chi) - F.lit(low)) / F.lit(high - low)))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def with_bed_shear(
    df: DataFrame,
    d84_col,
    h="h",
    u="u",
    g: float = K.GRAVITY_SI,
    density: float = K.RELATIVE_GRAIN_DENSITY,
    ks_factor: float = K.KS_PER_D84,
    low: float = K.SUBMERGENCE_LOW,
    high: float = K.SUBMERGENCE_HIGH,
) -> DataFrame:
    """Add ``ustar2, theta84, h_over_ks, regime``; invalid cells get NULL and regime 0.

    Built in stages so each power and logarithm is evaluated once per row.
    """
    if g <= 0 or density <= 1 or ks_factor <= 0 or not 0.0 < low < high:
        raise ValueError("unphysical closure parameters")
    hc, uc = as_col(h), as_col(u)
    staged = df.withColumn("_d", as_col(d84_col))
    valid = (uc >= 0) & (hc > 0) & (F.col("_d") > 0)
    staged = staged.withColumn("_x", F.when(valid, hc / F.col("_d")))
    staged = staged.withColumn("_chi", F.when(valid, hc / (F.lit(ks_factor) * F.col("_d"))))
    staged = staged.withColumn("_rr", power_law_ratio("_x"))
    deep = F.col("_chi") > F.lit(low)
    staged = staged.withColumn("_ll", F.when(deep, log_law_ratio("_chi")).otherwise(F.col("_rr")))
    staged = staged.withColumn("_w", blend_weight("_chi", low, high))
    coef = (F.lit(1.0) - F.col("_w")) / (F.col("_rr") * F.col("_rr")) + F.col("_w") / (F.col("_ll") * F.col("_ll"))
    staged = staged.withColumn("ustar2", uc * uc * coef)
    staged = staged.withColumn("ustar2", F.when(F.abs("ustar2") < F.lit(float("inf")), F.col("ustar2")))
    staged = staged.withColumn("theta84", F.col("ustar2") / (F.lit(g * (density - 1.0)) * F.col("_d")))
    done = F.col("theta84").isNotNull()
    chi = F.col("_chi")
    regime = F.when(~done, 0).when(chi <= low, 1).when(chi < high, 2).otherwise(3)
    return (
        staged.withColumn("h_over_ks", F.when(done, chi))
        .withColumn("regime", regime.cast("int"))
        .drop("_d", "_x", "_chi", "_rr", "_ll", "_w")
    )
