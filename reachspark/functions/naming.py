"""Layer names and the discharges spelled in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .algebra import as_col

# Name patterns of hydraulic layers.
NUMBER_PATTERN = r"\d+(?:_\d+)?"
DISCOVERY_PATTERN = r"(?i)^([hu])\d+(?:_\d+)?\.tif$"


def base_name(path) -> Column:
    """Last component of a path."""
    return F.substring_index(as_col(path), "/", -1)


def discharge_of(name) -> Column:
    """Discharge spelled in a layer name; ``_`` is the decimal point, NULL without digits."""
    digits = F.regexp_extract(base_name(name), NUMBER_PATTERN, 0)
    return F.nullif(F.translate(digits, "_", "."), F.lit("")).cast("double")


def hydraulic_kind(name) -> Column:
    """``h`` or ``u`` for depth and velocity layers, NULL for any other name."""
    return F.nullif(F.lower(F.regexp_extract(base_name(name), DISCOVERY_PATTERN, 1)), F.lit(""))


def discharge_token(q) -> Column:
    """File-name token: six digits, plus three decimals when the discharge is fractional."""
    q = as_col(q)
    whole = q == F.floor(q)
    fraction = F.translate(F.format_string("%010.3f", q), ".", "_")
    return F.when(whole, F.format_string("%06d", q.cast("bigint"))).when(~whole, fraction)


def own_token(name) -> Column:
    """Token as an existing layer spells it: the name without prefix letters and extension."""
    stem = F.regexp_replace(base_name(name), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"^[a-zA-Z_]+", "")


def discharge_label(q) -> Column:
    """Six significant digits without trailing zeros: ``550``, ``1.06``, ``1e+06``."""
    text = F.format_string("%.6g", as_col(q).cast("double"))
    text = F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(as_col(q).isNotNull(), F.regexp_replace(text, r"\.(e|$)", "$1"))


def short_code(species, lifestage) -> Column:
    """First two letters of each, lower case: ``chfr``."""
    return F.concat(F.substring(F.lower(as_col(species)), 1, 2), F.substring(F.lower(as_col(lifestage)), 1, 2))


def match_key(text) -> Column:
    """Lookup key that ignores case and spacing."""
    return F.lower(F.regexp_replace(F.trim(as_col(text)), r"\s+", " "))


def feature_of(layer) -> Column:
    """Feature id of a mask layer: the name without its ``best_``, ``lf_`` or ``ds_`` prefix."""
    return F.regexp_replace(as_col(layer), r"^(best_|lf_|ds_)", "")
