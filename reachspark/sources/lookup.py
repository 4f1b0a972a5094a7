"""Parameter tables: features, suitability curves, seasons, thresholds, recruitment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.naming import match_key
from ..session import values_table

FEATURE_DDL = (
    "fid string, name string, grp string, ord int, tau_cr double, safety_factor double, h_max double, u_max double, "
    "froude_max double, d2w_min double, d2w_max double, det_min double, det_max double, grain_max double, "
    "terrain_slope double, scour_rate double, fill_rate double, design_frequency double, inverse_tcd boolean, "
    "mu_avoid array<string>, mu_relevant array<string>, mu_method int, lifespan_mapping boolean, design_mapping boolean"
)


@dataclass(frozen=True)
class Feature:
    """Thresholds of one restoration feature; an absent threshold is not applied."""

    fid: str
    name: str
    grp: str = ""
    ord: int = 0
    tau_cr: float | None = None
    safety_factor: float | None = None
    h_max: float | None = None
    u_max: float | None = None
    froude_max: float | None = None
    d2w_min: float | None = None
    d2w_max: float | None = None
    det_min: float | None = None
    det_max: float | None = None
    grain_max: float | None = None
    terrain_slope: float | None = None
    scour_rate: float | None = None
    fill_rate: float | None = None
    design_frequency: float | None = None
    inverse_tcd: bool = False
    mu_avoid: tuple[str, ...] = field(default=())
    mu_relevant: tuple[str, ...] = field(default=())
    mu_method: int = 0
    lifespan_mapping: bool = True
    design_mapping: bool = False


# The default features and their thresholds, U.S. customary units.
DEFAULT_FEATURES = (
    Feature(
        "backwt", "Backwater", "Terraforming", 0,
        tau_cr=0.047,
        u_max=0.1,
        scour_rate=0.3,
        fill_rate=0.3,
        design_frequency=5.0,
        mu_relevant=("agriplain", "backswamp", "mining pit", "pond", "slackwater"),
        mu_method=1,
        design_mapping=True,
    ),
    Feature(
        "widen", "Widen", "Terraforming", 1,
        det_min=17.0,
        det_max=25.0,
        mu_relevant=("bank", "floodplain", "high floodplain", "island-floodplain", "island high floodplain", "in-channel bar", "lateral bar", "levee", "spur dike", "terrace"),
        mu_method=1,
        lifespan_mapping=False,
        design_mapping=True,
    ),
    Feature(
        "grade", "Grading", "Terraforming", 2,
        tau_cr=0.047,
        d2w_min=7.0,
        d2w_max=12.0,
        scour_rate=0.3,
        inverse_tcd=True,
        mu_avoid=("bedrock", "hillside"),
    ),
    Feature(
        "sideca", "Side cavities", "Terraforming", 3,
        fill_rate=1.0,
        inverse_tcd=True,
        mu_relevant=("bank", "cutbank", "in-channel bar", "lateral bar", "spur dike", "tailings"),
        mu_method=1,
        lifespan_mapping=False,
        design_mapping=True,
    ),
    Feature("sidech", "Side channels", "Terraforming", 4, tau_cr=0.047, fill_rate=1.0, inverse_tcd=True),
    Feature("Generic", "Generic planting", "Vegetation plantings", 5, tau_cr=0.06),
    Feature("box", "Box Elder", "Vegetation plantings", 6, tau_cr=0.06, h_max=1.0, d2w_min=1.0, d2w_max=7.0),
    Feature("cot", "Cottonwood", "Vegetation plantings", 7, h_max=2.1, u_max=3.0, d2w_min=1.0, d2w_max=7.0),
    Feature("whi", "White Alder", "Vegetation plantings", 8, tau_cr=0.06, d2w_min=1.0, d2w_max=7.0),
    Feature("wil", "Willow", "Vegetation plantings", 9, tau_cr=0.1, h_max=2.1, d2w_min=1.0, d2w_max=7.0),
    Feature("Generic_est", "Generic (established)", "Established vegetation", 10, tau_cr=0.06),
    Feature("Box_est", "Box Elder (established)", "Established vegetation", 11, tau_cr=0.06, h_max=1.0, d2w_min=1.0, d2w_max=7.0),
    Feature("cot_est", "Cottonwood (established)", "Established vegetation", 12, h_max=2.1, u_max=3.0, d2w_min=1.0, d2w_max=7.0),
    Feature("Whi_est", "White Alder (established)", "Established vegetation", 13, tau_cr=0.06, d2w_min=1.0, d2w_max=7.0),
    Feature("Wil_est", "Willow (established)", "Established vegetation", 14, tau_cr=0.1, h_max=2.1, d2w_min=1.0, d2w_max=7.0),
    Feature("wood", "Streamwood", "Nature-based engineering", 15, h_max=3.34, froude_max=1.0, design_frequency=10.0, design_mapping=True),
    Feature(
        "rocks", "Angular boulders", "Nature-based engineering", 16,
        tau_cr=0.047,
        safety_factor=1.3,
        scour_rate=3.0,
        design_frequency=20.0,
        design_mapping=True,
    ),
    Feature("bio", "Other nature-based eng.", "Nature-based engineering", 17, d2w_max=12.0, terrain_slope=0.2, design_mapping=True),
    Feature(
        "gravin", "Gravel: In", "Connectivity", 18,
        tau_cr=0.047,
        design_frequency=10.0,
        mu_relevant=("chute", "fast glide", "flood runner", "bedrock", "in-channel bar", "lateral bar", "medial bar", "pool", "riffle", "riffle transition", "run", "slackwater", "slow glide", "swale", "tailings"),
        mu_method=1,
        design_mapping=True,
    ),
    Feature(
        "gravou", "Gravel: Out", "Connectivity", 19,
        tau_cr=0.047,
        scour_rate=3.0,
        design_frequency=1.0,
        mu_relevant=("agriplain", "backswamp", "bank", "cutbank", "flood runner", "floodplain", "high floodplain", "hillside", "island high floodplain", "island-floodplain", "in-channel bar", "lateral bar", "levee", "medial bar", "mining pit", "point bar", "pond", "spur dike", "tailings", "terrace"),
        mu_method=1,
        design_mapping=True,
    ),
    Feature(
        "fines", "Incorporation of fine sediment", "Connectivity", 20,
        tau_cr=0.03,
        d2w_min=1.0,
        d2w_max=10.0,
        grain_max=0.0066667,
        scour_rate=3.0,
        fill_rate=3.36,
        design_mapping=True,
    ),
)


def default_features() -> dict[str, Feature]:
    """The built-in features by id, in definition order."""
    return {f.fid: f for f in DEFAULT_FEATURES}


def features_table(spark: SparkSession, features: Iterable[Feature] | None = None) -> DataFrame:
    """Features as a table."""
    chosen = list(default_features().values() if features is None else features)
    return values_table(spark, [[getattr(f, x.name) for x in fields(Feature)] for f in chosen], FEATURE_DDL)


def features_from_table(table: DataFrame) -> DataFrame:
    """A typed features table from a text one (one row per feature, as exported).

    Unit lists are comma separated, ``na`` and blanks are dropped; numbers that do not parse
    are absent.
    """
    base = Feature("", "")
    out = []
    for part in FEATURE_DDL.split(", "):
        name, kind = part.split(" ", 1)
        if kind == "array<string>":
            text = F.col(name) if name in table.columns else F.lit("")
            items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda item: F.trim(item))
            out.append(F.filter(items, lambda i: (i != "") & (F.lower(i) != "na")).alias(name))
        elif name not in table.columns:
            out.append(F.lit(getattr(base, name)).cast(kind).alias(name))
        elif kind == "boolean":
            out.append((F.coalesce(F.expr(f"try_cast({name} AS double)"), F.lit(0.0)) != 0).alias(name))
        else:
            out.append(F.expr(f"try_cast({name} AS {kind})").alias(name))
    return table.select(*out)


def load_features(table: DataFrame, limit: int = 10_000) -> list[Feature]:
    """Features of a (small, size-checked) table as plan parameters."""
    rows = table.orderBy("ord", "fid").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} features; they parameterise the plan and must stay few")
    names = [f.name for f in fields(Feature)]
    tidy = lambda v: tuple(v) if isinstance(v, list) else v
    return [Feature(**{n: tidy(row[n]) for n in names if row[n] is not None}) for row in rows]


def feature_groups(features: DataFrame) -> DataFrame:
    """``grp, first, ord, fid``: features by group, groups and members in definition order."""
    named = features.withColumn("grp", F.when(F.coalesce("grp", F.lit("")) == "", "Other").otherwise(F.col("grp")))
    first = named.groupBy("grp").agg(F.min("ord").alias("first"))
    return named.join(first, "grp").select("grp", "first", "ord", "fid").orderBy("first", "ord")


def planting_depth_limit(features: Iterable[Feature] | None = None, fids: Sequence[str] | None = None) -> float:
    """Smallest ``d2w_max`` among the planting features (or the chosen ids), else the default."""
    pool = list(default_features().values() if features is None else features)
    chosen = [f for f in pool if f.fid in fids] if fids else [f for f in pool if f.grp == "Vegetation plantings"]
    limits = [f.d2w_max for f in chosen if f.d2w_max is not None]
    return float(min(limits)) if limits else K.DEFAULT_D2W_MAX


def planting_limits(features: DataFrame) -> DataFrame:
    """The depth limit of every feature group of a features table."""
    return features.groupBy("grp").agg(F.coalesce(F.min("d2w_max"), F.lit(K.DEFAULT_D2W_MAX)).alias("d2w_max"))


def curve_arrays(curves: DataFrame) -> DataFrame:
    """One row per (species, lifestage, param): ``points`` by x. Fewer than two points is no curve.

    Points are read in order until the first incomplete one.
    """
    gap = F.min(F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("pt")))
    points = F.array_sort(F.collect_list(F.struct("pt", "x", "y")))
    grouped = curves.groupBy("species", "lifestage", "param").agg(points.alias("p"), gap.alias("gap"))
    whole = F.expr("filter(p, s -> gap IS NULL OR s.pt < gap)")
    xy = F.array_sort(F.transform(whole, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))))
    return grouped.select("species", "lifestage", "param", xy.alias("points")).filter(F.size("points") >= 2)


def load_curve(curves: DataFrame, species: str, lifestage: str, param: str) -> list[tuple[float, float]] | None:
    """One curve as plan parameter; names match whatever their case and spacing."""
    wanted = " ".join(species.split()).lower(), " ".join(lifestage.split()).lower()
    chosen = curves.filter((match_key("species") == wanted[0]) & (match_key("lifestage") == wanted[1]) & (F.col("param") == param))
    row = curve_arrays(chosen).first()
    return None if row is None else [(p["x"], p["y"]) for p in row["points"]]


def resolve_names(wanted: DataFrame, known: DataFrame, columns: Sequence[str] = ("species", "lifestage")) -> DataFrame:
    """Names as the table spells them (``known_...``) next to the names asked for; NULL if unknown."""
    left = wanted
    for name in columns:
        left = left.withColumn(f"_{name}", match_key(name))
    right = known.select(*[F.col(n).alias(f"known_{n}") for n in columns]).distinct()
    for name in columns:
        right = right.withColumn(f"_{name}", match_key(f"known_{name}"))
    keys = [f"_{n}" for n in columns]
    return left.join(right, keys, "left").drop(*keys)


def travel_thresholds(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``h_min, u_max`` per (species, lifestage): the table first, then the built-in values.

    A pair without any ``h_min`` fails when its row is computed.
    """
    spark = pairs.sparkSession
    built_in = values_table(spark, K.TRAVEL_DEFAULTS, "species string, lifestage string, h_min double, u_max double")
    keyed = lambda df, suffix: df.select(
        match_key("species").alias("_s"), match_key("lifestage").alias("_l"), F.col("h_min").alias(f"h{suffix}"), F.col("u_max").alias(f"u{suffix}")
    )
    asked = pairs.withColumn("_s", match_key("species")).withColumn("_l", match_key("lifestage"))
    found = asked.join(keyed(table, 1), ["_s", "_l"], "left").join(keyed(built_in, 2), ["_s", "_l"], "left")
    h_min = F.coalesce("h1", "h2", F.raise_error(F.concat(F.lit("no minimum depth for "), "species", F.lit(" "), "lifestage")).cast("double"))
    return found.select(*pairs.columns, h_min.alias("h_min"), F.coalesce("u1", "u2").alias("u_max"))


@dataclass(frozen=True)
class RecruitmentParameters:
    """Species thresholds of the recruitment model; dates are (month, day)."""

    species: str = "Fremont Cottonwood"
    seed_start: tuple[int, int] = (5, 2)
    seed_end: tuple[int, int] = (6, 20)
    baseflow_start: tuple[int, int] = (9, 15)
    bed_prep_years: int = 1
    tau_cr_full: float = 0.047
    tau_cr_partial: float = 0.03
    recession_stress: float = 2.5
    recession_lethal: float = 5.0
    inundation_stress: int = 14
    inundation_lethal: int = 28
    band_lower: float | None = None
    band_upper: float | None = None


def recruitment_defaults(table: DataFrame) -> DataFrame:
    """A recruitment parameter table with every missing value replaced by its default."""
    base = RecruitmentParameters()
    out = []
    for f in fields(RecruitmentParameters):
        default = getattr(base, f.name)
        if isinstance(default, tuple):
            for i, part in enumerate(("m", "d")):
                name = f"{f.name}_{part}"
                have = F.expr(f"try_cast({name} AS int)") if name in table.columns else F.lit(None).cast("int")
                out.append(F.coalesce(have, F.lit(default[i])).alias(name))
        else:
            kind = "string" if f.name == "species" else "int" if isinstance(default, int) else "double"
            have = F.expr(f"try_cast({f.name} AS {kind})") if f.name in table.columns else F.lit(None).cast(kind)
            fallback = "unnamed" if f.name == "species" else default
            out.append(F.coalesce(have, F.lit(fallback).cast(kind)).alias(f.name))
    extra = [n for n in table.columns if n not in {f.name for f in fields(RecruitmentParameters)} and n[-2:] not in ("_m", "_d")]
    return table.select(*extra, *out)


def unit_codes(mu: DataFrame) -> DataFrame:
    """Morphological unit names with codes; each known alias is added unless the table has it."""
    own = mu.select(F.lower("name").alias("name"), "code")
    aliases = values_table(mu.sparkSession, K.UNIT_ALIASES, "alias string, name string")
    extra = aliases.join(own, "name").select(F.col("alias").alias("name"), "code").join(own.select("name"), "name", "left_anti")
    return own.unionByName(extra)


def load_codes(codes: DataFrame, limit: int = 10_000) -> dict[str, int]:
    """Unit codes as plan parameters (size checked)."""
    rows = codes.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many morphological units")
    return {row["name"]: row["code"] for row in rows}
