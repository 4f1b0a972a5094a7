"""Conditions: definition lines, the layer catalogue, and what is wrong with them.

``catalog`` is a table ``condition, name`` of the layers that exist. ``definitions`` is the
parsed form ``condition, attribute, pos, item``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.naming import base_name, discharge_label, discharge_of, discharge_token, hydraulic_kind
from ..session import cut


def read_definition_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of definition files; the folder names the condition."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_p"))
    return lines.select(
        F.element_at(F.split("_p", "/"), -2).alias("condition"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")
    )


def parse_definitions(lines: DataFrame) -> DataFrame:
    """``condition, attribute, pos, item`` from ``condition, line_no, line``.

    Text after ``#`` is a comment. The longest known key contained in the text before ``=``
    decides; a later line replaces an earlier one. Non-list attributes keep their first item.
    """
    body = F.trim(F.substring_index("line", "#", 1))
    cut_at = F.instr(body, "=")
    keyed = lines.withColumn("_b", body).filter(cut_at > 0)
    keyed = keyed.withColumn("_k", F.lower(F.trim(F.substring_index("_b", "=", 1))))
    raw = F.trim(F.expr("substring(_b, instr(_b, '=') + 1)"))
    known = sorted(K.DEFINITION_KEYS, key=lambda row: -len(row[0]))
    texts = F.array(*[F.lit(text) for text, _ in known])
    names = F.create_map(*[F.lit(part) for row in known for part in row])
    # One lookup instead of a CASE chain: filters pushed to this column stay small.
    longest = F.get(F.filter(texts, lambda t: F.contains(F.col("_k"), t)), F.lit(0))
    attribute = F.try_element_at(names, longest)
    keyed = keyed.select("condition", "line_no", attribute.alias("attribute"), raw.alias("raw"))
    keyed = keyed.filter("attribute IS NOT NULL AND raw <> ''")
    last = keyed.groupBy("condition", "attribute").agg(F.max_by("raw", "line_no").alias("raw"))
    items = F.filter(F.transform(F.split("raw", ","), lambda item: F.trim(item)), lambda item: item != "")
    listed = F.col("attribute").endswith("_rasters") | (F.col("attribute") == "return_periods")
    items = F.when(listed, items).otherwise(F.slice(items, 1, 1))
    return last.select("condition", "attribute", F.posexplode(items).alias("pos", "item"))


def hydraulic_layers(catalog: DataFrame) -> DataFrame:
    """Depth and velocity layers of the catalogue: ``condition, kind, q, name``."""
    marked = catalog.select("condition", hydraulic_kind("name").alias("kind"), "name").filter("kind IS NOT NULL")
    return marked.select("condition", "kind", discharge_of("name").alias("q"), "name")


def discover_discharges(catalog: DataFrame, kind: str = "h") -> DataFrame:
    """Discharges of one kind of layer, numbered by (discharge, name) within a condition."""
    found = hydraulic_layers(catalog).filter(F.col("kind") == kind)
    w = Window.partitionBy("condition").orderBy("q", "name")
    return found.withColumn("pos", F.row_number().over(w) - 1)


def paired_discharges(catalog: DataFrame) -> DataFrame:
    """Discharges that have both a depth and a velocity layer."""
    layers = hydraulic_layers(catalog)
    return layers.filter("kind = 'h'").select("condition", "q").intersect(layers.filter("kind = 'u'").select("condition", "q"))


def layer_for(catalog: DataFrame, kind: str, q: float) -> DataFrame:
    """The first layer of a kind within 1e-6 of a discharge, per condition."""
    near = hydraulic_layers(catalog).filter((F.col("kind") == kind) & (F.abs(F.col("q") - F.lit(float(q))) < 1e-6))
    return near.groupBy("condition").agg(F.min(F.struct("q", "name")).alias("m")).select("condition", "m.q", "m.name")


def _existing(name):
    """File name with ``.tif`` added when it has no extension."""
    return F.when(base_name(name).rlike(r"\.[^.]+$"), F.col(name)).otherwise(F.concat(F.col(name), F.lit(".tif")))


def hydraulic_pairs(definitions: DataFrame, catalog: DataFrame) -> DataFrame:
    """``condition, pos, period, depth, velocity, q``: layers paired by their place in the lists.

    A condition without named depth layers uses the discovered ones. Periods default to the
    discharge. Pairs whose layers do not exist are skipped.
    """

    def named(attribute, alias):
        return definitions.filter(F.col("attribute") == attribute).select("condition", "pos", F.col("item").alias(alias))

    depth = named("depth_rasters", "depth")
    unnamed = catalog.join(depth.select("condition").distinct(), "condition", "left_anti")
    velocity = named("velocity_rasters", "velocity").join(depth.select("condition").distinct(), "condition", "left_semi")
    depth = depth.unionByName(discover_discharges(unnamed, "h").select("condition", "pos", F.col("name").alias("depth")))
    velocity = velocity.unionByName(discover_discharges(unnamed, "u").select("condition", "pos", F.col("name").alias("velocity")))
    periods = named("return_periods", "period").withColumn("period", F.expr("try_cast(period AS double)"))
    dated = periods.select("condition").distinct().withColumn("_dated", F.lit(True))
    pairs = depth.join(velocity, ["condition", "pos"]).join(periods, ["condition", "pos"], "left").join(dated, "condition", "left")
    pairs = pairs.withColumn("q", discharge_of("depth"))
    pairs = pairs.withColumn("period", F.when(F.col("_dated"), F.col("period")).otherwise(F.col("q"))).filter("period IS NOT NULL")
    have = catalog.select("condition", "name").distinct()
    for side in ("depth", "velocity"):
        pairs = pairs.withColumn("name", _existing(side)).join(have, ["condition", "name"], "left_semi").drop("name")
    return pairs.select("condition", "pos", "period", "depth", "velocity", "q")


def max_lifespan(definitions: DataFrame) -> DataFrame:
    """Longest return period per condition, 50 when none is given."""
    top = definitions.filter("attribute = 'return_periods'").groupBy("condition").agg(F.max(F.expr("try_cast(item AS double)")).alias("m"))
    conditions = definitions.select("condition").distinct()
    return conditions.join(top, "condition", "left").select("condition", F.coalesce("m", F.lit(K.DEFAULT_MAX_LIFESPAN)).alias("max_lifespan"))


def validate(definitions: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row ``condition, problem, detail`` per problem; a usable condition has none."""
    # each table is written once and every kind of problem is found by grouping, not by joins of its own
    catalog = cut(catalog.select("condition", "name").distinct())
    kind, attribute = hydraulic_kind("name"), F.col("attribute")
    no, none = F.lit(False), F.lit(None).cast("string")
    here = catalog.select("condition", F.coalesce(kind == "h", no).alias("h"), F.coalesce(kind == "u", no).alias("u"), none.alias("attribute"), none.alias("item"), no.alias("told"))
    told = definitions.select("condition", no.alias("h"), no.alias("u"), "attribute", "item", F.lit(True).alias("told"))
    items = lambda asked: F.collect_list(F.when(asked, F.struct("item")))
    per = here.unionByName(told).groupBy("condition").agg(
        F.max("h").alias("h"),
        F.max("u").alias("u"),
        F.max("told").alias("told"),
        items(attribute == "dem_raster").alias("dem"),
        items(attribute == "grain_raster").alias("dmean"),
        items(attribute.isin("depth_rasters", "velocity_rasters")).alias("listed"),
    )
    per = cut(per)
    # NULL equals nothing
    nameless = F.col("condition").isNull()
    row = lambda problem, detail: F.struct(F.lit(problem).alias("problem"), detail.alias("detail"))
    found = lambda df, *problems: df.select("condition", F.explode(F.array_compact(F.array(*problems))).alias("s")).select("condition", "s.*")
    without = [F.when(nameless | ~F.col(c), row(problem, F.lit(""))) for c, problem in (("told", "no definitions"), ("h", "no depth layer"), ("u", "no velocity layer"))]
    out = found(per, *without)

    label = discharge_label("q")
    flows = hydraulic_layers(catalog).groupBy("condition", "q").agg(F.max(F.col("kind") == "h").alias("h"), F.max(F.col("kind") == "u").alias("u"))
    alone = lambda one, other: F.col(one) & (nameless | F.col("q").isNull() | ~F.col(other))
    out = out.unionByName(found(flows, F.when(alone("h", "u"), row("depth without velocity", label)), F.when(alone("u", "h"), row("velocity without depth", label))))

    def missing(column, default):
        given = F.when(F.size(column) > 0, F.col(column)).otherwise(F.array(F.struct(F.lit(default).alias("item"))))
        return F.transform(given, lambda x: F.struct(F.lit(f"missing {default}").alias("problem"), F.coalesce(x["item"], F.lit(default)).alias("item")))

    asked = [missing("dem", "dem"), missing("dmean", "dmean")]
    asked.append(F.transform("listed", lambda x: F.struct(F.lit("named but absent").alias("problem"), x["item"].alias("item"))))
    named = per.select("condition", F.explode(F.concat(*asked)).alias("s")).select("condition", _existing("s.item").alias("name"), F.col("s.problem").alias("problem"))
    both = named.unionByName(catalog.select("condition", "name", none.alias("problem")))
    have = F.max(F.col("problem").isNull()) & F.col("condition").isNotNull() & F.col("name").isNotNull()
    absent = both.groupBy("condition", "name").agg(F.collect_list("problem").alias("problems"), have.alias("have")).filter("NOT have")
    return out.unionByName(absent.select("condition", F.explode("problems").alias("problem"), F.col("name").alias("detail")))


def describe(catalog: DataFrame, other_layers=("dem", "dmean", "d2w", "dem_detrend", "mu")) -> DataFrame:
    """Per condition: layer counts, discharge ranges, and which of the other layers exist."""
    marked = catalog.select("condition", "name", hydraulic_kind("name").alias("kind"), discharge_of("name").alias("q"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    pick = lambda k, v: F.when(F.col("kind") == k, v)
    return marked.groupBy("condition").agg(
        F.count(pick("h", F.lit(1))).alias("depth_layers"),
        F.min(pick("h", F.col("q"))).alias("depth_q_min"),
        F.max(pick("h", F.col("q"))).alias("depth_q_max"),
        F.count(pick("u", F.lit(1))).alias("velocity_layers"),
        F.min(pick("u", F.col("q"))).alias("velocity_q_min"),
        F.max(pick("u", F.col("q"))).alias("velocity_q_max"),
        F.array_join(F.array_sort(F.collect_set(F.when(stem.isin(list(other_layers)), stem))), ", ").alias("other_layers"),
    )


def definition_lines(discharges: DataFrame, periods: DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The definition file of each condition as ``condition, line_no, line``.

    ``discharges`` has ``condition, q`` and optionally ``depth, velocity`` (existing names);
    ``periods`` has ``condition, pos, period``. A count that differs from the discharges fails.
    """
    names = {"grain": "dmean", "detrended": "dem_detrend", "d2w": "d2w", "mu": "mu", "dem": "dem"} | (names or {})
    table = discharges
    for kind, prefix in (("depth", "h"), ("velocity", "u")):
        made = F.concat(F.lit(prefix), discharge_token("q"), F.lit(".tif"))
        table = table.withColumn(kind, F.coalesce(F.col(kind), made) if kind in discharges.columns else made)
    listing = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", c))), lambda s: s[c]), ", ")
    per = table.groupBy("condition").agg(listing("depth").alias("h"), listing("velocity").alias("u"), F.count(F.lit(1)).alias("n"))
    if periods is None:
        per = per.withColumn("p", F.lit(""))
    else:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "period"))), lambda s: s["period"].cast("string"))
        listed = periods.groupBy("condition").agg(F.array_join(ordered, ", ").alias("p"), F.count(F.lit(1)).alias("m"))
        per = per.join(listed, "condition", "left")
        checked = F.when(F.coalesce("m", F.col("n")) == F.col("n"), F.coalesce("p", F.lit("")))
        per = per.withColumn("p", checked.otherwise(F.raise_error(F.lit("return periods and discharges differ in number"))))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    lines = F.array(
        text("Return periods = ", F.col("p"), " # list of years, one per discharge"),
        text("Water depth (h) = ", F.col("h"), " # list"),
        text("Flow velocity (u) = ", F.col("u"), " # list"),
        F.lit(f"Grain sizes (D mean) = {names['grain']} # name"),
        F.lit(f"Detrended DEM = {names['detrended']} # name"),
        F.lit(f"Depth to groundwater table (d2w) = {names['d2w']} # name"),
        F.lit(f"Morphological units (mu) = {names['mu']} # name"),
        F.lit(f"DEM = {names['dem']} # name"),
        F.lit("DEM of differences = fill, scour # list"),
    )
    return per.select("condition", F.posexplode(lines).alias("line_no", "line"))
