"""Bills of quantities, percentage rates and cost per habitat gained, for many projects at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.algebra import as_col
from ..session import values_table

ITEM_DDL = "pos int, key string, grp string, task string, rate double, per string, source string"


def cost_items(spark: SparkSession, unit: str = "us", grp: str | None = None) -> DataFrame:
    """Priced works in one unit system, optionally of one group."""
    pick = 0 if unit == "us" else 1
    rows = []
    for i, (key, group, task, us, si, per_us, per_si, source) in enumerate(K.COST_ITEMS):
        if grp is None or group == grp:
            rows.append((i, key, group, task, float((us, si)[pick]), (per_us, per_si)[pick], source))
    return values_table(spark, rows, ITEM_DDL)


def to_rate_unit(area, per, log_length: float = K.LOG_LENGTH) -> Column:
    """A mapped area in the unit a work is priced per; NULL when that needs more than an area."""
    a, per = as_col(area), as_col(per)
    return (
        F.when(per == "acre", a / K.SQFT_PER_ACRE)
        .when(per == "sq yard", a / 9.0)
        .when(per == "m2", a)
        .when(per.isin("log", "piece", "tree", "rootwad"), a / (log_length**2))
    )


def quantities(sources: DataFrame, unit: str = "us", log_length: float = K.LOG_LENGTH) -> DataFrame:
    """``project, key, quantity`` from ``project, source, amount``.

    Sources are feature ids with mapped areas, plus ``terraforming_area``, ``earthworks_volume``
    and ``project_area``. Volumes are cubic length units. A quantity that does not follow from
    an area is NULL and stays in the result to be reported.
    """
    items = cost_items(sources.sparkSession, unit).filter("source <> ''")
    joined = sources.join(items, "source")
    volume = F.col("amount") / K.CUBIC_FEET_PER_YARD if unit == "us" else F.col("amount")
    amount = F.when(F.col("source") == "earthworks_volume", volume).otherwise(to_rate_unit("amount", "per", log_length))
    return joined.select("project", "key", "per", amount.alias("quantity"))


def bill(given: DataFrame, unit: str = "us") -> DataFrame:
    """Priced lines ``project, key, grp, task, per, rate, quantity, cost`` of the given quantities.

    A work without a quantity costs nothing yet; its quantity stays NULL, so that the report can name it.
    """
    named = given.select("project", "key", "quantity").join(cost_items(given.sparkSession, unit), "key")
    cost = F.coalesce(F.col("quantity") * F.col("rate"), F.lit(0.0))
    return named.select("project", "pos", "key", "grp", "task", "per", "rate", "quantity", cost.alias("cost"))


def group_sums(lines: DataFrame) -> DataFrame:
    """Cost per project and group."""
    return lines.groupBy("project", "grp").agg(F.sum("cost").alias("cost"))


def construction(lines: DataFrame) -> DataFrame:
    """Construction total per project."""
    return lines.groupBy("project").agg(F.sum("cost").alias("construction"))


def compounded(rates: Sequence[tuple[str, str, float]] = K.RATES) -> list[tuple[int, str, str, float, float]]:
    """Rates with the multiplier of the construction sum each one amounts to."""
    out, running = [], 1.0
    for i, (key, label, fraction) in enumerate(rates):
        out.append((i, key, label, fraction, running * fraction))
        running += running * fraction
    return out


def applied_rates(totals: DataFrame, rates: Sequence[tuple[str, str, float]] = K.RATES) -> DataFrame:
    """``project, pos, key, label, fraction, amount``: each rate applies to the running total."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(k).alias("key"), F.lit(t).alias("label"), F.lit(f).alias("fraction"), F.lit(m).alias("share"))
            for i, k, t, f, m in compounded(rates)
        ]
    )
    return totals.select("project", "construction", F.explode(rows).alias("s")).select(
        "project", "s.pos", "s.key", "s.label", "s.fraction", (F.col("construction") * F.col("s.share")).alias("amount")
    )


def grand_total(totals: DataFrame, rates: Sequence[tuple[str, str, float]] = K.RATES) -> DataFrame:
    """``project, construction, total`` with all rates applied."""
    factor = 1.0 + sum(m for *_, m in compounded(rates))
    return totals.withColumn("total", F.col("construction") * F.lit(factor))


def habitat_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """``project, before, after, gain, relative`` of two seasonal habitat areas (``sharea``).

    The relative gain is infinite from nothing. A missing area on either side fails.
    """
    missing = F.raise_error(F.lit("a condition has no seasonal habitat area; the comparison would not be like for like")).cast("double")
    both = before.select("project", F.col("sharea").alias("_b")).join(after.select("project", F.col("sharea").alias("_a")), "project", "full")
    both = both.select("project", F.coalesce("_b", missing).alias("before"), F.coalesce("_a", missing).alias("after"))
    gain = F.col("after") - F.col("before")
    relative = F.when(F.col("before") != 0, gain / F.when(F.col("before") != 0, F.col("before"))).otherwise(F.lit(float("inf")))
    return both.withColumn("gain", gain).withColumn("relative", relative)


def cost_benefit(totals: DataFrame, gains: DataFrame) -> DataFrame:
    """Cost per area gained; NULL unless habitat increases."""
    joined = totals.join(gains, "project")
    return joined.withColumn("cost_per_area", F.when(F.col("gain") > 0, F.col("total") / F.when(F.col("gain") > 0, F.col("gain"))))


def report(lines: DataFrame, rates: Sequence[tuple[str, str, float]] = K.RATES, gains: DataFrame | None = None) -> DataFrame:
    """All rows of the cost report ``project, section, item, quantity, per, rate, cost``.

    Priced lines, works whose quantity is not known, group sums, and everything that follows from a project's total; the last part
    is one row per project expanded into its report rows.
    """
    none = F.lit(None).cast("double")
    columns = ["project", "section", "item", "quantity", "per", "rate", "cost"]
    priced = lines.filter("quantity <> 0").withColumn("section", F.col("grp")).withColumn("item", F.col("task")).select(columns)
    unknown = lines.filter("quantity IS NULL").select(
        "project", F.lit("UNQUANTIFIED").alias("section"), F.col("task").alias("item"), none.alias("quantity"), "per", "rate", none.alias("cost")
    )
    priced = priced.unionByName(unknown)
    sums = group_sums(lines)
    grouped = sums.filter("cost <> 0").select(
        "project", F.lit("SUM").alias("section"), F.col("grp").alias("item"), none.alias("quantity"), F.lit("").alias("per"), none.alias("rate"), "cost"
    )

    def row(section, item, cost, quantity=None):
        return F.struct(
            F.lit(section).alias("section"), F.lit(item).alias("item"), (none if quantity is None else quantity).alias("quantity"),
            F.lit("").alias("per"), none.alias("rate"), cost.alias("cost"),
        )

    full = grand_total(sums.groupBy("project").agg(F.sum("cost").alias("construction")), rates)
    whole = F.col("construction")
    rows = [row("SUM", "TOTAL CONSTRUCTION WORKS", whole)]
    rows += [row("RATE", label, whole * F.lit(share), F.lit(fraction * 100.0)) for _, _, label, fraction, share in compounded(rates)]
    rows.append(row("TOTAL", "", F.col("total")))
    if gains is not None:
        full = full.join(gains, "project", "left")
        gained = F.when(F.col("gain") > 0, F.col("total") / F.when(F.col("gain") > 0, F.col("gain")))
        for item, name in (("SHArea before", "before"), ("SHArea after", "after"), ("net gain", "gain")):
            rows.append(F.when(F.col(name).isNotNull(), row("HABITAT", item, none, F.col(name))))
        rows.append(F.when(gained.isNotNull(), row("HABITAT", "cost per area gained", gained)))
    totals = full.select("project", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("project", "s.*")
    return priced.unionByName(grouped).unionByName(totals.select(columns))
