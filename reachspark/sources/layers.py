"""Layers on disk: Parquet cells partitioned by condition and layer, NoData reconciled at ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.algebra import no_data
from ..functions.naming import feature_of

SHEAR_QUANTITIES = ("theta84", "ustar2", "h_over_ks", "regime")


def read_layers(spark: SparkSession, path: str, layers: Sequence[str] | None = None) -> DataFrame:
    """Cells of a layer store; naming the layers prunes partitions."""
    cells = spark.read.parquet(path)
    if layers is not None:
        cells = cells.filter(F.col("layer").isin(list(layers)))
    return cells


def read_layer(cells: DataFrame, layer: str, sentinel: float | None = None) -> DataFrame:
    """One layer as ``r, c, v`` without its NoData cells."""
    one = cells.filter(F.col("layer") == layer).withColumn("v", no_data("v", sentinel))
    return one.filter(F.col("v").isNotNull()).drop("layer")


def write_layers(cells: DataFrame, path: str, partition_by: Sequence[str] = ("layer",), mode: str = "overwrite") -> None:
    """Store cells by layer, sorted inside each file so that row ranges can be skipped."""
    keys = list(partition_by)
    cells.repartition(*keys, F.floor(F.col("r") / 256)).sortWithinPartitions(*keys, "r", "c").write.mode(mode).partitionBy(*keys).parquet(path)


def encoded(cells: DataFrame, value: str = "v", nodata: float = K.NODATA, dtype: str = "float") -> DataFrame:
    """Cells as an exchange format expects them: NoData spelled as a number, single precision."""
    return cells.withColumn(value, F.coalesce(no_data(value), F.lit(nodata)).cast(dtype))


def write_csv(cells: DataFrame, path: str, value: str = "v", nodata: float = K.NODATA) -> None:
    """Cells as CSV with NoData spelled out."""
    encoded(cells, value, nodata).write.mode("overwrite").option("header", True).csv(path)


def list_layers(cells: DataFrame, pattern: str = "*", keys: Sequence[str] = ()) -> DataFrame:
    """Layer names matching a shell-style pattern, sorted."""
    like = pattern.replace("_", r"\_").replace("*", "%").replace("?", "_")
    return cells.select(*keys, "layer").distinct().filter(F.col("layer").like(like)).orderBy(*keys, "layer")


def grid_profiles(cells: DataFrame, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0, crs: str | None = None, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """One ``grids`` row per key, measured once at ingest; later reads use only this table."""
    extent = cells.groupBy(*keys).agg((F.max("r") + 1).cast("int").alias("nrows"), (F.max("c") + 1).cast("int").alias("ncols"))
    fixed = {"x0": x0, "y0": y0, "dx": dx, "dy": dy}
    for name, number in fixed.items():
        extent = extent.withColumn(name, F.lit(float(number)))
    return extent.withColumn("crs", F.lit(crs).cast("string"))


def reconcile_nodata(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """Every declared sentinel becomes NULL; layers without a declaration keep all their values."""
    joined = cells.join(declared.select("layer", F.col("nodata").alias("_nd")), "layer", "left")
    masked = F.when(F.col("_nd").isNull() | (F.col("v") != F.col("_nd")), F.col("v"))
    return joined.withColumn("v", masked).drop("_nd")


def reconcile_report(cells: DataFrame, declared: DataFrame, canonical: float = K.NODATA) -> DataFrame:
    """Per layer the masked cells before and after, and what was done.

    ``before`` counts cells equal to the declared sentinel, ``after`` the NULLs that result;
    a difference means the mask changed.
    """
    joined = cells.join(declared.select("layer", F.col("nodata").alias("_nd")), "layer", "left")
    masked = F.when(F.col("_nd").isNull() | (F.col("v") != F.col("_nd")), F.col("v"))
    counted = joined.groupBy("layer").agg(
        F.max("_nd").alias("nodata"),
        F.count(F.when(F.col("v").isNull() | (F.col("v") == F.col("_nd")), True)).alias("before"),
        F.count(F.when(masked.isNull(), True)).alias("after"),
    )
    status = F.when(F.col("nodata").isNull(), "declared only").when(F.col("nodata") == canonical, "unchanged").otherwise("rewritten")
    return counted.withColumn("status", status)


def shear_layers(shear: DataFrame, keys: Sequence[str] = ("q",)) -> DataFrame:
    """The four shear quantities as long layers; regime 0 stands for NoData and is dropped."""
    regime = F.when(F.col("regime") > 0, F.col("regime").cast("double"))
    parts = F.array(
        *[
            F.struct(F.lit(K.SHEAR_LAYER_PREFIX[n]).alias("layer"), (regime if n == "regime" else F.col(n)).alias("v"))
            for n in SHEAR_QUANTITIES
        ]
    )
    return shear.select(*keys, "r", "c", F.explode(parts).alias("s")).select(*keys, "r", "c", "s.*").filter("v IS NOT NULL")


def action_masks(masks: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Feature masks with their application order ``ord``.

    The caller's order wins; otherwise masks apply by layer name. Only positive cells count.
    """
    named = masks.filter("v > 0").withColumn("fid", feature_of("layer"))
    if order is None:
        return named.withColumn("ord", F.col("layer").cast("string"))
    position = None
    for i, fid in enumerate(order):
        hit = F.col("fid") == fid
        position = F.when(hit, F.lit(i)) if position is None else position.when(hit, F.lit(i))
    return named.withColumn("ord", position).filter("ord IS NOT NULL")


def velocity_components(hydraulics: DataFrame, keys: Sequence[str] = ("q",)) -> DataFrame:
    """Cells of the discharges that carry both flow components; a missing value counts as 0."""
    both = hydraulics.groupBy(*keys).agg(F.count("ux").alias("_x"), F.count("uy").alias("_y")).filter("_x > 0 AND _y > 0")
    kept = hydraulics.join(both.select(*keys), list(keys), "left_semi")
    return kept.withColumn("ux", F.coalesce("ux", F.lit(0.0))).withColumn("uy", F.coalesce("uy", F.lit(0.0)))


def cover_layers(cells: DataFrame, grain_layer: str = "dmean", overrides: DataFrame | None = None) -> DataFrame:
    """Cover inputs found among the layers as ``cover, r, c, v``; override layers replace found ones."""
    names = [n for n in K.COVER_ORDER if n != "substrate"]
    kind = F.when(F.col("layer") == grain_layer, "substrate").otherwise(F.col("layer"))
    found = cells.filter(F.col("layer").isin([grain_layer, *names])).select(kind.alias("cover"), "r", "c", "v")
    if overrides is None:
        return found
    # At most one name per cover type, so the replaced layers are a filter, not a join.
    given = [row[0] for row in overrides.select("cover").filter(F.col("cover").isin(list(K.COVER_ORDER))).distinct().collect()]
    return found.filter(~F.col("cover").isin(given)).unionByName(overrides.select("cover", "r", "c", "v"))
