"""Grids as text: a few header lines (``ncols 4``), then one line of numbers per grid row.

Large files are split, so a line does not know its row. Lines of a split are numbered in the order
they are read; one row per split carries the counts of the splits before it, which gives every
line its place in the file without sorting or gathering any file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import spread

HEADER = r"^\s*([A-Za-z_]+)\s+(\S+)\s*$"
NAMES = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "dx", "dy", "nodata_value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``layer, line, value``: the lines that are not blank, numbered from 0 in each file.

    The layer is the folder ``layer=...`` a file lies in, else the file's name.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.filter("trim(value) <> ''").withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    folder, stem = F.regexp_extract("_file", "layer=([^/]+)/", 1), F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1)
    layer = F.url_decode(F.when(folder != "", folder).otherwise(stem))
    found = lines.join(splits, ["_file", "_block"])
    return found.select(layer.alias("layer"), (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def text_grid_headers(lines: DataFrame) -> DataFrame:
    """One row per layer: the ``grids`` columns, the NoData number and how many header lines there are."""
    key, number = F.lower(F.regexp_extract("value", HEADER, 1)), F.regexp_extract("value", HEADER, 2)
    pick = {n: F.max(F.when(key == n, number.try_cast("double"))) for n in NAMES}
    head = lines.filter(key.isin(*NAMES) & (number != "")).groupBy("layer").agg(*[v.alias(n) for n, v in pick.items()], F.count("*").cast("int").alias("header"))
    dx, dy = F.coalesce("dx", "cellsize"), F.coalesce("dy", "cellsize")
    left = F.coalesce(F.col("xllcorner"), F.col("xllcenter") - dx / 2)
    low = F.coalesce(F.col("yllcorner"), F.col("yllcenter") - dy / 2)
    return head.select(
        "layer", F.col("nrows").cast("int").alias("nrows"), F.col("ncols").cast("int").alias("ncols"), left.alias("x0"), (low + F.col("nrows") * dy).alias("y0"),
        dx.alias("dx"), dy.alias("dy"), F.lit(None).cast("string").alias("crs"), F.coalesce("nodata_value", F.lit(K.NODATA)).alias("nodata"), "header"
    )


def read_text_grids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``layer, r, c, v`` of all cells that are not NoData, and the ``grids`` table of the headers."""
    lines = numbered_lines(spark, path)
    heads = text_grid_headers(lines)
    body = lines.join(heads.select("layer", "nodata", "header"), "layer").filter(F.col("line") >= F.col("header"))
    cells = body.select(
        "layer", (F.col("line") - F.col("header")).cast("int").alias("r"), "nodata", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "_v")
    )
    cells = cells.withColumn("v", F.expr("try_cast(_v AS double)")).filter("v IS NOT NULL AND NOT isnan(v) AND v <> nodata")
    return cells.select("layer", "r", "c", "v"), heads.drop("nodata", "header")


def write_text_grids(cells: DataFrame, grids: DataFrame, path: str, nodata: float = K.NODATA) -> None:
    """Write every layer of ``layer, r, c, v`` as one text file under ``layer=...``, for the geometry in ``grids``.

    Lines are made in parallel, a grid row at a time; a layer's lines are then sorted and streamed into its file.
    """
    known = cells.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("layer", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("_row"))
    rows = spread(grids.withColumn("r", F.explode(F.expr("sequence(0, nrows - 1)"))), "layer", "r").join(known, ["layer", "r"], "left")
    number = lambda c: F.coalesce(F.try_element_at("_row", c), F.lit(float(nodata))).cast("string")
    line = F.array_join(F.transform(F.expr("sequence(0, ncols - 1)"), number), " ")
    body = rows.select("layer", F.col("r").alias("_order"), line.alias("value"))
    low = F.col("y0") - F.col("nrows") * F.abs("dy")
    named = [("ncols", F.col("ncols")), ("nrows", F.col("nrows")), ("xllcorner", F.col("x0")), ("yllcorner", low), ("dx", F.abs("dx")), ("dy", F.abs("dy")), ("nodata_value", F.lit(float(nodata)))]
    entries = F.array(*[F.struct(F.lit(i - len(named)).alias("_order"), F.concat_ws(" ", F.lit(n), v.cast("string")).alias("value")) for i, (n, v) in enumerate(named)])
    head = grids.select("layer", F.explode(entries).alias("e")).select("layer", "e._order", "e.value")
    every = spread(head.unionByName(body), "layer").sortWithinPartitions("layer", "_order")
    every.select("layer", "value").write.mode("overwrite").partitionBy("layer").text(path)
