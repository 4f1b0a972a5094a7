"""The query registry and the adapter views.

An adapter is one SELECT that turns driver tables into cells, hydraulics or flows. The same
text runs in Spark and in the checking engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid
from ..plans.lifespan import Flood
from ..session import values_table

NCOLS = 128

VIEWS = {
    "cells_v": """
        select cast(floor(o_orderkey/128.0) as int) r, cast(o_orderkey % 128 as int) c,
          cast(o_totalprice/5000.0 as double) z, cast(0.02+(o_custkey % 50)*0.004 as double) dmean,
          cast(cast(round(o_totalprice*100) as bigint) % 2000 as double)/100 d2w,
          cast(o_custkey % 30 as int) mu, cast(o_custkey % 17 as double)/4 scour,
          cast(o_custkey % 13 as double)/3 fill, cast(o_custkey % 7 as int) k7, o_orderkey ord
        from {orders}""",
    "hydraulics_v": """
        select cast(floor(l_orderkey/128.0) as int) r, cast(l_orderkey % 128 as int) c,
          cast(l_linenumber*1000 as double) q, cast(max(l_quantity)/5.0 as double) h,
          cast(max(l_tax)*100 as double) u, cast(max(l_partkey) % 7 - 3 as double) ux,
          cast(max(l_suppkey) % 5 - 2 as double) uy
        from {lineitem} group by l_orderkey, l_linenumber""",
    "flow_v": """
        select cast(o_orderdate as date) d,
          1000 + cast(cast(sum(cast(round(o_totalprice*100) as bigint)) as bigint) % 768000 as double)/128 q
        from {orders} group by cast(o_orderdate as date)""",
    "gauge_flow_v": """
        select cast(l_suppkey as int) gauge, cast(l_shipdate as date) d, cast(max(l_extendedprice) as double) q
        from {lineitem} group by l_suppkey, cast(l_shipdate as date)""",
    "catalog_v": """
        select distinct cast(l_suppkey as int) condition,
          case when l_linenumber = 7 then 'dem.tif' when l_linenumber = 6 then 'dmean.tif'
            else concat(case when l_linenumber % 2 = 0 then 'h' else 'u' end,
              case when l_partkey % 3 = 0 then printf('%06d', cast(l_partkey % 40 * 25 as bigint))
                else concat(printf('%06d', cast(l_partkey % 40 as bigint)), '_', printf('%03d', cast(l_partkey % 9 * 100 as bigint))) end,
              '.tif') end name
        from {lineitem} where l_orderkey >= 0""",
    "lines_v": """
        select cast(o_custkey as int) condition, o_orderkey line_no,
          case cast(o_orderkey % 8 as int)
            when 0 then concat('Return periods = ', cast(o_custkey % 7 + 1 as varchar(9)), ', , ', cast(o_custkey % 5 + 10 as varchar(9)), ' #[LIST]')
            when 1 then concat('Flow depth (h) = h', printf('%06d', cast(o_custkey % 40 as bigint)), '.tif, h000100_500.tif # x')
            when 2 then concat('  Flow velocity (u) = u', printf('%06d', cast(o_custkey % 40 as bigint)), '.tif , u000100_500.tif')
            when 3 then 'DEM of differences = fill, scour # dem'
            when 4 then concat('Detrended DEM = det', cast(o_custkey % 3 as varchar(9)), ', other')
            when 5 then concat('DEM = dem', cast(o_custkey % 4 as varchar(9)), ' # DEM = no')
            when 6 then '# Grain sizes = commented'
            else 'Grain sizes (D mean) =   # empty' end line
        from {orders}""",
}

DISCHARGES = [(1, 1000.0, 1.0), (2, 2000.0, 2.0), (3, 3000.0, 5.0), (4, 4000.0, 10.0), (5, 5000.0, 20.0), (6, 6000.0, 40.0), (7, 7000.0, 50.0)]
FLOODS = [Flood(*row) for row in DISCHARGES]
FLOODS_SQL = "select * from (values " + ", ".join(map(str, DISCHARGES)) + ") t(pos, q, period)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Driver tables of one scale and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        needed = {t: self.table(t) for t in ("orders", "lineitem", "part", "customer", "nation", "supplier") if "{" + t + "}" in text}
        return self.spark.sql(text, **needed)

    def values(self, rows, ddl: str) -> DataFrame:
        return values_table(self.spark, rows, ddl)

    @property
    def cells(self) -> DataFrame:
        return self.view("cells_v")

    def layer(self, column: str = "z") -> DataFrame:
        return self.cells.select("r", "c", F.col(column).cast("double").alias("v"))

    @property
    def hydraulics(self) -> DataFrame:
        return self.view("hydraulics_v")

    @property
    def flow(self) -> DataFrame:
        return self.view("flow_v")

    @property
    def gauges(self) -> DataFrame:
        return self.view("gauge_flow_v")

    @property
    def discharges(self) -> DataFrame:
        return self.values(DISCHARGES, "pos int, q double, return_period double")

    @cached_property
    def grid(self) -> Grid:
        """128 columns wide; the last row holds the largest key."""
        return Grid((self.table("orders").agg(F.max("o_orderkey")).first()[0] or 0) // NCOLS + 1, NCOLS)


def sql(*views: str, body: str, ctes: str = "") -> str:
    """An oracle: the named adapter views, further CTEs, and the body."""
    names = {t: t for t in ("orders", "lineitem", "part", "customer", "nation", "supplier")}
    parts = [f"{v} as ({VIEWS[v].format(**names)})" for v in views]
    if ctes:
        parts.append(ctes)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, oracle: str | None = None):
    """Register ``fn(data) -> DataFrame`` under a name, with its oracle text if it has one."""

    def register(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison; negative zero becomes zero."""
    out = []
    for field in df.schema.fields:
        if field.dataType.typeName() == "double":
            out.append((F.round(field.name, special.get(field.name, digits)) + F.lit(0.0)).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)
