"""Volume and area of a triangulated cell-centre surface against a horizontal plane."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from .stencil import neighbours


def corners(cells: DataFrame, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """2x2 neighbourhoods named by their upper-left cell: ``ul, ur, ll, lr``.

    Quads whose upper-left cell is missing are kept, since one of their triangles may be whole.
    """
    spots = [("ul", 0, 0), ("ur", 0, 1), ("ll", 1, 0), ("lr", 1, 1)]
    sent = F.array(
        *[
            F.struct(F.lit(i).alias("k"), (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"))
            for i, (_, dr, dc) in enumerate(spots)
        ]
    )
    rows = cells.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_z"), F.explode(sent).alias("s"))
    picks = [F.max(F.when(F.col("s.k") == i, F.col("_z"))).alias(n) for i, (n, _, _) in enumerate(spots)]
    return rows.groupBy(*keys, F.col("s.r").alias("r"), F.col("s.c").alias("c")).agg(*picks)


def triangles(cells: DataFrame, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """The triangles of the surface, two per quad, split from upper right to lower left.

    ``a`` is the corner where the legs meet, ``b`` its neighbour along the row, ``d`` along
    the column: right and down for the first triangle of a quad, left and up for the second.
    Triangles with a missing corner are dropped.
    """
    around = neighbours(cells.filter(F.col(value).isNotNull()).select(*keys, "r", "c", value), value, keys)
    tri = lambda k, b, d: F.struct(F.lit(k).alias("k"), F.col(value).alias("a"), F.col(b).alias("b"), F.col(d).alias("d"))
    both = F.array(tri(0, "_right", "_down"), tri(1, "_left", "_up"))
    flat = around.select(*keys, F.explode(both).alias("t")).select(*keys, "t.*")
    return flat.filter("b IS NOT NULL AND d IS NOT NULL")


def _above(h: list[Column], area: float) -> tuple[Column, Column]:
    """(volume, share) of a triangle's part above zero, by the number of raised corners.

    With one raised corner the raised part is the triangle cut off at that corner; with two
    it is the whole minus the triangle cut off at the sunken one.
    """
    up = [x > 0 for x in h]
    count = sum((u.cast("int") for u in up[1:]), up[0].cast("int"))

    def tip(i: int) -> Column:
        p, q, s = h[i], h[(i + 1) % 3], h[(i + 2) % 3]
        return (p / (p - q)) * (p / (p - s))

    def chosen(flags: list[Column], make) -> Column:
        return F.when(flags[0], make(0)).when(flags[1], make(1)).otherwise(make(2))

    mean = (h[0] + h[1] + h[2]) / 3.0
    down = [~u for u in up]
    volume = (
        F.when(count == 3, F.lit(area) * mean)
        .when(count == 1, chosen(up, lambda i: F.lit(area) * tip(i) * h[i] / 3.0))
        .when(count == 2, chosen(down, lambda i: F.lit(area) * mean - F.lit(area) * tip(i) * h[i] / 3.0))
        .otherwise(F.lit(0.0))
    )
    share = (
        F.when(count == 3, F.lit(1.0))
        .when(count == 1, chosen(up, tip))
        .when(count == 2, chosen(down, lambda i: F.lit(1.0) - tip(i)))
        .otherwise(F.lit(0.0))
    )
    return volume, share


def surface_volume(cells: DataFrame, grid: Grid, plane: float = 0.0, reference: str = "ABOVE", value: str = "v", keys: Sequence[str] = (), legacy_draped: bool = False) -> DataFrame:
    """``volume, area_2d, area_3d`` on one side of the plane."""
    side = reference.upper()
    if side not in ("ABOVE", "BELOW"):
        raise ValueError(f"reference must be ABOVE or BELOW, got {reference!r}")
    both = volumes_both_sides(cells, grid, plane, value, keys, legacy_draped)
    s = side.lower()
    return both.select(
        *keys, F.col(f"volume_{s}").alias("volume"), F.col(f"area_{s}").alias("area_2d"), F.col(f"draped_{s}").alias("area_3d")
    )


def volumes_both_sides(cells: DataFrame, grid: Grid, plane: float = 0.0, value: str = "v", keys: Sequence[str] = (), legacy_draped: bool = False) -> DataFrame:
    """Volume, planimetric and draped area above and below the plane, in one pass.

    ``legacy_draped`` measures the second triangle of a quad from its upper right corner, which
    is not where its legs meet; it reproduces draped areas published that way.
    """
    dx, dy = abs(grid.dx), abs(grid.dy)
    area = 0.5 * dx * dy
    tri = triangles(cells, value, keys)
    h = [F.col(n) - F.lit(float(plane)) for n in ("a", "b", "d")]
    gx, gy = F.col("b") - F.col("a"), F.col("d") - F.col("a")
    if legacy_draped:
        second = F.col("k") == 1
        gx = F.when(second, F.col("a") - F.col("d")).otherwise(gx)
        gy = F.when(second, F.col("b") - F.col("d")).otherwise(gy)
    draped = F.lit(area) * F.sqrt(F.lit(1.0) + F.pow(gx / dx, 2.0) + F.pow(gy / dy, 2.0))
    va, fa = _above(h, area)
    vb, fb = _above([-x for x in h], area)
    parts = tri.select(*keys, va.alias("va"), fa.alias("fa"), vb.alias("vb"), fb.alias("fb"), draped.alias("dr"))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    return parts.groupBy(*keys).agg(
        total(F.col("va")).alias("volume_above"),
        total(F.col("fa") * area).alias("area_above"),
        total(F.col("fa") * F.col("dr")).alias("draped_above"),
        total(F.col("vb")).alias("volume_below"),
        total(F.col("fb") * area).alias("area_below"),
        total(F.col("fb") * F.col("dr")).alias("draped_below"),
    )


