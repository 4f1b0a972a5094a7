"""Grid geometry: where cell (r, c) lies. Row 0 is the top row, y falls with r."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """One regular grid; the counterpart of a row of the ``grids`` table."""

    nrows: int
    ncols: int
    dx: float = 1.0
    dy: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    crs: str | None = None

    @property
    def cell_area(self) -> float:
        return abs(self.dx) * abs(self.dy)

    def x(self, c) -> Column:
        """Cell-centre x."""
        return F.lit(self.x0) + (_col(c) + 0.5) * F.lit(self.dx)

    def y(self, r) -> Column:
        """Cell-centre y."""
        return F.lit(self.y0) - (_col(r) + 0.5) * F.lit(self.dy)

    def row_of(self, y) -> Column:
        """Row holding coordinate ``y``."""
        return F.floor((F.lit(self.y0) - _col(y)) / F.lit(self.dy)).cast("int")

    def col_of(self, x) -> Column:
        """Column holding coordinate ``x``."""
        return F.floor((_col(x) - F.lit(self.x0)) / F.lit(self.dx)).cast("int")

    def contains(self, r, c) -> Column:
        """Does (r, c) lie on the grid?"""
        r, c = _col(r), _col(c)
        return (r >= 0) & (r < self.nrows) & (c >= 0) & (c < self.ncols)

    def same_as(self, other: Grid) -> bool:
        """Equal shape and geometry (the CRS is not compared)."""
        mine = (self.nrows, self.ncols, self.dx, self.dy, self.x0, self.y0)
        return mine == (other.nrows, other.ncols, other.dx, other.dy, other.x0, other.y0)


def _col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def load_grid(grids: DataFrame, **selector) -> Grid:
    """One grid out of a ``grids`` table, chosen by column equality."""
    for name, value in selector.items():
        grids = grids.filter(F.col(name) == F.lit(value))
    rows = grids.select("nrows", "ncols", "dx", "dy", "x0", "y0", "crs").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} grids match {selector}, expected exactly one")
    return Grid(**rows[0].asDict())


def cell_size(grids: DataFrame) -> DataFrame:
    """Absolute cell size of every grid."""
    return grids.withColumn("dx", F.abs("dx")).withColumn("dy", F.abs("dy"))
