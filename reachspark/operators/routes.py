"""Least-cost distance over passable cells, with optional one-way steps.

Cells are packed once, a tile to a row. A round takes the tiles that received a lower cost at
their border, relaxes from the cells that changed, and writes what leaves these tiles: a few border
cells, never the state. Costs received in all rounds lie in tables that are merged by size,
so each is rewritten a logarithmic number of times. When nothing leaves a tile any more, one last pass fills
all tiles. Rounds equal the tile borders the longest route crosses.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from ..session import cut, spread

STEPS = [(0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, -1), (-1, 1)]
#: Tables of one size before they are merged, and active tiles that are named to the scan.
MERGE, NAMED = 4, 500
#: Cells on a side up to which neighbouring tiles are relaxed as one: every border that a route crosses costs a round of jobs.
JOINED = 128
_HERE = 1 << 8


def travel_rule(grid: Grid, u_max: float, ux="ux", uy="uy") -> Callable[[int, int], Column]:
    """Step predicate for swimmers: the current against the step may be at most ``u_max``.

    Every step has a unit vector in map coordinates (x east, y north, rows count southwards); the
    current along the step is its dot product with the flow. Missing components are still water.
    """
    span = np.array([(dc * abs(grid.dx), -dr * abs(grid.dy)) for dr, dc in STEPS])
    unit = dict(zip(STEPS, span / np.linalg.norm(span, axis=1)[:, None]))
    current = [F.coalesce(F.col(name), F.lit(0.0)) for name in (ux, uy)]
    slowest = F.lit(-float(u_max))
    return lambda dr, dc: sum(v * F.lit(float(w)) for v, w in zip(current, unit[dr, dc])) >= slowest


class _Tile:
    """The cells of one tile with a rim of nothing, and the relaxation of costs inside it."""

    def __init__(self, moves: np.ndarray, row: int, col: int, grid: Grid, steps, costs, backwards: bool):
        self.shape = moves.shape
        self.moves = moves.ravel()
        self.row, self.col, self.grid, self.steps, self.costs, self.backwards = row, col, grid, steps, costs, backwards
        self.here = (self.moves & _HERE) > 0
        self.cost = np.full(len(self.moves), np.inf)

    def place(self, r, c) -> np.ndarray:
        """Cells of a tile by grid row and column."""
        return (np.asarray(r) - self.row) * self.shape[1] + (np.asarray(c) - self.col)

    def lower(self, at: np.ndarray, cost: np.ndarray, way: np.ndarray | None = None) -> None:
        """Take costs that arrive at cells, through step ``way`` if the receiver has to allow it, and relax from there."""
        ok = self.here[at]
        if way is not None and self.backwards:
            ok &= (self.moves[at] >> way & 1) > 0
        at, cost = at[ok], cost[ok]
        before = self.cost[at]
        np.minimum.at(self.cost, at, cost)
        front = np.unique(at[self.cost[at] < before])
        while len(front):
            changed = []
            for i, ((dr, dc), length) in enumerate(zip(self.steps, self.costs, strict=True)):
                ahead = dr * self.shape[1] + dc
                target = front - ahead if self.backwards else front + ahead
                gate = target if self.backwards else front
                new = self.cost[front] + length
                ok = self.here[target] & ((self.moves[gate] >> i & 1) > 0) & (new < self.cost[target])
                self.cost[target[ok]] = new[ok]
                changed.append(target[ok])
            front = np.unique(np.concatenate(changed))

    def leaving(self, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Grid row, column, step and cost of what crosses the border from cells that are cheaper than ``before``."""
        better = np.flatnonzero(self.cost < before)
        r, c = np.divmod(better, self.shape[1])
        found = []
        for i, ((dr, dc), length) in enumerate(zip(self.steps, self.costs, strict=True)):
            sign = -1 if self.backwards else 1
            nr, nc = r + sign * dr, c + sign * dc
            out = (nr == 0) | (nr == self.shape[0] - 1) | (nc == 0) | (nc == self.shape[1] - 1)
            gr, gc = nr + self.row, nc + self.col
            out &= (gr >= 0) & (gr < self.grid.nrows) & (gc >= 0) & (gc < self.grid.ncols)
            if not self.backwards:
                out &= (self.moves[better] >> i & 1) > 0
            found.append((gr[out], gc[out], np.full(int(out.sum()), i), self.cost[better[out]] + length))
        return tuple(np.concatenate(x) for x in zip(*found))


class _Received:
    """Costs that arrived at border cells, in tables of growing size."""

    def __init__(self):
        self.levels: list[list[DataFrame]] = []

    def add(self, table: DataFrame) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(table)
            if len(self.levels[level]) < MERGE:
                return
            merged = self._union(self.levels[level])
            table = cut(merged.groupBy(*[c for c in merged.columns if c != "cost"]).agg(F.min("cost").alias("cost")))
            self.levels[level] = []
            level += 1

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    def all(self) -> DataFrame | None:
        tables = [t for level in self.levels for t in level]
        return self._union(tables) if tables else None


def least_cost_distance(
    passable: DataFrame,
    sources: DataFrame,
    grid: Grid,
    connectivity: int = 8,
    allowed: Callable[[int, int], Column] | None = None,
    towards_sources: bool = False,
    keys: Sequence[str] = (),
    tile: int = 128,
) -> DataFrame:
    """``keys, r, c, cost`` of every passable cell that has a route; source cells cost 0.

    ``allowed(dr, dc)`` gives a boolean column over ``passable``: may a step leave the cell in
    that direction? ``towards_sources`` measures the way to the sources instead of from them.
    Square blocks of smaller tiles, up to ``JOINED`` cells a side, are held by one task, and routes
    cross their inner borders there; rounds are only those between blocks.
    """
    keys = list(keys)
    tile *= max(1, JOINED // tile)
    steps = STEPS[:4] if int(connectivity) == 4 else STEPS
    costs = [math.hypot(dr * grid.dy, dc * grid.dx) for dr, dc in steps]
    bits = F.lit(_HERE)
    for i, (dr, dc) in enumerate(steps):
        may = F.lit(True) if allowed is None else F.coalesce(allowed(dr, dc), F.lit(False))
        bits = bits + F.when(may, F.lit(1 << i)).otherwise(F.lit(0))
    cells = passable.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), bits.alias("moves"))
    seeds = sources.select(*keys, "r", "c").distinct().withColumn("_seed", F.lit(True))
    cells = cells.join(seeds, [*keys, "r", "c"], "left")
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    key_ddl = "".join(f"{k} {types[k]}, " for k in keys)
    place = [*keys, "_tr", "_tc"]
    sent_ddl = f"{key_ddl}r int, c int, way int, cost double"

    def by_tile(df: DataFrame) -> DataFrame:
        return df.withColumn("_tr", F.floor(F.col("r") / tile)).withColumn("_tc", F.floor(F.col("c") / tile))

    def opened(row) -> _Tile:
        moves = np.frombuffer(zlib.decompress(row["moves"]), np.uint16).reshape(row["h"], row["w"])
        return _Tile(moves, row["row"], row["col"], grid, steps, costs, towards_sources)

    def seeded(row) -> _Tile:
        area = opened(row)
        start = np.frombuffer(zlib.decompress(row["seeds"]), np.int32).astype(np.int64)
        area.lower(start, np.zeros(len(start)))
        return area

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        row, col = int(key[-2]) * tile - 1, int(key[-1]) * tile - 1
        height, width = min(tile, grid.nrows - row - 1) + 2, min(tile, grid.ncols - col - 1) + 2
        moves = np.zeros((height, width), np.uint16)
        moves[r - row, c - col] = pdf["moves"].to_numpy(np.uint16)
        start = (r - row) * width + (c - col)
        out = {k: [v] for k, v in zip(place, key, strict=True)}
        out |= {"row": [row], "col": [col], "h": [height], "w": [width], "moves": [zlib.compress(moves.tobytes(), 1)]}
        out["seeds"] = [zlib.compress(start[pdf["_seed"].notna().to_numpy()].astype(np.int32).tobytes(), 1)]
        return pd.DataFrame(out)

    def crossing(key, area: _Tile, before: np.ndarray) -> pd.DataFrame:
        r, c, way, cost = area.leaving(before)
        out = {k: np.full(len(r), v) if not isinstance(v, str) else [v] * len(r) for k, v in zip(keys, key)}
        return pd.DataFrame(out | {"r": r, "c": c, "way": way, "cost": cost}).astype({"r": "int32", "c": "int32", "way": "int32"})

    def first(key, pdf: pd.DataFrame) -> pd.DataFrame:
        area = seeded(pdf.iloc[0])
        return crossing(key, area, np.full(len(area.cost), np.inf))

    def arrive(area: _Tile, told: pd.DataFrame) -> None:
        area.lower(area.place(told["r"], told["c"]), told["cost"].to_numpy(float), told["way"].to_numpy(np.int64))

    def again(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.Series(dtype=float) for n in [*keys, "r", "c", "way", "cost"]})
        area = seeded(left.iloc[0])
        arrive(area, right[~right["fresh"]])
        before = area.cost.copy()
        arrive(area, right[right["fresh"]])
        return crossing(key, area, before)

    def fill(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({n: pd.Series(dtype=float) for n in [*keys, "r", "c", "cost"]})
        area = seeded(left.iloc[0])
        if len(right):
            arrive(area, right)
        found = np.flatnonzero(np.isfinite(area.cost))
        r, c = np.divmod(found, area.shape[1])
        out = {k: np.full(len(r), v) if not isinstance(v, str) else [v] * len(r) for k, v in zip(keys, key)}
        return pd.DataFrame(out | {"r": r + area.row, "c": c + area.col, "cost": area.cost[found]}).astype({"r": "int32", "c": "int32"})

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, "r", "c", "way").agg(F.min("cost").alias("cost"))

    tiled = spread(by_tile(cells), *place).groupBy(*place)
    packed = cut(tiled.applyInPandas(pack, f"{key_ddl}_tr long, _tc long, row int, col int, h int, w int, moves binary, seeds binary").orderBy(*place))
    fresh = cut(least(spread(packed.filter(F.length("seeds") > len(zlib.compress(b"", 1))), *place).groupBy(*place).applyInPandas(first, sent_ddl)))
    received = _Received()
    while not fresh.isEmpty():
        now = by_tile(fresh).withColumn("fresh", F.lit(True))
        active = now.select(*place).distinct()
        tiles, known = packed.join(active, place, "left_semi"), received.all()
        named = active.select("_tr", "_tc").distinct().limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            # tiles are sorted: the scan skips what holds none of these rows and columns
            rows, columns = sorted({x["_tr"] for x in named}), sorted({x["_tc"] for x in named})
            tiles = tiles.filter(F.col("_tr").isin(rows) & F.col("_tc").isin(columns))
        if known is not None:
            old = by_tile(known).join(active, place, "left_semi").withColumn("fresh", F.lit(False))
            now = now.unionByName(old)
        both = spread(tiles, *place).groupBy(*place).cogroup(spread(now, *place).groupBy(*place))
        received.add(fresh)
        fresh = cut(least(both.applyInPandas(again, sent_ddl)))
    known = received.all()
    border = by_tile(least(known) if known is not None else fresh)
    return spread(packed, *place).groupBy(*place).cogroup(spread(border, *place).groupBy(*place)).applyInPandas(fill, f"{key_ddl}r int, c int, cost double")
