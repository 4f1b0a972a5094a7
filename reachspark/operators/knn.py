"""k nearest source cells, inverse-distance weighting and ordinary kriging.

Targets and sources lie in pyramids of tiles. Pairs of a target tile and a source tile descend from
the top: at each level the source tiles' counts, in order of their largest distance, give a
distance within which every target of the tile has its k sources, and source tiles that begin
beyond it are dropped. What is left at the lowest level holds every neighbour, near or far. A target tile
with many such sources meets them in chunks of bounded size whose best k are combined. The result is exact, and
the weights are computed in the task that found the neighbours, so no pair list is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..session import cut, spread

#: Distances computed at once, and sources that meet a target tile at once.
CHUNK, SOURCES = 2_000_000, 20_000


def tile_pairs(targets: DataFrame, sources: DataFrame, grid: Grid, k: int, keys: Sequence[str], tile: int) -> DataFrame:
    """``keys, tr, tc, sr, sc, n, far``: the source tiles that may hold one of the k sources nearest to a target of a tile.

    ``n`` counts a source tile's sources, ``far`` is the largest distance between cells of the two.
    """
    keys = list(keys)
    dx, dy = abs(grid.dx), abs(grid.dy)
    height = max(0, (-(-max(grid.nrows, grid.ncols) // tile) - 1).bit_length())
    place = lambda name: F.floor(F.col(name) / tile).cast("int")
    # written once: with their true sizes known, small pyramids are broadcast and only large ones shuffle the pairs
    wanted = [cut(targets.select(*keys, place("r").alias("tr"), place("c").alias("tc")).distinct())]
    held = [cut(sources.groupBy(*keys, place("r").alias("sr"), place("c").alias("sc")).agg(F.count("*").alias("n")))]
    up = lambda name: F.shiftright(F.col(name), 1).alias(name)
    for _ in range(height):
        wanted.append(wanted[-1].select(*keys, up("tr"), up("tc")).distinct())
        held.append(held[-1].groupBy(*keys, up("sr"), up("sc")).agg(F.sum("n").alias("n")))

    def gap_and_reach(t: str, s: str, size: int, cells: int, step: float) -> tuple[Column, Column]:
        t0, s0 = F.col(t) * size, F.col(s) * size
        t1, s1 = F.least(t0 + size, F.lit(cells)) - 1, F.least(s0 + size, F.lit(cells)) - 1
        return F.greatest(F.lit(0), s0 - t1, t0 - s1) * F.lit(step), F.greatest(s1 - t0, t1 - s0) * F.lit(step)

    pairs = wanted[height].join(held[height], keys) if keys else wanted[height].join(held[height], (F.col("tr") == F.col("sr")) & (F.col("tc") == F.col("sc")))
    for level in range(height - 1, -2, -1):
        at = max(level, 0)
        if level >= 0:
            below = wanted[level].withColumns({"_tr": F.shiftright("tr", 1), "_tc": F.shiftright("tc", 1)})
            pairs = pairs.withColumnsRenamed({"tr": "_tr", "tc": "_tc"}).join(below, [*keys, "_tr", "_tc"]).drop("_tr", "_tc", "n", "far")
            below = held[level].withColumns({"_sr": F.shiftright("sr", 1), "_sc": F.shiftright("sc", 1)})
            pairs = pairs.withColumnsRenamed({"sr": "_sr", "sc": "_sc"}).join(below, [*keys, "_sr", "_sc"]).drop("_sr", "_sc")
        elif height:
            break
        size = tile << at
        (gap_r, far_r), (gap_c, far_c) = gap_and_reach("tr", "sr", size, grid.nrows, dy), gap_and_reach("tc", "sc", size, grid.ncols, dx)
        pairs = pairs.withColumns({"near": F.hypot(gap_r, gap_c), "far": F.hypot(far_r, far_c)})
        of_target = Window.partitionBy(*keys, "tr", "tc")
        pairs = pairs.withColumn("_upto", F.sum("n").over(of_target.orderBy("far", "sr", "sc")))
        pairs = pairs.withColumn("_enough", F.min(F.when(F.col("_upto") >= k, F.col("far"))).over(of_target))
        pairs = pairs.filter(F.col("_enough").isNull() | (F.col("near") <= F.col("_enough"))).drop("near", "_upto", "_enough")
    return pairs


def _search(targets, sources, grid, k, keys, tile, columns, finish, value, skip_self=False):
    """Run ``finish(target rows, d, v, src_r, src_c)`` on complete neighbour lists."""
    keys = list(keys)
    dx, dy = abs(grid.dx), abs(grid.dy)
    want = targets.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    have = sources.select(
        *keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(value).cast("double").alias("v")
    )
    types = {f.name: f.dataType.simpleString() for f in want.schema.fields}
    base_ddl = ", ".join(f"{n} {t}" for n, t in types.items())
    lists = "array<double>", "array<double>", "array<int>", "array<int>"
    partial_ddl = f"{base_ddl}, _tr int, _tc int, " + ", ".join(f"{n} {t}" for n, t in zip(("d", "v", "sr", "sc"), lists, strict=True))
    names = [*types, *[c.split()[0] for c in columns]]

    def best(r, c, sr, sc, sv):
        """The k nearest of some sources: distances, values and places, one line a target."""
        d2 = ((r[:, None] - sr) * dy) ** 2 + ((c[:, None] - sc) * dx) ** 2
        if skip_self:
            d2 = np.where((r[:, None] == sr) & (c[:, None] == sc), np.inf, d2)
        kk = min(k, d2.shape[1])
        # Keep everything up to the k-th distance, ties included; sources are sorted by
        # (r, c), so a stable sort of ascending indices settles the ties.
        kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1 : kk]
        most = int((d2 <= kth).sum(axis=1).max())
        pick = np.sort(np.argpartition(d2, most - 1, axis=1)[:, :most], axis=1)
        by = np.argsort(np.take_along_axis(d2, pick, axis=1), axis=1, kind="stable")[:, :kk]
        pick = np.take_along_axis(pick, by, axis=1)
        return np.sqrt(np.take_along_axis(d2, pick, axis=1)), sv[pick], sr[pick], sc[pick]

    def each(left, right):
        """Blocks of targets with their best lists."""
        right = right.sort_values(["r", "c"])
        sr, sc, sv = right["r"].to_numpy(np.int64), right["c"].to_numpy(np.int64), right["v"].to_numpy()
        step = max(1, CHUNK // max(len(sr), 1))
        for a in range(0, len(left) if len(sr) else 0, step):
            rows = left.iloc[a : a + step]
            yield rows[list(types)], best(rows["r"].to_numpy(np.int64), rows["c"].to_numpy(np.int64), sr, sc, sv)

    def whole(left, right):
        out = [finish(rows, *found) for rows, found in each(left, right)]
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame(columns=names)

    def part(key, left, right):
        out = []
        for rows, found in each(left, right):
            rows = rows.assign(_tr=int(key[-3]), _tc=int(key[-2]))
            out.append(rows.assign(**{n: list(a) for n, a in zip(("d", "v", "sr", "sc"), found, strict=True)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[*types, "_tr", "_tc", "d", "v", "sr", "sc"])

    def merge(pdf):
        out = []
        for (_, _), group in pdf.groupby(["r", "c"], sort=False):
            d, v, sr, sc = (np.concatenate(group[n].to_list()) for n in ("d", "v", "sr", "sc"))
            pick = np.lexsort((sc, sr, d))[:k]
            out.append(finish(group[list(types)].iloc[:1], d[None, pick], v[None, pick], sr[None, pick].astype(np.int64), sc[None, pick].astype(np.int64)))
        return pd.concat(out, ignore_index=True)[names]

    pairs = tile_pairs(want, have, grid, k + bool(skip_self), keys, tile)
    of_target = Window.partitionBy(*keys, "tr", "tc")
    chunk = F.floor((F.sum("n").over(of_target.orderBy("far", "sr", "sc")) - F.col("n")) / SOURCES)
    pairs = pairs.withColumn("_chunk", chunk).withColumn("_chunks", F.max("_chunk").over(of_target) + 1)
    pairs = cut(pairs.select(*keys, F.col("tr").alias("_tr"), F.col("tc").alias("_tc"), "sr", "sc", "_chunk", "_chunks"))
    floor = lambda name: F.floor(F.col(name) / tile).cast("int")
    near = have.withColumns({"sr": floor("r"), "sc": floor("c")}).join(pairs, [*keys, "sr", "sc"]).drop("sr", "sc")
    tiled = want.withColumns({"_tr": floor("r"), "_tc": floor("c")})
    place = [*keys, "_tr", "_tc"]
    single = spread(near.filter("_chunks = 1").drop("_chunk", "_chunks"), *place).groupBy(*place)
    out_ddl = f"{base_ddl}, " + ", ".join(columns)
    found = spread(tiled, *place).groupBy(*place).cogroup(single).applyInPandas(whole, out_ddl)
    # target tiles with more sources than one task should see
    crowded = pairs.filter("_chunks > 1")
    if crowded.isEmpty():
        return found
    split = tiled.join(crowded.selectExpr(*place, "_chunk + 0 AS _chunk").distinct(), place)
    by = [*place, "_chunk"]
    parts = spread(split, *by).groupBy(*by).cogroup(spread(near.filter("_chunks > 1").drop("_chunks"), *by).groupBy(*by)).applyInPandas(part, partial_ddl)
    return found.unionByName(spread(parts, *place).groupBy(*place).applyInPandas(merge, out_ddl))


def nearest_k(targets: DataFrame, sources: DataFrame, grid: Grid, k: int = 12, value: str = "v", keys: Sequence[str] = (), tile: int = 16, skip_self: bool = False) -> DataFrame:
    """Long neighbour lists ``r, c, rank, d, v, src_r, src_c``; ties by (src_r, src_c)."""

    def finish(base, d, v, sr, sc):
        n, kk = d.shape
        rep = base.loc[base.index.repeat(kk)]
        flat = rep.assign(rank=np.tile(np.arange(1, kk + 1), n), d=d.ravel(), v=v.ravel(), src_r=sr.ravel(), src_c=sc.ravel())
        return flat

    cols = ["rank int", "d double", "v double", "src_r int", "src_c int"]
    out = _search(targets, sources, grid, k, keys, tile, cols, finish, value, skip_self)
    return out.filter("d < double('infinity')")


def idw(targets: DataFrame, sources: DataFrame, grid: Grid, k: int = 12, power: float = 2.0, value: str = "v", keys: Sequence[str] = (), tile: int = 16) -> DataFrame:
    """Inverse-distance weighted value of the k nearest sources at every target cell."""

    def finish(base, d, v, sr, sc):
        w = 1.0 / np.maximum(d, 1e-12) ** float(power)
        return base.assign(v=(w * v).sum(axis=1) / w.sum(axis=1))

    out = _search(targets, sources, grid, k, keys, tile, ["v double"], finish, value)
    return out.filter("NOT isnan(v)")


VARIOGRAMS: dict[str, Callable] = {
    "spherical": lambda h, p, s, n: np.where(h <= s, p * (1.5 * h / s - 0.5 * (h / s) ** 3) + n, p + n),
    "exponential": lambda h, p, s, n: p * (1.0 - np.exp(-h / (s / 3.0))) + n,
    "gaussian": lambda h, p, s, n: p * (1.0 - np.exp(-(h**2) / (s * 4.0 / 7.0) ** 2)) + n,
    "linear": lambda h, p, s, n: p * h + n,
    "power": lambda h, p, s, n: p * h**s + n,
}


def variogram_bins(
    sources: DataFrame, grid: Grid, nlags: int = 12, sample: int = 2000, seed: int = 0, max_lag: float | None = None, value: str = "v"
) -> DataFrame:
    """``lag, d, gamma, pairs``: mean half squared difference of pairs of sources, in equal lags up to ``max_lag``.

    All pairs of at most ``sample`` sources are taken, chosen by a seeded hash of their cells, so that
    lags of every length are covered; without ``max_lag`` the longest pair ends the last lag.
    """
    place = F.xxhash64(F.lit(seed), F.col("r").cast("long"), F.col("c").cast("long"))
    few = sources.filter(F.col(value).isNotNull()).select("r", "c", F.col(value).cast("double").alias("v")).orderBy(place, "r", "c").limit(sample)
    points = np.array([tuple(row) for row in few.collect()], dtype=float).reshape(-1, 3)
    if len(points) < 2:
        raise ValueError("a variogram needs at least two source cells")
    y, x, v = points[:, 0] * abs(grid.dy), points[:, 1] * abs(grid.dx), points[:, 2]
    if max_lag is None:
        max_lag = max(float(np.hypot(y - y[i], x - x[i]).max()) for i in range(len(v)))

    def pair_sums(batches):
        for pdf in batches:
            total = np.zeros((nlags, 3))
            for i in pdf["id"]:
                d, g = np.hypot(y[i + 1 :] - y[i], x[i + 1 :] - x[i]), (v[i + 1 :] - v[i]) ** 2 / 2.0
                near = d <= max_lag
                lag = np.minimum((d[near] * nlags / max_lag).astype(int), nlags - 1)
                total += np.stack([np.bincount(lag, w, nlags) for w in (d[near], g[near], np.ones(near.sum()))], axis=1)
            yield pd.DataFrame({"lag": np.arange(nlags), "d": total[:, 0], "g": total[:, 1], "pairs": total[:, 2].astype(np.int64)})

    sums = sources.sparkSession.range(len(v)).mapInPandas(pair_sums, "lag long, d double, g double, pairs long")
    sums = sums.groupBy("lag").agg(F.sum("d").alias("d"), F.sum("g").alias("g"), F.sum("pairs").alias("pairs")).filter("pairs > 0")
    return sums.select("lag", (F.col("d") / F.col("pairs")).alias("d"), (F.col("g") / F.col("pairs")).alias("gamma"), "pairs")


def fit_variogram(bins: DataFrame, model: str = "spherical") -> tuple[float, float, float]:
    """(partial sill or slope, range or exponent, nugget) by least squares on the bins."""
    rows = bins.orderBy("lag").select("d", "gamma", "pairs").collect()
    h, g, n = (np.array([row[i] for row in rows], dtype=float) for i in range(3))
    shape = VARIOGRAMS[model]
    spans = np.linspace(0.1, 1.9, 37) if model == "power" else np.linspace(h.max() / 40, h.max() * 2, 80)
    best, answer = np.inf, (float(g.max()), float(h.max()), 0.0)
    for span in spans:
        basis = np.column_stack([shape(h, 1.0, span, 0.0), np.ones_like(h)]) * np.sqrt(n)[:, None]
        coef, *_ = np.linalg.lstsq(basis, g * np.sqrt(n), rcond=None)
        p, nug = max(coef[0], 1e-12), max(coef[1], 0.0)
        miss = (n * (shape(h, p, span, nug) - g) ** 2).sum()
        if miss < best:
            best, answer = miss, (float(p), float(span), float(nug))
    return answer


def kriging(
    targets: DataFrame,
    sources: DataFrame,
    grid: Grid,
    model: str = "spherical",
    nlags: int = 12,
    n_closest: int = 12,
    parameters: tuple[float, float, float] | None = None,
    value: str = "v",
    tile: int = 16,
) -> DataFrame:
    """Ordinary kriging ``r, c, v, variance`` from the closest sources.

    ``parameters`` are (partial sill, range, nugget); without them they are fitted to :func:`variogram_bins`.
    """
    if model not in VARIOGRAMS:
        raise ValueError(f"unknown variogram model {model!r}")
    if parameters is None:
        parameters = fit_variogram(variogram_bins(sources, grid, nlags, value=value), model)
    p, s, nug = parameters
    dx, dy = abs(grid.dx), abs(grid.dy)

    def gamma(h):
        return np.where(h == 0, 0.0, VARIOGRAMS[model](h, p, s, nug))

    def finish(base, d, v, sr, sc):
        n, k = d.shape
        between = np.sqrt(((sr[:, :, None] - sr[:, None, :]) * dy) ** 2 + ((sc[:, :, None] - sc[:, None, :]) * dx) ** 2)
        system = np.ones((n, k + 1, k + 1))
        system[:, :k, :k] = gamma(between)
        system[:, k, k] = 0.0
        right = np.ones((n, k + 1))
        right[:, :k] = gamma(d)
        weights = np.linalg.solve(system, right[:, :, None])[:, :, 0]
        return base.assign(v=(weights[:, :k] * v).sum(axis=1), variance=(weights * right).sum(axis=1))

    out = _search(targets, sources, grid, n_closest, (), tile, ["v double", "variance double"], finish, value)
    return out.filter("NOT isnan(v)")
