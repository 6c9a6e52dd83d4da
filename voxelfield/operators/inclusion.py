"""Spatially smoothed inclusion probabilities.

A lattice is a set of cells (voxel_id, row, col, partition_id, excluded); places
may be without a cell. Window means are taken tile by tile, each with a rim of
the cells that its squares reach. All radii share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Side of a tile: a task holds at most (TILE + 2 * largest radius) squared cells.
TILE = 256


def window_means(place: np.ndarray, delta: np.ndarray, kept: np.ndarray, radius: int) -> np.ndarray:
    """Mean delta over the kept cells in the square around each (row, col) of ``place``; NaN where there is none.

    Sums and counts come from two-dimensional prefix sums, so a place without
    a cell adds nothing to either. Cells are taken by tiles of the plane that
    hold any, each with the cells its squares reach; what lies between far
    tiles costs nothing.
    """
    out = np.full(len(place), np.nan)
    for own, near in tile_cells(place, radius):
        out[own] = _looked_up(place[own], *_box_sums(place[near], delta[near], kept[near]), radius)
    return out


def tile_cells(place: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per tile that holds cells: the cells inside, and all cells within ``radius`` of the tile."""
    side = max(TILE, 2 * radius)
    tiles, at = np.unique(place // side, axis=0, return_inverse=True)
    order = np.argsort(at.ravel(), kind="stable")
    own = np.split(order, np.cumsum(np.bincount(at.ravel(), minlength=len(tiles)))[:-1])
    if len(tiles) == 1:
        return [(own[0], own[0])]
    number = {tuple(t): i for i, t in enumerate(tiles.tolist())}
    found = []
    for i, (row, col) in enumerate(tiles.tolist()):
        around = [own[number[key]] for r in (-1, 0, 1) for c in (-1, 0, 1) if (key := (row + r, col + c)) in number]
        near = np.concatenate(around)
        low, high = tiles[i] * side - radius, (tiles[i] + 1) * side + radius
        found.append((own[i], near[((place[near] >= low) & (place[near] < high)).all(axis=1)]))
    return found


def _box_sums(place: np.ndarray, delta: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corner of the box around the cells, and prefix sums over it of delta and of the number of kept cells."""
    corner = place.min(axis=0)
    at = place - corner + 1
    shape = at.max(axis=0) + 1
    flat, size = at[:, 0] * shape[1] + at[:, 1], int(shape[0] * shape[1])
    both = [np.bincount(flat, weights=w, minlength=size).reshape(shape) for w in (np.where(kept, delta, 0.0), kept.astype(float))]
    return corner, np.stack(both).cumsum(axis=1).cumsum(axis=2)


def _looked_up(asked: np.ndarray, corner: np.ndarray, sums: np.ndarray, radius: int) -> np.ndarray:
    """Means over the squares around ``asked``: four lookups each, whatever the radius."""
    most = np.array(sums.shape[1:]) - 1
    low, left = np.clip(asked - corner - radius, 0, most).T
    high, right = np.clip(asked - corner + radius + 1, 0, most).T
    hits, count = (s[high, right] - s[low, right] - s[high, left] + s[low, left] for s in sums)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count > 0, hits / count, np.nan)


def _with_window_means(
    cells: DataFrame, radii: Sequence[int], keys: Sequence[str], masks: dict[str, Column]
) -> DataFrame:
    """Add ``<mask>_<radius>``: mean ``delta`` of a mask's cells in the square.

    The plane is cut into tiles of ``TILE`` x ``TILE`` places. A cell goes to
    its own tile and to those whose cells' squares reach it, so a task holds
    one tile and its rim, however wide, tall or full of holes the lattice is.
    """
    if not radii:
        return cells
    kinds = list(masks)
    names = [f"{mask}_{r}" for mask in kinds for r in radii]
    rows = _tiles(cells, max(radii), keys, masks)

    def means(tile: pa.Table) -> pa.Table:
        own = tile.column("__cell").is_valid()
        place = np.stack([np.asarray(tile.column("__row")), np.asarray(tile.column("__col"))], axis=1).astype(np.int64)
        delta, asked, found = np.asarray(tile.column("__delta"), dtype=float), place[np.asarray(own)], []
        for mask in kinds:
            sums = _box_sums(place, delta, np.asarray(tile.column(f"__{mask}"), dtype=bool))
            found += [pa.array(_looked_up(asked, *sums, r), pa.float64(), from_pandas=True) for r in radii]
        return pa.table([tile.column("__cell").filter(own), *found], names=["__cell", *names])

    schema = StructType([StructField("__cell", rows.schema["__cell"].dataType)] + [StructField(n, DoubleType()) for n in names])
    result = rows.groupBy(*[f"__key_{k}" for k in keys], "__tile").applyInArrow(means, schema)
    return result.select("__cell.*", *names)


def _tiles(cells: DataFrame, rim: int, keys: Sequence[str], masks: dict[str, Column]) -> DataFrame:
    """Every cell once per tile that needs it; ``__cell`` holds the row in its own tile only."""
    tiles = lambda c: F.sequence(F.floor((F.col(c) - rim) / TILE), F.floor((F.col(c) + rim) / TILE))
    pairs = F.flatten(F.transform(tiles("row"), lambda r: F.transform(tiles("col"), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    rows = cells.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys], F.col("row").cast("int").alias("__row"), F.col("col").cast("int").alias("__col"),
        F.coalesce(F.col("delta").cast("double"), F.lit(0.0)).alias("__delta"),
        *[F.coalesce(kept & F.col("delta").isNotNull(), F.lit(False)).alias(f"__{mask}") for mask, kept in masks.items()],
        F.struct(*cells.columns).alias("__cell"), F.explode(pairs).alias("__tile"),
    )
    home = (F.col("__tile.r") == F.floor(F.col("__row") / TILE)) & (F.col("__tile.c") == F.floor(F.col("__col") / TILE))
    return rows.withColumn("__cell", F.when(home, F.col("__cell")))


def _pick(radius: Column, means: dict[int, Column]) -> Column:
    """The mean that belongs to each row's radius; an unlisted radius fails."""
    unlisted = F.raise_error(F.concat(F.lit("radius not among candidates: "), radius.cast("string"))).cast("double")
    picked = F.when(radius.isNull(), F.lit(None).cast("double"))
    for r, mean in means.items():
        picked = picked.when(radius == r, mean)
    return picked.otherwise(unlisted)


def _cells(lattice: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lattice once per key; a key the lattice also has (its own mask per
    replicate, say) is matched."""
    shared = [k for k in keys if k in lattice.columns]
    return lattice.join(delta.select(*keys, "voxel_id", "delta"), [*shared, "voxel_id"])


def _with_radius(lattice: DataFrame, delta: DataFrame, radius: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _cells(lattice, delta, keys).join(radius, [*keys, "partition_id"], "left")


def window_inclusion(
    lattice: DataFrame,
    delta: DataFrame,
    radius_by_partition: DataFrame,
    radii: Sequence[int],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean of delta over the square around each cell, itself included, cut at the borders."""
    cells = _with_radius(lattice, delta, radius_by_partition, keys)
    squares = _with_window_means(cells, radii, keys, {"all": F.lit(True)})
    p = _pick(F.col("radius"), {r: F.col(f"all_{r}") for r in radii})
    return squares.select(*keys, "voxel_id", p.alias("p"))


def window_inclusion_masked(
    lattice: DataFrame,
    delta: DataFrame,
    radius_by_partition: DataFrame,
    radii: Sequence[int],
    prior_min: float = 0.0,
    prior_max: float = 1.0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """As ``window_inclusion`` without excluded cells, rescaled to the prior range.

    Radius 0 means no smoothing and gives 0.5; a square without kept cells
    gives NULL.
    """
    cells = _with_radius(lattice, delta, radius_by_partition, keys)
    squares = _with_window_means(cells, [r for r in radii if r > 0], keys, {"open": ~F.col("excluded")})
    return squares.select(*keys, "voxel_id", _masked(radii, prior_min, prior_max).alias("p"))


def _masked(radii: Sequence[int], prior_min: float, prior_max: float) -> Column:
    means = {r: F.col(f"open_{r}") for r in radii if r > 0} | {0: F.lit(0.5)}
    return _pick(F.col("radius"), means) * (prior_max - prior_min) + prior_min


def window_inclusion_candidates(
    lattice: DataFrame, delta: DataFrame, radii: Sequence[int], keys: Sequence[str] = ()
) -> DataFrame:
    """(partition_id, radius, voxel_id, p) for every candidate radius, without mask."""
    squares = _with_window_means(_cells(lattice, delta, keys), radii, keys, {"all": F.lit(True)})
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("radius"), F.col(f"all_{r}").alias("p")) for r in radii]))
    return squares.select(*keys, "partition_id", "voxel_id", pairs.alias("c")).select(
        *keys, "partition_id", "c.radius", "voxel_id", "c.p"
    )


def neighbor_inclusion(edges: DataFrame, delta: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of delta over a voxel's neighbours, itself not included; isolated voxels NULL."""
    values = delta.select(*keys, F.col("voxel_id").alias("dst"), "delta")
    shared = [k for k in keys if k in edges.columns]
    means = edges.join(values, [*shared, "dst"]).groupBy(*keys, F.col("src").alias("voxel_id")).agg(F.avg("delta").alias("p"))
    return delta.select(*keys, "voxel_id").join(means, [*keys, "voxel_id"], "left")


def clamp_inclusion(probs: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Move certain probabilities (exactly 0 or 1) to ``lo`` or ``hi``."""
    p = F.when(F.col("p") == 1, F.lit(hi)).when(F.col("p") == 0, F.lit(lo)).otherwise(F.col("p"))
    return probs.withColumn("p", p)
