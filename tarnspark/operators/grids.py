"""Focal operators on rasters of any size: blocks of cells as arrays, with a halo from the blocks around.

A raster (tile_id) is cut into square blocks: one exchange of cells by block. For an operator that looks ``halo`` cells far each block
then sends its neighbours the strip of its border that they need: one exchange of arrays, in which a cell of the border travels up to
four times and all others once. A task has blocks with their halos as arrays and works on whole arrays, on many small blocks at once.
Results are those of the operators in ``raster`` over the whole raster, to the last cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import CELL, DIRECTIONS, _kernel

#: Cells of a block's side; cells, with halos, that are worked on at once.
SIDE, AT_ONCE = 128, 1 << 18
BLOCK, EDGES = ["tile_id", "br", "bc"], ["first_row", "last_row", "first_col", "last_col"]


def _parts(rows: pd.DataFrame, side: int, halo: int) -> pd.DataFrame:
    """The parts of each block that it and its neighbours within the raster's bounds need."""
    out = []
    first, last = ([rows[f"{n}_{c}"].to_numpy() // side for c in ("row", "col")] for n in ("first", "last"))
    for i, (tile, br, bc, data, there) in enumerate(zip(rows["tile_id"], rows["br"].tolist(), rows["bc"].tolist(), rows["elev"], rows["there"], strict=True)):
        cells = np.frombuffer(data).reshape(side, side)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                if not (first[0][i] <= br + dr <= last[0][i] and first[1][i] <= bc + dc <= last[1][i]):
                    continue
                # of a neighbour above, the first rows are in its halo; of one below, the last
                r = slice(0, side) if dr == 0 else slice(0, halo) if dr < 0 else slice(side - halo, side)
                c = slice(0, side) if dc == 0 else slice(0, halo) if dc < 0 else slice(side - halo, side)
                if halo or dr == dc == 0:
                    part = cells[r, c]
                    out.append((tile, br + dr, bc + dc, r.start - dr * side + halo, c.start - dc * side + halo, *part.shape, part.tobytes(), there if dr == dc == 0 else None, i))
    names = ["tile_id", "br", "bc", "at_row", "at_col", "height", "width", "elev", "there", "_i"]
    made = pd.DataFrame(out, columns=names)
    edges = rows[EDGES].iloc[made.pop("_i").to_numpy(int)].reset_index(drop=True)
    return pd.concat([made, edges], axis=1)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``keys`` as batches that end where a key does, with ``_run``, the number of a row's key there."""
    left = None
    for batch in chain(batches, [None]):
        rows = left if batch is None else batch if left is None else pd.concat([left, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        new = np.zeros(len(rows), bool)
        for key in keys:
            x = rows[key].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        run = np.cumsum(new)
        whole = len(rows) if batch is None else int(np.searchsorted(run, run[-1]))
        left = None if batch is None else rows.iloc[whole:].reset_index(drop=True)
        if whole:
            yield rows.iloc[:whole].assign(_run=run[:whole])


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def blocks(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """tile_id, br, bc, elev, there: cells (tile_id, row, col, elev) as arrays of side x side doubles, missing and null ones not a number."""
    kind = cells.schema["tile_id"].dataType.simpleString()

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _runs(batches, BLOCK):
            run, first = batch["_run"].to_numpy(), ~batch["_run"].duplicated().to_numpy()
            few = max(1, AT_ONCE // (side * side))
            for low in range(0, run[-1] + 1, few):
                some = slice(*np.searchsorted(run, [low, low + few]))
                at = run[some] - low, batch["row"].to_numpy()[some] % side, batch["col"].to_numpy()[some] % side
                elev, there = np.full((at[0][-1] + 1, side, side), np.nan), np.zeros((at[0][-1] + 1, side, side), bool)
                elev[at], there[at] = batch["elev"].to_numpy(float)[some], True
                yield batch[some][first[some]][BLOCK].assign(elev=[x.tobytes() for x in elev], there=[x.tobytes() for x in there])

    at = [F.floor(F.col(c) / side).cast("int").alias(f"b{c[0]}") for c in ("row", "col")]
    rows = cells.where(F.col("tile_id").isNotNull()).select("tile_id", *at, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("elev").cast("double").alias("elev"))
    return _dealt(rows, BLOCK).mapInPandas(gather, f"tile_id {kind}, br int, bc int, elev binary, there binary")


def focal(cells: DataFrame, halo: int, work: Callable[[np.ndarray, dict], dict[str, np.ndarray]], columns: list[str], side: int | None = None) -> DataFrame:
    """tile_id, row, col, elev and ``columns`` (doubles, not a number is null) of every cell.

    ``work`` gets blocks with their halos, one behind the other and not a number where there is no cell, and the rasters' bounds in the
    arrays' rows and columns, a pair for each block; it returns the columns' arrays for the blocks alone. Blocks come by the batch, as
    many at once as have AT_ONCE cells, so a small one costs little more than its cells.
    """
    side = side or max(SIDE, halo)
    if halo > side:
        raise ValueError(f"a halo of {halo} is wider than a block of {side}")
    kind, wide = cells.schema["tile_id"].dataType.simpleString(), side + 2 * halo
    bounds = cells.groupBy("tile_id").agg(*[f(c).cast("int").alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("first", F.min), ("last", F.max))])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        few = max(1, AT_ONCE // (side * side))
        for batch in batches:
            for low in range(0, len(batch), few):
                yield _parts(batch.iloc[low : low + few].reset_index(drop=True), side, halo)

    def compute(parts: pd.DataFrame, n: int) -> pd.DataFrame:
        area, at = np.full((n, wide, wide), np.nan), parts["_run"].to_numpy()
        for (r, c, h, w), group in parts.groupby(["at_row", "at_col", "height", "width"]):
            area[at[group.index], r : r + h, c : c + w] = np.frombuffer(b"".join(group["elev"])).reshape(-1, h, w)
        b = parts[parts["there"].notna()]
        if not len(b):
            return pd.DataFrame(columns=["tile_id", "row", "col", "elev", *columns], dtype=object)
        own, top, left = b["_run"].to_numpy(), b["br"].to_numpy() * side, b["bc"].to_numpy() * side
        area = area[own]  # others have no such block
        edges = {f"{c}s": np.stack([b[f"{e}_{c}"].to_numpy() - start + halo for e in ("first", "last")], axis=1) for c, start in (("row", top), ("col", left))}
        made = work(area, edges)
        i, r, c = np.nonzero(np.frombuffer(b"".join(b["there"]), np.bool_).reshape(-1, side, side))
        out = {"tile_id": b["tile_id"].to_numpy()[i], "row": r + top[i], "col": c + left[i], "elev": area[i, halo + r, halo + c]}
        return pd.DataFrame(out | {name: made[name][i, r, c] for name in columns})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _runs(batches, BLOCK):
            at, few = batch["_run"].to_numpy(), max(1, AT_ONCE // (wide * wide))
            for low in range(0, at[-1] + 1, few):
                some = slice(*np.searchsorted(at, [low, low + few]))
                parts = batch[some].reset_index(drop=True)
                yield compute(parts.assign(_run=parts["_run"] - low), min(few, at[-1] + 1 - low))

    edge = ", ".join(f"{name} int" for name in EDGES)
    parts = "at_row int, at_col int, height int, width int, elev binary, there binary"
    sent = blocks(cells, side).join(bounds, "tile_id").mapInPandas(send, f"tile_id {kind}, br int, bc int, {parts}, {edge}")
    found = _dealt(sent, BLOCK).mapInPandas(run, f"tile_id {kind}, row int, col int, {', '.join(f'{c} double' for c in ['elev', *columns])}")
    return found.select(*CELL, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ["elev", *columns]])


def _moved(area: np.ndarray, halo: int, dr: int, dc: int) -> np.ndarray:
    """For each cell of the blocks, the one (dr, dc) away."""
    n, m = area.shape[-2:]
    return area[..., halo + dr : n - halo + dr, halo + dc : m - halo + dc]


def _peak(area: np.ndarray, edges: dict, k: int) -> dict[str, np.ndarray]:
    # first along rows, then along columns; a greatest value needs no numbers where there are none
    area = np.where(np.isnan(area), -np.inf, area)
    n, m = area.shape[-2:]
    rows = np.max([area[:, k + d : n - k + d] for d in range(-k, k + 1)], axis=0)
    peak = np.max([rows[..., k + d : m - k + d] for d in range(-k, k + 1)], axis=0)
    return {"peak": np.where(np.isneginf(peak), np.nan, peak)}


def focal_max(cells: DataFrame, size: int = 5, side: int | None = None) -> DataFrame:
    """tile_id, row, col, elev, peak, is_max, as ``raster.focal_max``."""
    k = size // 2
    return focal(cells, k, partial(_peak, k=k), ["peak"], side).withColumn("is_max", F.col("elev") == F.col("peak"))


def _curvature(area: np.ndarray, edges: dict, cell_m: float) -> dict[str, np.ndarray]:
    around = sum(_moved(area, 1, dr, dc) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    return {"curvature": -(around - 4 * _moved(area, 1, 0, 0)) / (cell_m * cell_m)}


def laplacian(cells: DataFrame, cell_m: float = 1.0, side: int | None = None) -> DataFrame:
    """tile_id, row, col, elev, curvature of inner cells, as ``raster.laplacian``."""
    return focal(cells, 1, partial(_curvature, cell_m=cell_m), ["curvature"], side).where(F.col("curvature").isNotNull())


def _dominance(area: np.ndarray, edges: dict, halo: int, steps: int, radius: int) -> dict[str, np.ndarray]:
    own = _moved(area, halo, 0, 0)

    def share(moves) -> np.ndarray:
        lower, known = np.zeros(own.shape, np.int32), np.zeros(own.shape, np.int32)
        for dr, dc in moves:
            other = _moved(area, halo, dr, dc)
            lower += other < own
            known += ~np.isnan(other)
        with np.errstate(all="ignore"):
            return np.where(np.isnan(own), np.nan, np.where(known > 0, lower / known, 0.5))

    square = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r or c]
    return {"radial": share([(r * steps, c * steps) for r, c in DIRECTIONS]), "neighbourhood": share(square)}


def dominance(cells: DataFrame, steps: int = 10, radius: int = 15, side: int | None = None) -> DataFrame:
    """tile_id, row, col, radial, neighbourhood, confidence of cells with a value, as ``raster.dominance``."""
    halo = max(steps, radius)
    found = focal(cells, halo, partial(_dominance, halo=halo, steps=steps, radius=radius), ["radial", "neighbourhood"], side).where(F.col("elev").isNotNull())
    return found.select(*CELL, "radial", "neighbourhood", F.bround(0.6 * F.col("radial") + 0.4 * F.col("neighbourhood"), 3).alias("confidence"))


def _reflected(n: int, low: int, high: int, r: int) -> np.ndarray:
    """For each place of a padded line, the places its r neighbours to either side are taken from: lines reflect at the raster's bounds."""
    at = np.arange(r, n - r)[:, None] + np.arange(-r, r + 1) - low
    length = high - low + 1
    at = at % (2 * length)
    return low + np.where(at < length, at, 2 * length - 1 - at)


def _smoothed(area: np.ndarray, edges: dict, weights: list[float]) -> dict[str, np.ndarray]:
    """Bounds differ from block to block, so each is smoothed by itself."""
    made = [_smoothed_block(a, rows, cols, weights) for a, rows, cols in zip(area, edges["rows"], edges["cols"], strict=True)]
    return {"smooth": np.array(made).reshape(_moved(area, len(weights) // 2, 0, 0).shape)}


def _smoothed_block(area: np.ndarray, rows: np.ndarray, cols: np.ndarray, weights: list[float]) -> np.ndarray:
    r, w = len(weights) // 2, np.array(weights)
    own = _moved(area, r, 0, 0)
    values, known = np.where(np.isnan(area), 0.0, area), (~np.isnan(area)).astype(float)

    def along(x: np.ndarray, axis: int, low: int, high: int) -> np.ndarray:
        places = _reflected(x.shape[axis], low, high, r)
        # beyond the bounds there are no cells to smooth, but their places must stay in the array
        places = np.clip(places, 0, x.shape[axis] - 1)
        return sum(weight * np.take(x, places[:, k], axis=axis) for k, weight in enumerate(w))

    v, n = (along(along(x, 0, *rows), 1, *cols) for x in (values, known))
    return np.where(np.isnan(own), np.nan, v / np.maximum(n, 1e-10))


def smooth(cells: DataFrame, sigma: float = 1.0, side: int | None = None) -> DataFrame:
    """tile_id, row, col, elev smoothed, as ``raster.smooth``. Rasters are no narrower than the kernel's reach, or lie in one block."""
    weights = _kernel(sigma)
    found = focal(cells, len(weights) // 2, partial(_smoothed, weights=weights), ["smooth"], side)
    return found.select(*CELL, F.col("smooth").alias("elev"))
