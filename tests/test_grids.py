"""Rasters in blocks with halos give what whole ones give, to the last cell."""

import random

import pytest
from pyspark.sql import functions as F

from tarnspark.operators import grids, raster


@pytest.fixture(scope="module")
def cells(spark):
    rng, rows = random.Random(2), []
    for tile, (r0, c0, height, width) in {"a": (0, 0, 23, 31), "b": (-9, 5, 17, 12), "c": (100, 100, 1, 9), "d": (3, 3, 1, 1)}.items():
        rows += [(tile, r0 + r, c0 + c, None if rng.random() < 0.04 else float(rng.randint(0, 60))) for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, "tile_id string, row int, col int, elev double").persist()


def rows(df, *columns):
    return sorted((r.tile_id, r.row, r.col, *[None if r[c] is None else round(r[c], 9) for c in columns]) for r in df.collect())


@pytest.mark.parametrize("side", [5, 8, 128])
def test_focal_max(cells, side):
    assert rows(grids.focal_max(cells, 5, side), "elev", "peak", "is_max") == rows(raster.focal_max(cells, 5), "elev", "peak", "is_max")


@pytest.mark.parametrize("side", [5, 128])
def test_laplacian(cells, side):
    assert rows(grids.laplacian(cells, 2.0, side), "curvature") == rows(raster.laplacian(cells, 2.0), "curvature")


@pytest.mark.parametrize(("steps", "radius", "side"), [(2, 3, 5), (4, 2, 4), (10, 15, 16)])
def test_dominance(cells, steps, radius, side):
    columns = ("radial", "neighbourhood", "confidence")
    assert rows(grids.dominance(cells, steps, radius, side), *columns) == rows(raster.dominance(cells, steps, radius), *columns)


@pytest.mark.parametrize(("sigma", "side"), [(1.0, 6), (0.5, 5), (1.0, 128)])
def test_smooth(cells, sigma, side):
    wide = cells.where(F.col("tile_id").isin("a", "b") | F.lit(side == 128))
    assert rows(grids.smooth(wide, sigma, side), "elev") == rows(raster.smooth(wide, sigma), "elev")


def test_bounds(cells):
    with pytest.raises(ValueError, match="halo"):
        grids.dominance(cells, 10, 15, 8)
    assert grids.focal_max(cells.limit(0)).collect() == []


def test_missing_blocks_and_many_small_ones(spark, monkeypatch):
    """Blocks that have no cells, batches that end within a block, and a worker that gets no group of its own for each block."""
    monkeypatch.setattr(grids, "AT_ONCE", 300, raising=False)
    rng = random.Random(5)
    made = [(None if tile == 7 else tile + (1 << 53), r, c, float(rng.randint(0, 40))) for tile in range(40) for r in range(-3, 13) for c in range(13) if not (tile % 3 and 0 <= r < 5 and 5 <= c < 10)]
    cells = spark.createDataFrame(made, "tile_id long, row int, col int, elev double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = grids.dominance(cells, 2, 3, 5)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found, "radial", "neighbourhood", "confidence") == rows(raster.dominance(cells.where("tile_id IS NOT NULL"), 2, 3), "radial", "neighbourhood", "confidence")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
