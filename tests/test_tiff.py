"""Tiled rasters written here and read block by block."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.sources import tiff


def write(path, cells, tile=(16, 32), order="<", deflate=True, predictor=1, crs=(2048, 4326), origin=(-106.0, 40.0), step=0.001, missing=None, big=False, spoil=()):
    """A TIFF of one band; the blocks in ``spoil`` are filled with rubbish."""
    rows, cols = cells.shape
    tall, wide = tile or (7, cols)
    stored = []
    for top in range(0, rows, tall):
        for left in range(0, cols, wide):
            part = cells[top : top + tall, left : left + wide]
            if tile:
                part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part.dtype.type(0))
            data = np.ascontiguousarray(part).astype(part.dtype.newbyteorder(order)).tobytes()
            stored.append(b"rubbish" * 9 if len(stored) in spoil else zlib.compress(data) if deflate else data)
    head = 16 if big else 8
    offsets = np.cumsum([head, *map(len, stored)])[:-1].tolist()
    word, kind = ("Q", 16) if big else ("I", 4)
    tags = {256: (3, [cols]), 257: (3, [rows]), 258: (3, [cells.dtype.itemsize * 8]), 259: (3, [8 if deflate else 1]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[cells.dtype.kind]]), 33550: (12, [step, step, 0.0]), 33922: (12, [0.0, 0.0, 0.0, *origin, 0.0]), 34735: (3, [1, 1, 0, 1, crs[0], 0, 1, crs[1]])}
    tags |= {322: (3, [wide]), 323: (3, [tall]), 324: (kind, offsets), 325: (kind, list(map(len, stored)))} if tile else {273: (kind, offsets), 278: (3, [tall]), 279: (kind, list(map(len, stored)))}
    if missing is not None:
        tags[42113] = (2, str(missing).encode() + b"\0")
    at = head + sum(map(len, stored))
    entries, extra, room = b"", b"", 8 if big else 4
    behind = at + (8 if big else 2) + len(tags) * (20 if big else 12) + room
    for tag, (k, values) in sorted(tags.items()):
        data = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{tiff._KINDS[k]}", *values)
        value = data.ljust(room, b"\0") if len(data) <= room else struct.pack(f"{order}{word}", behind + len(extra))
        extra += data if len(data) > room else b""
        entries += struct.pack(f"{order}HH{word}", tag, k, len(values)) + value
    first = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at))
    path.write_bytes(first + b"".join(stored) + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries + b"\0" * room + extra)
    return str(path)


@pytest.mark.parametrize(
    "how",
    [{}, {"order": ">"}, {"deflate": False}, {"tile": None}, {"big": True}, {"kind": np.int16, "predictor": 2}, {"kind": np.uint8}, {"kind": np.float64, "order": ">", "big": True, "tile": None}],
    ids=lambda how: "-".join(f"{k}" for k in how) or "plain",
)
def test_all_cells_come_back(spark, tmp_path, how):
    how = dict(how)
    kind = how.pop("kind", np.float32)
    cells = (np.random.default_rng(1).random((50, 75)) * 200).astype(kind)
    path = write(tmp_path / "a.tif", cells, **how)
    found = np.full(cells.shape, np.nan)
    for r in tiff.cells(tiff.blocks(spark, path)).collect():
        assert np.isnan(found[r.row, r.col])
        found[r.row, r.col] = r.elev
        if (r.row, r.col) == (10, 40):
            assert (r.x, r.y) == (pytest.approx(-106 + 40.5 * 0.001), pytest.approx(40 - 10.5 * 0.001))
    assert (found == cells.astype(float)).all()


def test_missing_values_are_null(spark, tmp_path):
    cells = np.array([[1.0, -9999.0], [np.nan, 4.0]], np.float32)
    path = write(tmp_path / "a.tif", cells, missing=-9999)
    assert sorted((r.row, r.col, r.elev) for r in tiff.cells(tiff.blocks(spark, path)).collect() if r.elev is not None) == [(0, 0, 1.0), (1, 1, 4.0)]


def test_a_window_reads_only_its_blocks(spark, tmp_path):
    cells = np.arange(64 * 96, dtype=np.float32).reshape(64, 96)
    # the place is in the middle of block 4 (rows 16-31, columns 32-63); all others but its neighbour to the east are rubbish
    path = write(tmp_path / "a.tif", cells, spoil=[0, 1, 2, 3, 6, 7, 8, 9, 10, 11])
    lat, lng = 40 - 24 * 0.001, -106 + 60 * 0.001
    metres = 6.2 * 0.001 * 111320.0
    found = tiff.window(spark, path, lat, lng, metres)
    half = 6.2 / np.cos(np.radians(lat))
    want = {(r, c): float(cells[r, c]) for r in range(64) for c in range(96) if abs(r + 0.5 - 24) <= 6.2 and abs(c + 0.5 - 60) <= half}
    assert {(r.row, r.col): r.elev for r in found.collect()} == want
    near = tiff.blocks(spark, path).where((F.col("west") <= lng) & (F.col("east") >= lng) & (F.col("south") <= lat) & (F.col("north") >= lat))
    assert near.rdd.getNumPartitions() == 1 and [(r.top, r.left) for r in near.collect()] == [(16, 32)]
    with pytest.raises(Exception, match="incorrect header check"):
        tiff.blocks(spark, path).collect()


def test_windows_are_clamped_and_may_be_empty(spark, tmp_path):
    path = write(tmp_path / "a.tif", np.ones((20, 20), np.float32))
    assert tiff.window(spark, path, 40.0, -106.0, 350.0).count() == 3 * 4
    assert tiff.window(spark, path, 10.0, 10.0, 350.0).count() == 0


def test_projected_files(spark, tmp_path):
    # published position of a tower: 43 38 33.24 N, 79 23 13.7 W is 630 084 m east, 4 833 438 m north in zone 17
    east, north = tiff.utm(43 + 38 / 60 + 33.24 / 3600, -(79 + 23 / 60 + 13.7 / 3600), 17)
    assert abs(east - 630_084) < 1 and abs(north - 4_833_438) < 1
    assert tiff.utm(0.0, -81.0, 17) == (pytest.approx(500_000.0), pytest.approx(0.0)) and tiff.utm(-1e-9, 3.0, 31, True)[1] == pytest.approx(10_000_000, abs=1e-3)
    path = write(tmp_path / "a.tif", np.arange(400, dtype=np.float32).reshape(20, 20), crs=(3072, 32617), origin=(630_000.0, 4_833_500.0), step=10.0)
    found = tiff.window(spark, path, 43 + 38 / 60 + 33.24 / 3600, -(79 + 23 / 60 + 13.7 / 3600), 10.0).collect()
    assert sorted((r.row, r.col) for r in found) == [(5, 7), (5, 8), (6, 7), (6, 8)]
    with pytest.raises(ValueError, match="EPSG"):
        tiff.to_file(3857, 1.0, 1.0)


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.tif", "in/b.TIFF", "c.txt"):
        write(tmp_path / name, np.ones((4, 4), np.float32))
    assert tiff.blocks(spark, str(tmp_path)).select("file").distinct().count() == 2
