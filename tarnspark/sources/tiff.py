"""Tiled rasters (TIFF, BigTIFF) as a Spark data source: ``spark.read.format("tiff").load(file or folder)``.

A row is a block of a file: its place in rows and columns, its box in the file's own coordinates, and its cells. Only headers are
read to plan a scan; one partition is one block, read at its own offset. Comparisons of west, east, south, north, top and
left with numbers are pushed into the scan (``spark.sql.python.filterPushdown.enabled``), so a window touches only its blocks.
Cells are deflated or plain, whole numbers or floats, with or without the horizontal predictor; the file's missing value is null.
Paths are anything that ``pyarrow.fs`` opens: local or mounted folders, HDFS and object stores.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.geo import LNG_DEGREE_M

SCHEMA = "file string, crs int, top int, left int, height int, width int, west double, south double, east double, north double, step_x double, step_y double, cells array<double>"

#: Tags and codes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
NONE, DEFLATE, DEFLATE_OLD = 1, 8, 32946
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_SAMPLES = {1: "u", 2: "i", 3: "f"}


def _open(path: str):
    files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, name


def header(f) -> dict[int, tuple]:
    """The tags of a file's first image; ``order`` is its byte order."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read_at(8 if big else 2, at))[0]
    size, begin, room = (20, at + 8, 8) if big else (12, at + 2, 4)
    raw, tags = f.read_at(n * size, begin), {"order": (order,)}
    for k in range(n):
        tag, kind = struct.unpack_from(f"{order}HH", raw, k * size)
        count = struct.unpack_from(f"{order}{'Q' if big else 'I'}", raw, k * size + 4)[0]
        if kind not in _KINDS:
            continue
        each = struct.calcsize(f"={_KINDS[kind]}")
        place = k * size + size - room
        data = raw[place : place + room]
        if each * count > room:
            data = f.read_at(each * count, struct.unpack(f"{order}{'Q' if big else 'I'}", data)[0])
        form = f"{order}{count}{_KINDS[kind]}" if len(_KINDS[kind]) == 1 else f"{order}{2 * count}I"
        tags[tag] = struct.unpack(form, data[: struct.calcsize(form)])
    return tags


def crs_of(tags: dict) -> int | None:
    """The EPSG code that the file's keys give, projected or geographic."""
    keys = tags.get(GEO_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    return found.get(PROJECTED_KEY) or found.get(GEOGRAPHIC_KEY)


class Block(InputPartition):
    def __init__(self, path: str, row: tuple, offset: int, size: int, shape: tuple[int, int], form: tuple):
        super().__init__((path, offset))
        self.path, self.row, self.offset, self.size, self.shape, self.form = path, row, offset, size, shape, form


def blocks_of(path: str) -> list[Block]:
    files, name = _open(path)
    with files.open_input_file(name) as f:
        tags = header(f)
    order, columns, rows = tags["order"][0], tags[WIDTH][0], tags[HEIGHT][0]
    if TILES in tags:
        tall, wide, offsets, sizes = tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0], tags[TILES], tags[TILE_BYTES]
    else:
        tall, wide, offsets, sizes = min(rows, tags.get(STRIP_ROWS, (rows,))[0]), columns, tags[STRIPS], tags[STRIP_BYTES]
    sample = f"{order}{_SAMPLES[tags.get(SAMPLE_FORMAT, (1,))[0]]}{tags[BITS][0] // 8}"
    missing = tags.get(NO_DATA)
    missing = float(missing[0].split(b"\0")[0]) if missing else None
    step_x, step_y = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIE_POINT, (0.0,) * 6)
    west, north = tie[3] - tie[0] * step_x, tie[4] + tie[1] * step_y
    form, crs, across = (sample, tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0], missing), crs_of(tags), -(-columns // wide)
    out = []
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        top, left = k // across * tall, k % across * wide
        height, width = min(tall, rows - top), min(wide, columns - left)
        box = (west + left * step_x, north - (top + height) * step_y, west + (left + width) * step_x, north - top * step_y)
        # a tile is stored whole, a last strip as far as it goes
        shape = (tall, wide) if TILES in tags else (height, wide)
        out.append(Block(path, (path, crs, top, left, height, width, *box, float(step_x), float(step_y)), offset, size, shape, form))
    return out


_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_HOLDS = {LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.bounds = path, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _HOLDS and len(f.attribute) == 1 and f.attribute[0] in ("west", "east", "south", "north", "top", "left"):
                self.bounds.append((_COLUMNS.index(f.attribute[0]), type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Block]:
        files, name = _open(self.path)
        info = files.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        paths = [self.path]
        if info.type == fs.FileType.Directory:
            found = (i.path for i in files.get_file_info(fs.FileSelector(name, recursive=True)))
            paths = sorted(self.path.rstrip("/") + p[len(name.rstrip("/")) :] for p in found if p.lower().endswith((".tif", ".tiff")))
        every = (b for p in paths for b in blocks_of(p))
        return [b for b in every if all(_HOLDS[kind](b.row[i], value) for i, kind, value in self.bounds)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a scan of no blocks
            return
        sample, compression, predictor, missing = partition.form
        files, name = _open(partition.path)
        with files.open_input_file(name) as f:
            data = f.read_at(partition.size, partition.offset)
        if compression in (DEFLATE, DEFLATE_OLD):
            data = zlib.decompress(data)
        elif compression != NONE:
            raise ValueError(f"compression {compression} can't be read")
        cells = np.frombuffer(data, sample, count=math.prod(partition.shape)).reshape(partition.shape)
        if predictor == 2:
            cells = np.cumsum(cells, axis=1, dtype=cells.dtype.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} can't be read")
        height, width = partition.row[4:6]
        cells = cells[:height, :width].astype(np.float64).ravel()
        lost = np.isnan(cells) if missing is None else np.isnan(cells) | (cells == missing)
        columns = [pa.array([v], t) for v, t in zip(partition.row, (pa.string(), *[pa.int32()] * 5, *[pa.float64()] * 6), strict=True)]
        values = pa.array(cells, pa.float64(), mask=lost)
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), values)], names=_COLUMNS)


class Tiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a raster file, or of all of a folder's."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tiff)
    return spark.read.format("tiff").load(path)


def cells(rows: DataFrame) -> DataFrame:
    """file, row, col, x, y (a cell's middle) and elev of every cell of the blocks."""
    each = rows.select("file", "top", "left", "width", "west", "north", "step_x", "step_y", F.posexplode("cells").alias("_i", "elev"))
    down, right = F.floor(F.col("_i") / F.col("width")).cast("int"), (F.col("_i") % F.col("width")).cast("int")
    x, y = F.col("west") + (right + 0.5) * F.col("step_x"), F.col("north") - (down + 0.5) * F.col("step_y")
    return each.select("file", (F.col("top") + down).alias("row"), (F.col("left") + right).alias("col"), x.alias("x"), y.alias("y"), "elev")


#: Half axis and flattening of the spheroid, and the scale and false origin of the universal transverse Mercator zones.
AXIS, FLAT, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def utm(lat: float, lng: float, zone: int, south: bool = False) -> tuple[float, float]:
    """Easting and northing in a zone, by Krueger's series to the third order: exact to a millimetre in a zone."""
    n = FLAT / (2 - FLAT)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, off = math.radians(lat), math.radians(lng - (6 * zone - 183))
    k = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - k * math.atanh(k * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(off)), math.atanh(math.sin(off) / math.sqrt(1 + t * t))
    east = eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    north = xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return EAST + SCALE * a * east, SCALE * a * north + (SOUTH if south else 0.0)


def to_file(crs: int | None, lat: float, lng: float) -> tuple[float, float]:
    """A place in the coordinates of a file: degrees (4326, 4269 or none), or a UTM zone's metres (326xx, 327xx, 269xx)."""
    if crs in (None, 4326, 4269):
        return lng, lat
    if crs // 100 in (326, 327, 269) and 1 <= crs % 100 <= 60:
        return utm(lat, lng, crs % 100, crs // 100 == 327)
    raise ValueError(f"EPSG {crs} isn't known here")


def window(spark: SparkSession, path: str, lat: float, lng: float, metres: float) -> DataFrame:
    """Cells of one file within a square of ``metres`` to each side of a place, as far as the file reaches; only the square's blocks are read."""
    files, name = _open(path)
    with files.open_input_file(name) as f:
        crs = crs_of(header(f))
    x, y = to_file(crs, lat, lng)
    degrees = crs in (None, 4326, 4269)
    half_y = metres / LNG_DEGREE_M if degrees else metres
    half_x = half_y / max(0.1, math.cos(math.radians(lat))) if degrees else metres
    near = blocks(spark, path).where((F.col("west") <= x + half_x) & (F.col("east") >= x - half_x) & (F.col("south") <= y + half_y) & (F.col("north") >= y - half_y))
    return cells(near).where((F.abs(F.col("x") - x) <= half_x) & (F.abs(F.col("y") - y) <= half_y))
