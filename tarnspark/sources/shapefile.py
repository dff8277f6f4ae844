"""Shapefiles and their tables as a Spark data source: ``spark.read.format("shapefile").load(folder or file)``.

The index (.shx) tells where each record begins, so a file is read in ranges of records by several tasks. A row has the
properties as a map of text and the rings (of a polygon), or the one point as a ring of one corner.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.projections import parse_prj, rings_in_degrees

SCHEMA = "file string, record int, properties map<string,string>, rings array<array<struct<lng:double,lat:double>>>"
#: Records of a task. Shape types of the format: points 1, 11, 21; polygons 5, 15, 25.
RECORDS = 20_000
_POINT, _POLYGON = (1, 11, 21), (5, 15, 25)


class Records(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


def rings_of(content: bytes) -> list[list[tuple[float, float]]] | None:
    """Rings of a record's shape; None for an empty one or another kind."""
    kind = struct.unpack_from("<i", content)[0]
    if kind in _POINT:
        return [[struct.unpack_from("<2d", content, 4)]]
    if kind not in _POLYGON:
        return None
    parts, points = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    xy = struct.unpack_from(f"<{2 * points}d", content, 44 + 4 * parts)
    corners = list(zip(xy[::2], xy[1::2], strict=True))
    return [corners[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def fields_of(f) -> tuple[int, int, list[tuple[str, int]]]:
    """Header and record length of an open table, and its fields' names and widths."""
    head = f.read(32)
    header, record = struct.unpack_from("<HH", head, 8)
    names = []
    while (raw := f.read(32)) and raw[0] != 0x0D:
        names.append((raw[:11].split(b"\0")[0].decode(), raw[16]))
    return header, record, names


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        root, found = Path(self.path), []
        for path in sorted(root.rglob("*.shp")) if root.is_dir() else [root]:
            n = (path.with_suffix(".shx").stat().st_size - 100) // 8
            found += [Records(str(path), k, min(k + RECORDS, n)) for k in range(0, n, RECORDS)]
        return found

    def read(self, partition: Records) -> Iterator[tuple]:
        path = Path(partition.path)
        encoding = path.with_suffix(".cpg").read_text().strip() if path.with_suffix(".cpg").exists() else "latin-1"
        with open(path, "rb") as shapes, open(path.with_suffix(".shx"), "rb") as index, open(path.with_suffix(".dbf"), "rb") as table:
            header, size, names = fields_of(table)
            index.seek(100 + 8 * partition.first)
            for record in range(partition.first, partition.last):
                offset, length = struct.unpack(">2i", index.read(8))
                shapes.seek(2 * offset + 8)
                rings = rings_of(shapes.read(2 * length))
                table.seek(header + record * size)
                row, at, values = table.read(size), 1, {}
                for name, width in names:
                    values[name] = row[at : at + width].decode(encoding, "replace").strip() or None
                    at += width
                if row[:1] != b"*":  # marked as deleted
                    yield str(path), record, values, rings


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def shapefiles(spark: SparkSession, path: str):
    """Features of shapefiles under a path that all executors can open."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").load(path)


def in_degrees(spark: SparkSession, path: str, where: str | None = None, select: list[str] | None = None, limit: int | None = None, longest: float = 1000.0) -> DataFrame:
    """Features of one shapefile with their rings in degrees, by the .prj beside it (none: they are in degrees).

    ``where`` is a condition in SQL over ``properties`` and ``record``; ``select`` are the properties to keep as columns (all stay
    in the map if None); with ``limit`` only the first records. Edges longer than ``longest`` metres are cut first.
    """
    prj = Path(path).with_suffix(".prj")
    rows = shapefiles(spark, path)
    rows = rows.where(where) if where else rows
    rows = rows.orderBy("record").limit(limit) if limit is not None else rows
    columns = ["properties"] if select is None else [F.col("properties")[c].alias(c) for c in select]
    rings = rings_in_degrees(F.col("rings"), parse_prj(prj.read_text()), longest) if prj.exists() else F.col("rings")
    return rows.select("file", "record", *columns, rings.alias("rings"))
