"""Distances, boxes and grid cells as expressions."""

from __future__ import annotations

import math
from typing import NamedTuple, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import check_number

EARTH_M = 6_371_000
DEGREE_M = 111_000


class Box(NamedTuple):
    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float


def radius_box(lat: float, lon: float, radius_m: float) -> Box:
    d = radius_m / DEGREE_M
    wide = d / math.cos(math.radians(lat))
    return Box(round(lon - wide, 6), round(lon + wide, 6), round(lat - d, 6), round(lat + d, 6))


def grid_steps(radius_m: float) -> int:
    """Rings of cells around a point's own that a radius is looked up in."""
    return 0 if radius_m <= 5000 else 1 if radius_m <= 10000 else 2


def haversine(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    """Metres on a sphere."""
    a, o = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat0, lon0))
    h = F.pow(F.sin(F.radians(lat - a) / 2), F.lit(2.0)) + F.cos(F.radians(a)) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - o) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    """Plain ranges of stored columns, so that Parquet skips row groups."""
    return lat.between(box.min_lat, box.max_lat) & lon.between(box.min_lon, box.max_lon)


class Grid(Protocol):
    """How points map to cells and cells to tiles. cell, parent and tile work on columns; ring gives an array of cells."""

    def cell(self, lat: Column, lon: Column) -> Column: ...
    def tile(self, cell: Column) -> Column: ...
    def ring(self, cell: Column, steps: int) -> Column: ...


class DegreeGrid:
    """Cells of 0.1 degrees, numbered by rows of 10,000; tiles of 1 degree, named t<lat+90>x<lon+180>."""

    def cell(self, lat: Column, lon: Column) -> Column:
        return F.floor((lat + 90) * 10).cast("long") * 10000 + F.floor((lon + 180) * 10).cast("long")

    def tile(self, cell: Column) -> Column:
        y, x = F.floor(F.floor(cell / 10000) / 10), F.floor(F.pmod(cell, F.lit(10000)) / 10)
        return F.concat(F.lit("t"), y.cast("string"), F.lit("x"), x.cast("string"))

    def ring(self, cell: Column, steps: int) -> Column:
        check_number(steps, "steps", 0, 10)
        return F.array(*[cell + F.lit(dy * 10000 + dx).cast("long") for dy in range(-steps, steps + 1) for dx in range(-steps, steps + 1)])


# Hexagonal cells as 64-bit numbers: bits 52-55 hold the resolution, three bits below for each finer step.
def hex_parent(cell: Column, resolution: int) -> Column:
    """The ancestor at a coarser resolution: its number there, and the steps below it set to ones."""
    cleared = cell.bitwiseAND(F.lit(~(15 << 52)))
    unused = (1 << (3 * (15 - resolution))) - 1
    return cleared.bitwiseOR(F.lit(resolution << 52)).bitwiseOR(F.lit(unused))


def hex_resolution(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 52).bitwiseAND(F.lit(15))


def hex_name(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def hex_number(name: Column) -> Column:
    return F.conv(name, 16, 10).cast("long")


def e6(degrees: Column) -> Column:
    """Millionths, rounded half to even as the index files are."""
    return F.bround(degrees * 1_000_000).cast("int")


def from_e6(value: Column, pad: float = 0.0) -> Column:
    return value / 1_000_000 + pad


def clicked(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A point on a map as it is searched for: to four places, about eleven metres."""
    return F.round(lat, 4), F.round(lon, 4)


def point_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f,%.6f", lat, lon)


def box_polygon(box: Box) -> str:
    """A closed ring as GeoJSON."""
    import json

    ring = [[box.min_lon, box.min_lat], [box.max_lon, box.min_lat], [box.max_lon, box.max_lat], [box.min_lon, box.max_lat], [box.min_lon, box.min_lat]]
    return json.dumps({"type": "Polygon", "coordinates": [ring]})
