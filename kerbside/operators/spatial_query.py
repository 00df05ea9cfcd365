"""Spatial queries over image points: near a point, along a line, in a box, in a polygon, at a named place.

A query narrows (`select_from`) and measures (`add_distances`). Both are lazy expressions. Points are columns lat and lon.
All arguments but the coordinates are by keyword only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo

Point = tuple[float, float]
Rings = list[list[Point]]


def _pairs(points: Sequence[Sequence[float]], least: int, what: str) -> list[Point]:
    if not isinstance(points, (list, tuple)):
        raise TypeError(f"{what} takes a list of (lon, lat)")
    if len(points) < least:
        raise ValueError(f"{what} needs at least {least} points, got {len(points)}")
    return [(float(x), float(y)) for x, y in points]


def _nested(geometry) -> bool:
    return bool(geometry) and isinstance(geometry[0], (list, tuple)) and bool(geometry[0]) and isinstance(geometry[0][0], (list, tuple))


@dataclass(kw_only=True)
class BaseQuery:
    """buffer_m: how far from the geometry rows are still selected."""

    buffer_m: float = 50.0

    def __post_init__(self) -> None:
        if self.buffer_m < 0:
            raise ValueError(f"buffer_m must not be negative, got {self.buffer_m}")

    @property
    def query_type(self) -> str:
        raise NotImplementedError

    #: The column to rank by, for a limit on the rows.
    distance_column = "distance_to_query_m"

    def geojson(self) -> dict:
        raise NotImplementedError

    def to_frame(self, spark) -> DataFrame:
        """One row with the geometry as GeoJSON."""
        return spark.createDataFrame([(self.query_type, json.dumps(self.geojson()))], "query_type string, geometry string")

    def distances(self, lat: Column, lon: Column) -> dict[str, Column]:
        raise NotImplementedError

    def predicate(self, lat: Column, lon: Column) -> Column:
        raise NotImplementedError

    def add_distances(self, df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """df with the distance columns of this kind of query, also if df is empty."""
        return df.withColumns(self.distances(F.col(lat), F.col(lon)))

    def select_from(self, df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        return df.where(self.predicate(F.col(lat), F.col(lon)))

    def nearest(self, df: DataFrame, n: int, id_col: str = "image_id") -> DataFrame:
        """The n rows nearest to the query, ties by id."""
        if self.distance_column not in df.columns:
            df = self.add_distances(df)
        return df.orderBy(self.distance_column, id_col).limit(n)


@dataclass(kw_only=True)
class PointQuery(BaseQuery):
    lat: float
    lon: float
    nearest_only: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if not -90 <= self.lat <= 90:
            raise ValueError(f"lat must be in [-90, 90], got {self.lat}")
        if not -180 <= self.lon <= 180:
            raise ValueError(f"lon must be in [-180, 180], got {self.lon}")

    @property
    def query_type(self) -> str:
        return "point"

    def geojson(self) -> dict:
        return {"type": "Point", "coordinates": [self.lon, self.lat]}

    def distances(self, lat: Column, lon: Column) -> dict[str, Column]:
        return {"distance_to_query_m": geo.haversine(lat, lon, geo.lit(self.lat), geo.lit(self.lon))}

    def predicate(self, lat: Column, lon: Column) -> Column:
        return geo.around(lat, lon, (self.lon, self.lat), self.buffer_m) & (self.distances(lat, lon)["distance_to_query_m"] <= self.buffer_m)

    def filter_nearest(self, df: DataFrame, id_col: str = "image_id") -> DataFrame:
        """The nearest row, if nearest_only."""
        return self.nearest(df, 1, id_col) if self.nearest_only else df


@dataclass(kw_only=True)
class LineQuery(BaseQuery):
    """geometry: a list of (lon, lat), or a list of such lists for a line of several parts."""

    geometry: list
    buffer_m: float = 25.0
    distance_column = "distance_to_line_m"

    def __post_init__(self) -> None:
        if self.buffer_m <= 0:
            raise ValueError(f"buffer_m must be positive for a line, got {self.buffer_m}")
        if self.geometry is None:
            raise ValueError("a line query needs a geometry")
        self.parts = [_pairs(p, 2, "a line") for p in (self.geometry if _nested(self.geometry) else [self.geometry])]

    @property
    def query_type(self) -> str:
        return "line"

    def geojson(self) -> dict:
        many = len(self.parts) > 1
        return {"type": "MultiLineString" if many else "LineString", "coordinates": self.parts if many else self.parts[0]}

    def distances(self, lat: Column, lon: Column) -> dict[str, Column]:
        found = geo.line_distance(lat, lon, self.parts)
        return {"distance_to_line_m": found["distance"], "distance_along_line_m": found["along"]}

    def predicate(self, lat: Column, lon: Column) -> Column:
        near = self.distances(lat, lon)["distance_to_line_m"] <= self.buffer_m
        return _buffered_box(lat, lon, self.parts, self.buffer_m) & near


@dataclass(kw_only=True)
class _Area(BaseQuery):
    buffer_m: float = 0.0
    distance_column = "distance_to_centroid_m"

    def rings(self) -> Rings:
        raise NotImplementedError

    @property
    def query_type(self) -> str:
        return "polygon"

    def geojson(self) -> dict:
        return {"type": "Polygon", "coordinates": [[*r, r[0]] for r in self.rings()]}

    def inside(self, lat: Column, lon: Column) -> Column:
        return geo.within(lat, lon, self.rings())

    def distances(self, lat: Column, lon: Column) -> dict[str, Column]:
        x, y = geo.centroid(self.rings())
        return {"distance_to_centroid_m": geo.haversine(lat, lon, geo.lit(y), geo.lit(x)), "inside_query": self.inside(lat, lon)}

    def predicate(self, lat: Column, lon: Column) -> Column:
        inside = self.inside(lat, lon)
        if not self.buffer_m:
            return inside
        return _buffered_box(lat, lon, self.rings(), self.buffer_m) & (inside | (geo.edge_distance(lat, lon, self.rings()) <= self.buffer_m))


@dataclass(kw_only=True)
class BBoxQuery(_Area):
    minx: float
    miny: float
    maxx: float
    maxy: float

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.minx >= self.maxx or self.miny >= self.maxy:
            raise ValueError(f"a box needs minx < maxx and miny < maxy, got {(self.minx, self.miny, self.maxx, self.maxy)}")
        if not (-90 <= self.miny and self.maxy <= 90 and -180 <= self.minx and self.maxx <= 180):
            raise ValueError("the box leaves the range of longitudes and latitudes")

    @property
    def query_type(self) -> str:
        return "bbox"

    def rings(self) -> Rings:
        return [[(self.minx, self.miny), (self.maxx, self.miny), (self.maxx, self.maxy), (self.minx, self.maxy)]]

    def inside(self, lat: Column, lon: Column) -> Column:
        return (lon > geo.lit(self.minx)) & (lon < geo.lit(self.maxx)) & (lat > geo.lit(self.miny)) & (lat < geo.lit(self.maxy))


@dataclass(kw_only=True)
class PolygonQuery(_Area):
    """geometry: a ring of (lon, lat), or a list of rings: even-odd, so holes and several parts are rings more."""

    geometry: list

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.geometry is None:
            raise ValueError("a polygon query needs a geometry")
        self._rings = [_open(_pairs(r, 3, "a polygon")) for r in (self.geometry if _nested(self.geometry) else [self.geometry])]

    def rings(self) -> Rings:
        return self._rings


def _open(ring: list[Point]) -> list[Point]:
    return ring[:-1] if len(ring) > 3 and ring[0] == ring[-1] else ring


Geocoder = Callable[[str], dict]


@dataclass(kw_only=True)
class PlaceQuery(BaseQuery):
    """A named place. geocoder takes a name and gives GeoJSON: a Point, Polygon or MultiPolygon; it is asked once."""

    place_name: str
    geocoder: Geocoder | None = None
    buffer_m: float = 0.0
    _found: BaseQuery | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.place_name:
            raise ValueError("a place query needs a place_name")

    def resolved(self) -> BaseQuery:
        """The query for the place's geometry; ValueError if there is none."""
        if self._found is None:
            try:
                geometry = self.geocoder(self.place_name)
                kind, where = geometry["type"], geometry["coordinates"]
            except Exception as e:  # geocoders fail in ways of their own
                raise ValueError(f"can't find the place {self.place_name!r}: {e}") from e
            if kind == "Point":
                self._found = PointQuery(lat=where[1], lon=where[0], buffer_m=self.buffer_m)
            elif kind in ("Polygon", "MultiPolygon"):
                self._found = PolygonQuery(geometry=where if kind == "Polygon" else [r for p in where for r in p], buffer_m=self.buffer_m)
            else:
                raise ValueError(f"the place {self.place_name!r} is a {kind}")
        return self._found

    @property
    def query_type(self) -> str:
        return self.resolved().query_type

    @property
    def distance_column(self) -> str:
        return self.resolved().distance_column

    def geojson(self) -> dict:
        return self.resolved().geojson()

    def distances(self, lat: Column, lon: Column) -> dict[str, Column]:
        return self.resolved().distances(lat, lon)

    def predicate(self, lat: Column, lon: Column) -> Column:
        return self.resolved().predicate(lat, lon)


def _buffered_box(lat: Column, lon: Column, rings: Sequence[Sequence[Point]], metres: float) -> Column:
    """The bounds of rings with metres around them, in degrees at the latitude where a degree is shortest."""
    far = max(abs(y) for r in rings for _, y in r)
    margin = metres / (geo.EARTH_RADIUS_M * 3.14159 / 180) / max(1e-3, geo.math.cos(geo.math.radians(min(89.9, far + 1)))) + 1e-9
    return geo.box_of(lat, lon, rings, margin)


def captured_between(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "captured_at") -> DataFrame:
    """Rows captured from the day start to the day end, both included; rows without a time go if either is given."""
    if start is not None:
        df = df.where(F.col(column) >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        df = df.where(F.col(column) < F.to_timestamp_ntz(F.lit(end)) + F.expr("INTERVAL 1 DAY"))
    return df
