"""Where images come from: a source gives metadata for a query, ranks it before anything is fetched, and fetches what is left."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kerbside.functions import geo
from kerbside.operators.spatial_query import BaseQuery, Geocoder, captured_between
from kerbside.session import ship
from kerbside.sources import files

#: Picture widths that a source may offer, and the field of a service or column of a table that has the URL.
RESOLUTIONS = {width: f"thumb_{width}_url" for width in (256, 1024, 2048)}
Box = tuple[float, float, float, float]


class ImageSource(Protocol):
    def metadata(self, spark: SparkSession, query: BaseQuery | None = None, start_date: str | None = None, end_date: str | None = None, use_cache: bool = True) -> DataFrame:
        """image_id, lat, lon and, if known, captured_at, lazily; at least the images that the query may want."""

    #: A URL with {id} and {resolution}.
    pattern: str


@dataclass
class TableSource:
    """Metadata in a table of Parquet."""

    path: str
    pattern: str = "{id}_{resolution}.jpg"

    def metadata(self, spark: SparkSession, query: BaseQuery | None = None, start_date: str | None = None, end_date: str | None = None, use_cache: bool = True) -> DataFrame:
        return spark.read.parquet(self.path)


@dataclass
class FrameSource:
    """Metadata in a DataFrame."""

    frame: DataFrame
    pattern: str = "{id}_{resolution}.jpg"

    def metadata(self, spark: SparkSession, query: BaseQuery | None = None, start_date: str | None = None, end_date: str | None = None, use_cache: bool = True) -> DataFrame:
        return self.frame


def query_box(query: BaseQuery) -> Box:
    """(west, south, east, north) of what a query covers, its buffer included."""
    flat: list[tuple[float, float]] = []

    def walk(x) -> None:
        if x and isinstance(x[0], (int, float)):
            flat.append((float(x[0]), float(x[1])))
        else:
            for y in x:
                walk(y)

    walk(query.geojson()["coordinates"])
    west, south, east, north = min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat)
    tall = math.degrees((getattr(query, "buffer_m", 0) or 0) / geo.EARTH_RADIUS_M) * 1.001
    wide = tall / max(0.01, math.cos(math.radians(min(89.0, max(abs(south), abs(north)) + tall))))
    return west - wide, south - tall, east + wide, north + tall


SCHEMA = "image_id string, lat double, lon double, captured_at timestamp_ntz"


@dataclass
class RemoteSource:
    """Metadata of a service that answers for boxes: a Python data source with a partition for each tile of the query's box.

    client takes (box, start_date, end_date) and yields dicts or tuples of SCHEMA; it runs on the executors, tile by tile. An image on the border of two tiles counts once. With cache_dir, answers are
    kept there as Parquet by tile size, box and dates, and read again unless use_cache is false.
    """

    client: Callable[[Box, str | None, str | None], Iterable]
    pattern: str = "{id}_{resolution}.jpg"
    tile_degrees: float = 0.01
    cache_dir: str | None = None

    def tiles(self, box: Box) -> list[Box]:
        d = self.tile_degrees
        columns, rows = (range(math.floor(a / d), math.floor(b / d) + 1) for a, b in ((box[0], box[2]), (box[1], box[3])))
        return [(i * d, j * d, (i + 1) * d, (j + 1) * d) for i in columns for j in rows]

    def metadata(self, spark: SparkSession, query: BaseQuery | None = None, start_date: str | None = None, end_date: str | None = None, use_cache: bool = True) -> DataFrame:
        if query is None:
            raise ValueError("a remote source needs a query: it can't list the whole world")
        ship(spark)
        box = query_box(query)
        key = hashlib.md5(json.dumps([self.tile_degrees, self.tiles(box)[0], self.tiles(box)[-1], start_date, end_date]).encode()).hexdigest()
        kept = f"{self.cache_dir}/{key}" if self.cache_dir else None
        if kept and use_cache and files.exists(spark, f"{kept}/_SUCCESS"):
            return spark.read.parquet(kept)
        client, tiles = self.client, self.tiles(box)

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(t) for t in tiles]

            def read(self, partition):
                for row in client(partition.value, start_date, end_date):
                    yield tuple(row.get(c) for c in ("image_id", "lat", "lon", "captured_at")) if isinstance(row, dict) else tuple(row)

        class Tiles(DataSource):
            @classmethod
            def name(cls):
                return f"kerbside_tiles_{key}"

            def schema(self):
                return SCHEMA

            def reader(self, schema):
                return Reader()

        spark.dataSource.register(Tiles)
        found = spark.read.format(Tiles.name()).load().dropDuplicates(["image_id"])
        if kept:
            found.write.mode("overwrite").parquet(kept)
            return spark.read.parquet(kept)
        return found


@dataclass
class ImageDownloader:
    """Selects a source's images by a query, and fetches them.

    get takes a URL and gives the image's bytes; it runs on the executors, as do put, which takes (image_id, bytes), and lookup, which takes (image_id, field)
    and gives the URL, for sources that have no pattern.
    """

    source: ImageSource
    get: Callable[[str], bytes] | None = None
    put: Callable[[str, bytes], None] | None = None
    id_col: str = "image_id"
    lookup: Callable[[str, str], str | None] | None = None

    def select(self, spark: SparkSession, query: BaseQuery, start_date: str | None = None, end_date: str | None = None, max_images: int | None = None, use_cache: bool = True) -> DataFrame:
        """The query's metadata with its distances; the nearest max_images, if given, for every kind of query."""
        if not isinstance(query, BaseQuery):
            raise TypeError(f"{type(query).__name__} is no query")
        df = self.source.metadata(spark, query, start_date, end_date, use_cache)
        if start_date or end_date:
            df = captured_between(df, start_date, end_date)
        df = query.add_distances(query.select_from(df))
        if getattr(query, "nearest_only", False):
            return query.filter_nearest(df, self.id_col)
        return df if max_images is None else query.nearest(df, max_images, self.id_col)

    get_metadata_only = select

    def _ids(self, chosen: DataFrame, done: DataFrame | None) -> DataFrame:
        ids = chosen.select(F.col(self.id_col).cast("string").alias("image_id")).where("image_id IS NOT NULL").distinct()
        return ids if done is None else ids.join(done.select(F.col(self.id_col).cast("string").alias("image_id")), "image_id", "left_anti")

    def fetch(self, chosen: DataFrame, resolution: int = 1024, done: DataFrame | None = None) -> DataFrame:
        """(image_id, status, error): ok, or what went wrong, of every image not done yet. Failures are rows, not exceptions."""
        resolution = resolution if resolution in RESOLUTIONS else 1024
        pattern, lookup, field = self.source.pattern, self.lookup, RESOLUTIONS[resolution]
        return self._fetched(self._ids(chosen, done).withColumn("url", F.lit(None).cast("string")), lambda name, _: lookup(name, field) if lookup else pattern.format(id=name, resolution=resolution))

    def fetch_from_urls(self, chosen: DataFrame, urls: DataFrame, resolution: int = 1024, done: DataFrame | None = None, url_id: str = "id") -> DataFrame:
        """The same for URLs in a table (id, url, and columns for other resolutions): that of the resolution, else url. An image that the table has no URL of is a failure."""
        name = RESOLUTIONS[resolution] if resolution in (256, 2048) else "url"
        found = [F.nullif(F.trim(f"`{c}`"), F.lit("")) for c in dict.fromkeys([name, "url"]) if c in urls.columns]
        listed = urls.groupBy(F.col(f"`{url_id}`").cast("string").alias("image_id")).agg(F.min(F.coalesce(*found)).alias("url"))
        return self._fetched(self._ids(chosen, done).join(listed, "image_id", "left"), lambda _, url: url)

    def _fetched(self, ids: DataFrame, url_of: Callable[[str, str | None], str | None]) -> DataFrame:
        if self.get is None or self.put is None:
            raise RuntimeError("fetching needs get and put")
        get, put = self.get, self.put

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                errors = []
                for name, told in zip(names, batch.column(1).to_pylist(), strict=True):
                    try:
                        url = url_of(name, told)
                        if not url:
                            raise LookupError("no URL")
                        put(name, get(url))
                        errors.append(None)
                    except Exception as e:  # one image must not end the others
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(["ok" if e is None else "failed" for e in errors]), pa.array(errors, pa.string())], ["image_id", "status", "error"])

        return ids.mapInArrow(run, "image_id string, status string, error string")

    def download(self, spark: SparkSession, query: BaseQuery, resolution: int = 1024, start_date: str | None = None, end_date: str | None = None, metadata_only: bool = False, max_images: int | None = None, use_cache: bool = True) -> DataFrame:
        """The selected metadata, with status and error of its fetch unless metadata_only; the limit comes before the fetch."""
        chosen = self.select(spark, query, start_date, end_date, max_images, use_cache)
        return chosen if metadata_only else chosen.join(self.fetch(chosen, resolution), self.id_col, "left")


def download_images(spark: SparkSession, query: BaseQuery, source: ImageSource, get: Callable[[str], bytes] | None = None, put: Callable[[str, bytes], None] | None = None, lookup: Callable[[str, str], str | None] | None = None, **options) -> DataFrame:
    """One call for a query: ImageDownloader(source, ...).download(query, ...), whose options it takes."""
    return ImageDownloader(source, get, put, lookup=lookup).download(spark, query, **options)


def already_there(spark: SparkSession, directory: str) -> DataFrame:
    """(image_id) of the images in a directory."""
    names = [(p.rsplit("/", 1)[-1].rsplit(".", 1)[0],) for p, _ in files.glob(spark, directory)] if files.exists(spark, directory) else []
    return spark.createDataFrame(names, "image_id string")


def gazetteer(places: DataFrame, name: str = "name", geometry: str = "geometry") -> Geocoder:
    """A geocoder over a table of names and GeoJSON texts; names are compared without case. KeyError for none, the least geometry of several."""
    def find(place: str) -> dict:
        row = places.where(F.lower(F.col(name)) == place.lower()).agg(F.min(geometry)).first()
        if row[0] is None:
            raise KeyError(place)
        return json.loads(row[0])

    return find
