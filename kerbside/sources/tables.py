"""Reading, writing, exporting and summarising tables of image points."""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kerbside.functions import geo
from kerbside.operators import summaries
from kerbside.session import ship
from kerbside.sources import files

log = logging.getLogger(__name__)
FORMATS = ("geoparquet", "geojson", "csv", "gpkg")


def to_points(df: DataFrame, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """df with a WKB column geometry made from lat_col and lon_col; df itself if it has one. Null coordinates give null."""
    if "geometry" in df.columns:
        return df
    if missing := [c for c in (lat_col, lon_col) if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    return df.withColumn("geometry", geo.wkb_point(F.col(f"`{lon_col}`").cast("double"), F.col(f"`{lat_col}`").cast("double")))


def _geo_metadata() -> dict:
    """The ``geo`` entry of a Parquet footer; without a crs, coordinates are longitude and latitude."""
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"]}}}


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def save_geoparquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> str:
    """GeoParquet: WKB points, described in the footer of every file, where readers look for it.

    Spark's own writer has no way to that entry, so each task writes its partition through Arrow, under a name of its own, in a folder beside the data. The files of the tasks that
    succeeded are then moved to path; those of lost attempts are deleted.
    """
    if "geometry" not in df.columns:
        raise TypeError("no column geometry; see to_points")
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    ship(df.sparkSession)
    folder = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    schema = to_arrow_schema(df.schema).with_metadata({"geo": json.dumps(_geo_metadata())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            if out is None:
                out = pq.ParquetWriter(f"{base}/{name}", schema, compression=compression, filesystem=fs)
            out.write_table(pa.Table.from_batches([batch]).cast(schema))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    names = [r[0] for r in df.mapInArrow(write, "name string").collect()]  # one a task
    fs, base = _file_system(folder)
    _, target = _file_system(path.rstrip("/"))
    if not names:  # no rows: a file that says what columns there would be
        fs.create_dir(base, recursive=True)
        names = [f"part-{uuid.uuid4().hex}.parquet"]
        pq.write_table(schema.empty_table(), f"{base}/{names[0]}", filesystem=fs)
    if mode == "overwrite":
        files.delete(df.sparkSession, path)
    fs.create_dir(target, recursive=True)
    for name in names:
        fs.move(f"{base}/{name}", f"{target}/{name}")
    fs.delete_dir(base)
    return path


def load_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    """The table, with lat and lon worked out from geometry where it has none."""
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    if "geometry" in df.columns and not {"lat", "lon"} <= set(df.columns) and dict(df.dtypes)["geometry"] == "binary":
        lon, lat = geo.point_of_wkb(F.col("geometry"))
        df = df.withColumns({c: e for c, e in (("lat", lat), ("lon", lon)) if c not in df.columns})
    return df


_OPERATORS = {"==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v))}


def row_filter(filters: Sequence) -> Column:
    """A predicate from [(column, operator, value), ...], all of which must hold, or a list of such lists, one of which must."""
    groups = filters if filters and isinstance(filters[0], list) else [filters]
    out = F.lit(False)
    for group in groups:
        every = F.lit(True)
        for name, operator, value in group:
            if operator not in _OPERATORS:
                raise ValueError(f"unknown operator {operator!r}")
            every = every & _OPERATORS[operator](F.col(f"`{name}`"), value)
        out = out | every
    return out


def load_results(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: Sequence | None = None) -> DataFrame:
    """Some columns of the rows that pass filters; both reach the Parquet scan."""
    df = load_geoparquet(spark, path)
    if filters:
        df = df.where(row_filter(list(filters)))
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


def feature(df: DataFrame, lat: str = "lat", lon: str = "lon") -> Column:
    """A row as a GeoJSON Feature; geometry and coordinates are not among its properties."""
    other = [c for c in df.columns if c not in ("geometry", lat, lon)]
    properties = F.struct(*(F.col(f"`{c}`") for c in other)) if other else F.create_map().cast("map<string,string>")
    point = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def export_formats(df: DataFrame, output_dir: str, basename: str = "results", formats: str | Sequence[str] = "geoparquet") -> dict[str, str]:
    """{format: path} of the formats written. csv has no geometry; geojson is one feature a line (newline-delimited)."""
    wanted = formats.lower().split() if isinstance(formats, str) else [f.lower() for f in formats]
    out, base = {}, f"{output_dir.rstrip('/')}/{basename}"
    for fmt in wanted:
        if fmt == "geoparquet":
            out[fmt] = save_geoparquet(to_points(df), f"{base}.parquet")
        elif fmt == "csv":
            flat = df.drop("geometry").select(*(F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.drop("geometry").dtypes))
            flat.write.mode("overwrite").option("header", True).csv(f"{base}.csv")
            out[fmt] = f"{base}.csv"
        elif fmt == "geojson":
            df.select(feature(df)).write.mode("overwrite").text(f"{base}.geojson")
            out[fmt] = f"{base}.geojson"
        elif fmt == "gpkg":
            from kerbside.sources.geopackage import write_geopackage

            out[fmt] = write_geopackage(df, f"{base}.gpkg")
        else:
            log.warning("unknown format %r is left out; known are %s", fmt, FORMATS)
    return out


def list_results(spark: SparkSession, directory: str, pattern: str = "**/*.parquet") -> list[str]:
    """Files below directory whose path from there fits a glob pattern, sorted; FileNotFoundError if there is no such directory. ** stands for any folders, none included."""
    fits = re.compile(_as_regex(pattern))
    base = files.qualified(spark, directory).rstrip("/") + "/"
    return [p for p, _ in files.glob(spark, directory, "", "/" in pattern) if fits.fullmatch(p.removeprefix(base))]


def _as_regex(pattern: str) -> str:
    """A glob pattern over paths as a regular expression."""
    out = []
    for k, piece in enumerate(re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]+\])", pattern)):
        if k % 2 == 0:
            out.append(re.escape(piece))
        else:
            out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or piece.replace("[!", "[^"))
    return "".join(out)


def summarize_results(spark: SparkSession, path: str, show_columns: bool = True, show_stats: bool = True) -> dict:
    """Rows, columns, size in KB, distributions of the categories and statistics of the distances, as DataFrames for the two last."""
    df = load_geoparquet(spark, path)
    found: dict = {"rows": df.count(), "columns": len(df.columns), "crs": "EPSG:4326" if "geometry" in df.columns else None, "size_kb": files.size(spark, path) / 1024}
    if show_columns:
        found["column_names"] = df.columns
    if show_stats:
        found |= {"categories": summaries.value_counts(df), "distances": summaries.number_summary(df)}
    return found


IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
EMBED_SUFFIXES = (*IMAGE_SUFFIXES, ".webp", ".bmp", ".tiff")


def list_images(spark: SparkSession, directory: str, suffixes: Sequence[str] = IMAGE_SUFFIXES, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the image files, sorted by path, whatever the case of their suffix; their bytes are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    pattern = "|".join(re.escape(s) for s in suffixes)
    return reader.load(directory).select("path", "length", "modificationTime").where(F.lower("path").rlike(f"({pattern})$")).orderBy("path")


def resolve_images(spark: SparkSession, source: str | Sequence[str], suffixes: Sequence[str] = EMBED_SUFFIXES) -> DataFrame:
    """(path) of the images to embed: those of a folder, sorted; a single file, whatever its suffix; or paths as given, in their order."""
    if not isinstance(source, str):
        return spark.createDataFrame([(str(p),) for p in source], "path string")
    if files.is_dir(spark, source):
        return list_images(spark, source, suffixes).select("path")
    return spark.createDataFrame([(source,)], "path string")


METADATA_PATHS = ("mly_pids.csv", "cache/pids_raw.csv", "cache_zensvi/pids_raw.csv")


def load_metadata(spark: SparkSession, directory: str, query=None, paths: Sequence[str] = METADATA_PATHS) -> DataFrame:
    """The crawler's metadata CSV, from the first of paths that exists: image_id, lat, lon, captured_at, image_path and a query's distances.

    Rows whose coordinates are no numbers are kept with nulls. Without a file: no rows.
    """
    found = next((p for p in paths if files.exists(spark, f"{directory}/{p}")), None)
    schema = "id string, lat double, lon double"
    if found is None:
        df = spark.createDataFrame([], f"{schema}, captured_at bigint")
    else:
        raw = spark.read.option("header", True).csv(f"{directory}/{found}")
        casts = {"id": "string", "lat": "double", "lon": "double", "captured_at": "bigint"}
        df = raw.select(*(F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in raw.columns))
    df = df.withColumns({"image_id": F.col("id"), "image_path": F.concat(F.lit(f"{directory}/mly_svi/"), "id", F.lit(".jpg"))})
    if "captured_at" in df.columns:
        df = df.withColumn("captured_at", F.timestamp_millis("captured_at").cast("timestamp_ntz"))
    if query is not None:
        df = query.add_distances(df)
        if getattr(query, "nearest_only", False):
            df = query.filter_nearest(df)
    return df
