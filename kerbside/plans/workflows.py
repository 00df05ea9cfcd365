"""Whole workflows: from a place to described images, clusters, spatial statistics and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from kerbside.functions.text import place_slug
from kerbside.operators.clustering import ClusterConfig, SemanticClusterer
from kerbside.operators.merge import merge_metadata_and_descriptions
from kerbside.operators.moran import moran_global, moran_local, moran_results
from kerbside.operators.neighbours import nearest_neighbours
from kerbside.operators.spatial_query import BaseQuery, BBoxQuery, Geocoder, LineQuery, PlaceQuery, PointQuery, PolygonQuery
from kerbside.operators.vector_store import VectorDB, VectorStore
from kerbside.providers import ImageDescriber, ImageEmbedder
from kerbside.session import cut
from kerbside.sources.images import ImageDownloader
from kerbside.sources.tables import export_formats, load_geoparquet, to_points


def describe_query(
    spark: SparkSession, query: BaseQuery, downloader: ImageDownloader, describer: ImageDescriber, output_dir: str | None = None, start_date: str | None = None, end_date: str | None = None,
    max_images: int | None = None, metadata_only: bool = False, formats: str = "geoparquet", basename: str = "results",
) -> DataFrame:
    """Selects images, describes them and joins the descriptions to their metadata; written to output_dir if it is given.

    The limit holds for metadata_only as well. Images are read where image_path says.
    """
    chosen = downloader.select(spark, query, start_date, end_date, max_images)
    if not metadata_only:
        described = describer.describe_frame(chosen, "image_path").drop("image_path")
        chosen = merge_metadata_and_descriptions(chosen, described)
    if output_dir:
        out = export_formats(to_points(chosen), output_dir, basename, formats)
        if "geoparquet" in out:
            return load_geoparquet(spark, out["geoparquet"])
    return chosen


def describe_place(spark: SparkSession, place_name: str, downloader: ImageDownloader, describer: ImageDescriber, geocoder: Geocoder, buffer_m: float = 0.0, output_dir: str | None = None, **more) -> DataFrame:
    out = f"{output_dir}/{place_slug(place_name)}" if output_dir else None
    return describe_query(spark, PlaceQuery(place_name=place_name, geocoder=geocoder, buffer_m=buffer_m), downloader, describer, out, **more)


def describe_point(spark: SparkSession, lat: float, lon: float, downloader: ImageDownloader, describer: ImageDescriber, buffer_m: float = 50.0, nearest_only: bool = False, output_dir: str | None = None, **more) -> DataFrame:
    out = f"{output_dir}/point_{lat:.4f}_{lon:.4f}" if output_dir else None
    return describe_query(spark, PointQuery(lat=lat, lon=lon, buffer_m=buffer_m, nearest_only=nearest_only), downloader, describer, out, **more)


def describe_line(spark: SparkSession, geometry: list, downloader: ImageDownloader, describer: ImageDescriber, buffer_m: float = 25.0, output_dir: str | None = None, **more) -> DataFrame:
    return describe_query(spark, LineQuery(geometry=geometry, buffer_m=buffer_m), downloader, describer, f"{output_dir}/line" if output_dir else None, **more)


def describe_bbox(spark: SparkSession, bounds: Sequence[float], downloader: ImageDownloader, describer: ImageDescriber, buffer_m: float = 0.0, output_dir: str | None = None, **more) -> DataFrame:
    minx, miny, maxx, maxy = bounds
    return describe_query(spark, BBoxQuery(minx=minx, miny=miny, maxx=maxx, maxy=maxy, buffer_m=buffer_m), downloader, describer, f"{output_dir}/bbox" if output_dir else None, **more)


def describe_polygon(spark: SparkSession, geometry: list, downloader: ImageDownloader, describer: ImageDescriber, buffer_m: float = 0.0, output_dir: str | None = None, **more) -> DataFrame:
    return describe_query(spark, PolygonQuery(geometry=geometry, buffer_m=buffer_m), downloader, describer, f"{output_dir}/polygon" if output_dir else None, **more)


def embed_place(spark: SparkSession, place_name: str, downloader: ImageDownloader, describer: ImageDescriber, embedder: ImageEmbedder, geocoder: Geocoder, text_column: str = "scene_narrative", **more) -> DataFrame:
    """describe_place with a column embedding. The describing and the embedding model are arguments of their own."""
    return embedder.embed(describe_place(spark, place_name, downloader, describer, geocoder, **more), text_column)


def _frame(spark: SparkSession | None, data: DataFrame | str) -> DataFrame:
    return load_geoparquet(spark, data) if isinstance(data, str) else data


def cluster_descriptions(data: DataFrame | str, n_clusters: int | None = 10, embedder: ImageEmbedder | None = None, text_columns: Sequence[str] | None = None, id_col: str = "image_id", spark: SparkSession | None = None, **config) -> DataFrame:
    """A table, or its path, with embedding_text, embedding and cluster."""
    settings = ClusterConfig(n_clusters=n_clusters, **({"text_columns": tuple(text_columns)} if text_columns else {}), **config)
    clusterer = SemanticClusterer(embedder or ImageEmbedder(), settings, id_col=id_col)
    df = clusterer.build_embedding_text(_frame(spark, data))
    return clusterer.cluster(clusterer.embedded(df))


def analyze_spatial(df: DataFrame, column: str = "cluster", k_neighbors: int = 8, p_threshold: float = 0.05, id_col: str = "image_id") -> dict:
    """{"global": label -> MoranResult, "frame": df with the local statistics}; the graph is worked out once for both."""
    edges = cut(nearest_neighbours(df.where(f"`{column}` IS NOT NULL"), k_neighbors, id_col))
    return {
        "global": moran_results(moran_global(df, column, k_neighbors, id_col, edges=edges)),
        "frame": moran_local(df, column, p_threshold, k_neighbors, id_col, edges=edges),
    }


def build_search_index(data: DataFrame | str, path: str, embedder: ImageEmbedder | None = None, text_column: str = "scene_narrative", metadata_columns: Sequence[str] | None = None, id_column: str = "image_id", spark: SparkSession | None = None, **store) -> VectorDB:
    """A store at path with a vector for each row of a table or its path."""
    df = _frame(spark, data)
    db = VectorDB(VectorStore(df.sparkSession, path, **store), embedder or ImageEmbedder())
    db.build(df, text_column, metadata_columns, id_column)
    return db


def search_similar(db: VectorDB, query_text: str | None = None, query_image: str | None = None, n_results: int = 10) -> DataFrame:
    return db.search(query_text, query_image, n_results)
