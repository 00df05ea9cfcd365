"""Counts and distributions of label columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.text import percent, split_tags

CATEGORIES = ("land_use_primary", "street_type", "place_character")
DISTANCES = ("distance_to_query_m", "distance_to_line_m", "distance_along_line_m", "distance_to_centroid_m")


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, size, pct) of each label that is not null; pct is of all rows with a label."""
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"))
    # Only one row a label reaches this window, so that one partition is no bottleneck.
    return sizes.withColumn("pct", percent(F.col("size"), F.sum("size").over(Window.partitionBy(F.lit(0)))))


def _long(df: DataFrame, columns: list[str], cluster: str | None = None) -> DataFrame:
    """(cluster, column, value): the label columns one below the other, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("p")
    keys = [F.col(cluster).alias("cluster")] if cluster else []
    return df.select(*keys, pairs).select(*(["cluster"] if cluster else []), "p.column", "p.value")


def category_profile(df: DataFrame, columns: list[str] | None = None, cluster: str = "cluster") -> DataFrame:
    """(cluster, size, column, top, pct): the commonest value of each column in each cluster.

    pct is of the whole cluster, nulls included. Ties go to the least value. Columns that df lacks, and columns without
    a value in a cluster, give no row.
    """
    columns = [c for c in (columns or CATEGORIES) if c in df.columns]
    known = df.where(F.col(cluster).isNotNull())
    if not columns:
        return known.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size")).where("false").select("cluster", "size", F.lit("").alias("column"), F.lit("").alias("top"), F.lit(0.0).alias("pct"))
    counts = _long(known, columns, cluster).groupBy("cluster", "column", "value").agg(F.count("*").alias("n"))
    sized = counts.groupBy("cluster", "column").agg(F.sum("n").alias("size"), F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value"))).alias("best"))
    return sized.where("best IS NOT NULL").select("cluster", "size", "column", F.col("best.value").alias("top"), percent(-F.col("best.n"), F.col("size")).alias("pct"))


def crosstab_percent(df: DataFrame, column: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, value, pct): how the column is distributed in each cluster; rows without either do not count."""
    counts = df.select(F.col(cluster).alias("cluster"), F.col(column).cast("string").alias("value")).dropna().groupBy("cluster", "value").agg(F.count("*").alias("n"))
    return counts.select("cluster", "value", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("cluster"))).alias("pct"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) of the label columns that df has, nulls aside."""
    columns = [c for c in (columns or CATEGORIES) if c in df.columns]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    return _long(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("count"))


def number_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max, mean, median) of the distance columns that df has; medians are exact. One pass over the rows."""
    columns = [c for c in (columns or DISTANCES) if c in df.columns]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, min double, max double, mean double, median double")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns))).alias("p")
    long = df.select(pairs).select("p.column", "p.x").where("x IS NOT NULL AND NOT isnan(x)")
    return long.groupBy("column").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.median("x").alias("median"))


def tag_counts(df: DataFrame, tags: str = "semantic_tags", n: int | None = 15) -> DataFrame:
    """(tag, count) of the n commonest tags of comma-separated lists, ties by tag; all of them with n None."""
    counts = df.select(F.explode(split_tags(F.col(tags))).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
    return counts if n is None else counts.orderBy(F.desc("count"), "tag").limit(n)
