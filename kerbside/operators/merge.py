"""Joining descriptions, classifiers and perceptions to image metadata, and keeping track of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _without_conflicts(right: DataFrame, have: list[str], key: str) -> DataFrame:
    """right's columns that are not there already, and the key; names go without regard to case, as Spark resolves them."""
    there = {c.lower() for c in have}
    return right.select(F.col(f"`{key}`").cast("string").alias("_key"), *(f"`{c}`" for c in right.columns if c.lower() not in there and c != key))


def merge_metadata_and_descriptions(metadata: DataFrame, descriptions: DataFrame, on: str = "image_id") -> DataFrame:
    """metadata with the descriptions of its images. metadata wins where both have a column; several descriptions give several rows."""
    for what, df in (("metadata", metadata), ("descriptions", descriptions)):
        if on not in df.columns:
            raise ValueError(f"{what} has no column {on!r}")
    there = {c.lower() for c in metadata.columns}
    right = descriptions.select(F.col(f"`{on}`").alias("_key"), *(f"`{c}`" for c in descriptions.columns if c.lower() not in there))
    return metadata.join(right, metadata[f"`{on}`"].eqNullSafe(right["_key"]), "left").drop("_key")


def merge_data_sources(metadata: DataFrame, descriptions: DataFrame | None = None, classifiers: DataFrame | None = None, perceptions: DataFrame | None = None, merge_on: str = "image_id") -> DataFrame:
    """metadata with up to three sources, left-joined on merge_on as text. Null keys match each other; earlier columns win."""
    out = metadata.withColumn(merge_on, F.col(f"`{merge_on}`").cast("string"))
    for source in (descriptions, classifiers, perceptions):
        if source is not None:
            right = _without_conflicts(source, out.columns, merge_on)
            out = out.join(right, out[f"`{merge_on}`"].eqNullSafe(right["_key"]), "left").drop("_key")
    return out


def not_done(df: DataFrame, done: DataFrame, on: str = "image_id") -> DataFrame:
    """Rows whose id has no row in done."""
    return df.join(done.select(on).distinct(), on, "left_anti")


def selected(df: DataFrame, chosen: DataFrame, on: str = "image_id") -> DataFrame:
    """Rows whose id is among the chosen."""
    return df.join(chosen.select(on), on, "left_semi")


def appended(*batches: DataFrame) -> DataFrame:
    """All rows of all batches; columns that one lacks are null there."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out
