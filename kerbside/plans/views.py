"""Views of the driver's tables as image points, scene descriptions and vectors; each with the same expression in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import ship

CENTER = {"lat": 41.0082, "lon": 28.9784}
STREET = [(28.9760, 41.0070), (28.9780, 41.0080), (28.9800, 41.0086)]
RING = [(28.972, 41.002), (28.988, 41.004), (28.980, 41.018)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "41.0D + ((c_custkey * 7919) % 20011) / 1000000.0D AS lat",
        "28.97D + ((c_custkey * 104729) % 20021) / 1000000.0D AS lon",
        "CAST(c_nationkey % 5 AS INT) AS cluster",
        "c_mktsegment AS land_use_primary",
        "c_acctbal AS balance",
    )


POINTS = """points AS (SELECT c_custkey AS id, 41.0::double + ((c_custkey * 7919) % 20011) / 1000000.0::double AS lat,
    28.97::double + ((c_custkey * 104729) % 20021) / 1000000.0::double AS lon, (c_nationkey % 5)::int AS cluster,
    c_mktsegment AS land_use_primary, c_acctbal AS balance FROM customer)"""

_TEXT = """CASE WHEN id % 17 = 0 THEN '{{bad'
    WHEN id % 7 = 0 THEN concat('```json', {nl}, body, {nl}, '```')
    WHEN id % 11 = 0 THEN concat('{{"scene_narrative": null, "image_quality": {{"usable_for_analysis": false}}, "semantic_tags": "', tag, '"}}')
    ELSE body END"""
_BODY = """concat('{{"scene_narrative": "Scene ', id, '", "semantic_tags": ["', tag, '", "street"]',
    CASE WHEN id % 5 = 0 THEN '' ELSE concat(', "land_use_character": {{"primary": "', tag, '"}}') END,
    ', "urban_morphology": {{"street_type": "', CASE WHEN id % 3 = 0 THEN 'local' ELSE 'arterial' END, '"}}}}')"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, answer): a model's answers, some fenced, some malformed, some with members missing or null."""
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "lower(c_mktsegment) AS tag").selectExpr("id", "tag", f"{_BODY.format()} AS body")
    return base.selectExpr("id", f"{_TEXT.format(nl='char(10)')} AS answer")


class RuleDescriber:
    """A describer whose answers are those of ``answers``, from a path <tag>/<id>.jpg."""

    def generate(self, images: Sequence[str], system: str, user: str) -> list[str]:
        out = []
        for path in images:
            tag, name = path.split("/")[-2:]
            i = int(name.split(".")[0])
            use = "" if i % 5 == 0 else f', "land_use_character": {{"primary": "{tag}"}}'
            body = f'{{"scene_narrative": "Scene {i}", "semantic_tags": ["{tag}", "street"]{use}, "urban_morphology": {{"street_type": "{"local" if i % 3 == 0 else "arterial"}"}}}}'
            bare = f'{{"scene_narrative": null, "image_quality": {{"usable_for_analysis": false}}, "semantic_tags": "{tag}"}}'
            out.append("{bad" if i % 17 == 0 else f"```json\n{body}\n```" if i % 7 == 0 else bare if i % 11 == 0 else body)
        return out


ANSWERS = f"""answers AS (SELECT id, {_TEXT.format(nl="chr(10)")} AS answer FROM (SELECT id, tag, {_BODY.format()} AS body
    FROM (SELECT c_custkey AS id, lower(c_mktsegment) AS tag FROM customer)))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, label): the vectors, stretched so that their lengths differ."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 3)).cast("float")).alias("embedding"), "label")


VECTORS = "vectors AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x * (1 + vec_id % 3))::float) AS embedding, label FROM embeddings)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, geometry): a box of its own for each nation."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_name AS name", "28.97D + n_nationkey / 1250.0D AS x", "41.0D AS y")
    corner = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    ring = F.array(corner(0.0, 0.0), corner(0.004, 0.0), corner(0.004, 0.01), corner(0.0, 0.01), corner(0.0, 0.0))
    return nation.select("name", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"))
