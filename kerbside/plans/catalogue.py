"""Every query by name, with the SQL that must give the same rows. Each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geo, text, vectors
from kerbside.operators import clustering, keywords, merge, moran, neighbours, summaries, vector_store
from kerbside.operators.spatial_query import BBoxQuery, LineQuery, PlaceQuery, PointQuery, PolygonQuery, captured_between
from kerbside.plans import report, views, workflows
from kerbside.providers import ImageDescriber, ImageEmbedder, register
from kerbside.session import checkpoint_dir, cut
from kerbside.sources.images import FrameSource, ImageDownloader, gazetteer
from kerbside.sources.tables import feature, load_geoparquet, load_results, save_geoparquet, to_points
from kerbside.streaming.ingest import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Distances are rounded, as the engines' sines differ in the last bits; + 0.0 turns -0.0 into 0.0.
def _r(c, digits: int = 3):
    return F.round(c, digits) + F.lit(0.0)


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371008.8::double * asin(sqrt(least(1.0::double, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"


_C = f"{views.CENTER['lat']}::double", f"{views.CENTER['lon']}::double"
_TO_CENTER = _hav("lat", "lon", *_C)
_NEAR = f"WITH {views.POINTS}, near AS (SELECT *, round({_TO_CENTER}, 3) AS d FROM points)"

# Spatial queries


@query(f"{_NEAR} SELECT id, d AS distance_to_query_m FROM near WHERE d <= 500")
def point_radius(spark, sf_dir):
    q = PointQuery(**views.CENTER, buffer_m=500)
    return q.add_distances(q.select_from(views.points(spark, sf_dir))).select("id", _r(F.col("distance_to_query_m")).alias("distance_to_query_m"))


@query(f"{_NEAR} SELECT id, d AS distance_to_query_m FROM near ORDER BY d, id LIMIT 1")
def point_nearest(spark, sf_dir):
    q = PointQuery(**views.CENTER, nearest_only=True)
    return q.filter_nearest(views.points(spark, sf_dir), "id").select("id", _r(F.col("distance_to_query_m")).alias("distance_to_query_m"))


@query(f"{_NEAR} SELECT id, d AS distance_to_query_m FROM near WHERE d <= 500 ORDER BY d, id LIMIT 10")
def point_topk(spark, sf_dir):
    q = PointQuery(**views.CENTER, buffer_m=500)
    return q.nearest(q.select_from(views.points(spark, sf_dir)), 10, "id").select("id", _r(F.col("distance_to_query_m")).alias("distance_to_query_m"))


@query(f"WITH {views.POINTS} SELECT id, lat, lon FROM points WHERE lon > 28.975 AND lon < 28.985 AND lat > 41.005 AND lat < 41.015")
def bbox_filter(spark, sf_dir):
    return BBoxQuery(minx=28.975, miny=41.005, maxx=28.985, maxy=41.015).select_from(views.points(spark, sf_dir)).select("id", "lat", "lon")


def _ring_sql() -> str:
    tests = []
    for (x1, y1), (x2, y2) in zip(views.RING, [*views.RING[1:], views.RING[0]], strict=True):
        tests.append(f"(CASE WHEN ({y1}::double > lat) <> ({y2}::double > lat) AND lon < {x1}::double + (lat - {y1}::double) * ({x2}::double - {x1}::double) / ({y2}::double - {y1}::double) THEN 1 ELSE 0 END)")
    return f"({' + '.join(tests)}) % 2 = 1"


@query(f"WITH {views.POINTS} SELECT id FROM points WHERE {_ring_sql()}")
def polygon_within(spark, sf_dir):
    return PolygonQuery(geometry=views.RING).select_from(views.points(spark, sf_dir)).select("id")


_CX, _CY = geo.centroid([views.RING])


@query(f"WITH {views.POINTS} SELECT id, round({_hav('lat', 'lon', f'{_CY!r}::double', f'{_CX!r}::double')}, 3) AS distance_to_centroid_m, {_ring_sql()} AS inside_query FROM points")
def centroid_distance(spark, sf_dir):
    found = PolygonQuery(geometry=views.RING).add_distances(views.points(spark, sf_dir))
    return found.select("id", _r(F.col("distance_to_centroid_m")).alias("distance_to_centroid_m"), "inside_query")


_HOLE = [(28.978, 41.006), (28.983, 41.0065), (28.980, 41.011)]  # wound as the ring is
_CORNERS = ", ".join(f"({r}, {k}, {x}::double, {y}::double)" for r, ring in enumerate((views.RING, _HOLE)) for k, (x, y) in enumerate(ring))


@query(f"""WITH {views.POINTS}, corner(ring, k, x, y) AS (VALUES {_CORNERS}),
    side AS (SELECT ring, x - 28.98 AS x, y - 41.0 AS y, coalesce(lead(x) OVER w, first(x) OVER w) - 28.98 AS x2, coalesce(lead(y) OVER w, first(y) OVER w) - 41.0 AS y2 FROM corner WINDOW w AS (PARTITION BY ring ORDER BY k)),
    part AS (SELECT ring, sum(x * y2 - x2 * y) AS a, sum((x + x2) * (x * y2 - x2 * y)) AS mx, sum((y + y2) * (x * y2 - x2 * y)) AS my FROM side GROUP BY ring),
    whole AS (SELECT sum(s * a) AS a, sum(s * mx) AS mx, sum(s * my) AS my FROM (SELECT *, sign(a) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS s FROM part)),
    c AS (SELECT 28.98 + mx / (3 * a) AS cx, 41.0 + my / (3 * a) AS cy FROM whole)
    SELECT id, round({_hav("lat", "lon", "cy", "cx")}, 3) AS distance_to_centroid_m FROM points, c""")
def centroid_hole(spark, sf_dir):
    """The distance to the centroid of a ring with a hole that is wound like it."""
    found = PolygonQuery(geometry=[views.RING, _HOLE]).add_distances(views.points(spark, sf_dir))
    return found.select("id", _r(F.col("distance_to_centroid_m")).alias("distance_to_centroid_m"))


_SEGMENTS = ", ".join(f"({k}, {x1}::double, {y1}::double, {x2}::double, {y2}::double, {a!r}::double)" for k, (x1, y1, x2, y2, a) in enumerate(geo.segments([views.STREET])))
_LINE = f"""WITH {views.POINTS}, seg(k, x1, y1, x2, y2, before) AS (VALUES {_SEGMENTS}),
    t AS (SELECT *, greatest(0.0::double, least(1.0::double, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM points, seg),
    on_it AS (SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM t),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (lon - px) * (lon - px) + (lat - py) * (lat - py), k) AS r FROM on_it),
    line AS (SELECT id, round({_hav("lat", "lon", "py", "px")}, 3) AS distance_to_line_m, round(before + {_hav("y1", "x1", "py", "px")}, 3) AS distance_along_line_m FROM best WHERE r = 1)"""


@query(f"{_LINE} SELECT * FROM line")
def line_distance(spark, sf_dir):
    found = LineQuery(geometry=views.STREET).add_distances(views.points(spark, sf_dir))
    return found.select("id", *(_r(F.col(c)).alias(c) for c in ("distance_to_line_m", "distance_along_line_m")))


@query(f"{_LINE} SELECT id, distance_to_line_m FROM line WHERE distance_to_line_m <= 120")
def line_buffer(spark, sf_dir):
    q = LineQuery(geometry=views.STREET, buffer_m=120)
    return q.add_distances(q.select_from(views.points(spark, sf_dir))).select("id", _r(F.col("distance_to_line_m")).alias("distance_to_line_m"))


_AROUND = _LINE.replace(_SEGMENTS, ", ".join(f"({k}, {x1}::double, {y1}::double, {x2}::double, {y2}::double, {a!r}::double)" for k, (x1, y1, x2, y2, a) in enumerate(geo.segments([[*views.RING, views.RING[0]]]))))


@query(f"{_AROUND} SELECT id FROM line WHERE distance_to_line_m <= 150 UNION SELECT id FROM points WHERE {_ring_sql()}")
def polygon_buffer(spark, sf_dir):
    """Points within a polygon or 150 m of its edge."""
    return PolygonQuery(geometry=views.RING, buffer_m=150).select_from(views.points(spark, sf_dir)).select("id")


@query(f"""WITH {views.POINTS}, box AS (SELECT 28.97::double + n_nationkey / 1250.0::double AS x FROM nation WHERE n_name = (SELECT min(n_name) FROM nation))
    SELECT id FROM points, box WHERE lon > x AND lon < x + 0.004 AND lat > 41.0 AND lat < 41.0 + 0.01""")
def place_lookup(spark, sf_dir):
    places = views.places(spark, sf_dir)
    name = places.agg(F.min("name")).first()[0]
    return PlaceQuery(place_name=name, geocoder=gazetteer(places)).select_from(views.points(spark, sf_dir)).select("id")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT min(ts)::date FROM events) + INTERVAL 1 DAY AND ts < (SELECT min(ts)::date FROM events) + INTERVAL 4 DAY")
def captured_range(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    first, last = events.agg(F.to_date(F.min("ts")) + F.expr("INTERVAL 1 DAY"), F.to_date(F.min("ts")) + F.expr("INTERVAL 3 DAY")).first()
    return captured_between(events, str(first)[:10], str(last)[:10], "ts").select("event_id", "ts")


# Sources, merging, summaries


@query("SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR c_nationkey IN (3, 4)")
def load_filter_project(spark, sf_dir):
    return load_results(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_acctbal"], [[("c_acctbal", ">", 5000.0), ("c_mktsegment", "==", "BUILDING")], [("c_nationkey", "in", [3, 4])]])


def _shared(spark, name: str) -> str:
    """A new folder in the cluster's shared one, removed when the application ends."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@query(f"WITH {views.POINTS} SELECT id, lat, lon, land_use_primary FROM points")
def geoparquet_round_trip(spark, sf_dir):
    """Points written as GeoParquet and read again, their coordinates from the geometry."""
    made = to_points(views.points(spark, sf_dir)).drop("lat", "lon")
    return load_geoparquet(spark, save_geoparquet(made, f"{_shared(spark, 'points')}/points.parquet")).select("id", "lat", "lon", "land_use_primary")


@query(f"""{_NEAR} SELECT 'distance_to_query_m' AS "column", round(min(d), 3) AS "min", round(max(d), 3) AS "max", round(avg(d), 3) AS mean, round(median(d), 3) AS median FROM near""")
def summary_stats(spark, sf_dir):
    found = PointQuery(**views.CENTER).add_distances(views.points(spark, sf_dir)).withColumn("distance_to_query_m", _r(F.col("distance_to_query_m")))
    return summaries.number_summary(found).select("column", *(_r(F.col(c)).alias(c) for c in ("min", "max", "mean", "median")))


@query("""SELECT 'lang' AS "column", lang AS value, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source""")
def category_distribution(spark, sf_dir):
    return summaries.value_counts(views.table(spark, sf_dir, "documents"), ["lang", "source"])


@query(f"WITH {views.POINTS} SELECT id, '0101000000' AS head, 21 AS size, lat, lon FROM points")
def wkb_points(spark, sf_dir):
    made = to_points(views.points(spark, sf_dir))
    lon, lat = geo.point_of_wkb(F.col("geometry"))
    return made.select("id", F.hex(F.substring("geometry", 1, 5)).alias("head"), F.octet_length("geometry").alias("size"), lat.alias("lat"), lon.alias("lon"))


@query(f"WITH {views.POINTS} SELECT id, lat, lon, land_use_primary, 'Point' AS kind FROM points")
def geojson_features(spark, sf_dir):
    lines = views.points(spark, sf_dir).select("id", "lat", "lon", "land_use_primary").select(feature(views.points(spark, sf_dir).select("id", "lat", "lon", "land_use_primary")).alias("line"))
    schema = "geometry struct<type: string, coordinates: array<double>>, properties struct<id: bigint, land_use_primary: string>"
    f = lines.select(F.from_json("line", schema).alias("f"))
    return f.select("f.properties.id", F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), "f.properties.land_use_primary", F.col("f.geometry.type").alias("kind"))


def _as_images(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_id", "image_id")


@query("SELECT d.doc_id AS image_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id")
def left_merge(spark, sf_dir):
    docs, labels = _as_images(views.table(spark, sf_dir, "documents").select("doc_id", "lang")), _as_images(views.table(spark, sf_dir, "labels"))
    return merge.merge_metadata_and_descriptions(docs, labels).select("image_id", "lang", "quality", "toxic")


@query("""SELECT d.doc_id::varchar AS image_id, d.lang, l.quality, o.n_chars, l.toxic FROM documents d
    LEFT JOIN labels l ON d.doc_id::varchar IS NOT DISTINCT FROM l.doc_id::varchar LEFT JOIN documents o ON d.doc_id::varchar IS NOT DISTINCT FROM o.doc_id::varchar""")
def multi_merge(spark, sf_dir):
    docs, labels = _as_images(views.table(spark, sf_dir, "documents")), _as_images(views.table(spark, sf_dir, "labels"))
    merged = merge.merge_data_sources(docs.select("image_id", "lang"), labels.select("image_id", "quality"), docs.select("image_id", "n_chars", "lang"), labels.select("image_id", "toxic", "quality"))
    return merged.select("image_id", "lang", "quality", "n_chars", "toxic")


@query("SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return merge.not_done(_as_images(views.table(spark, sf_dir, "documents").select("doc_id")), _as_images(views.table(spark, sf_dir, "labels").select("doc_id")))


@query("SELECT doc_id AS image_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_semi(spark, sf_dir):
    return merge.selected(_as_images(views.table(spark, sf_dir, "documents").select("doc_id", "source")), _as_images(views.table(spark, sf_dir, "labels").where("quality = 1")))


@query("SELECT doc_id, lang, NULL::int AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def append_union(spark, sf_dir):
    return merge.appended(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), views.table(spark, sf_dir, "labels").select("doc_id", "quality"))


# Text


_UNFENCED = "regexp_replace(regexp_replace(answer, '^```json\\n', ''), '\\n```$', '')"
_JSON = f"j AS (SELECT id, CASE WHEN json_valid({_UNFENCED}) THEN {_UNFENCED}::json END AS j FROM answers)"
_SCENE = """SELECT id, j IS NULL AS parse_error, CASE WHEN j IS NULL THEN '' WHEN json_exists(j, '$.scene_narrative') THEN j->>'$.scene_narrative' ELSE '' END AS scene_narrative,
    CASE WHEN j IS NULL THEN '' WHEN json_type(j->'$.semantic_tags') = 'ARRAY' THEN array_to_string((j->'$.semantic_tags')::varchar[], ',') ELSE coalesce(j->>'$.semantic_tags', '') END AS semantic_tags,
    CASE WHEN j IS NULL THEN 'error' ELSE coalesce(j->>'$.land_use_character.primary', 'unknown') END AS land_use_primary,
    CASE WHEN j IS NULL THEN 'error' ELSE coalesce(j->>'$.urban_morphology.street_type', 'unknown') END AS street_type,
    j IS NOT NULL AND coalesce((j->>'$.image_quality.usable_for_analysis')::boolean, true) AS usable FROM j"""


@query(f"WITH {views.ANSWERS}, {_JSON} {_SCENE}")
def json_fields(spark, sf_dir):
    return text.with_scene_fields(views.answers(spark, sf_dir), "answer").select("id", "parse_error", "scene_narrative", "semantic_tags", "land_use_primary", "street_type", "usable")


@query(f"""WITH {views.ANSWERS} SELECT id, CASE WHEN id % 17 = 0 OR id % 7 = 0 THEN answer WHEN id % 11 = 0 THEN NULL ELSE 'Scene ' || id END AS description FROM answers""")
def parse_fallback(spark, sf_dir):
    return views.answers(spark, sf_dir).select("id", text.parse_description(F.col("answer")).alias("description"))


@query("SELECT event_id, replace(props, ' ', '') AS description FROM events")
def parse_plain_object(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", text.parse_description(F.col("props")).alias("description"))


@query("SELECT page_id, nullif(regexp_extract(url, '(\\d+)\\.\\w+$', 1), '') AS image_id, regexp_extract(url || '/p' || page_id || '.v2.jpg', '([^/]*)\\.jpg$', 1) AS stem FROM pages")
def extract_id(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", text.extract_image_id(F.col("url")).alias("image_id"), text.file_stem(F.concat("url", F.lit("/p"), "page_id", F.lit(".v2.jpg"))).alias("stem"))


@query("SELECT doc_id, md5(concat_ws(' | ', nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ''), nullif(trim(lang), ''), nullif(trim(source), ''))) AS composed FROM documents")
def compose_text(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.compose_text(docs, ["text", "missing", "lang", "source"])).alias("composed"))


@query(f"""WITH {views.ANSWERS}, {_JSON}, s AS ({_SCENE}) SELECT trim(tag) AS tag, count(*) AS count FROM (SELECT unnest(string_split(semantic_tags, ',')) AS tag FROM s) WHERE trim(tag) <> '' GROUP BY 1""")
def tag_counts(spark, sf_dir):
    return summaries.tag_counts(text.with_scene_fields(views.answers(spark, sf_dir), "answer"), n=None)


# Clusters


@query("SELECT lang AS cluster, count(*) AS size, round_even(count(*) * 100.0::double / sum(count(*)) OVER (), 1) AS pct FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def cluster_sizes(spark, sf_dir):
    return summaries.cluster_sizes(views.table(spark, sf_dir, "documents"), "lang")


@query("""WITH c AS (SELECT p_brand AS cluster, p_type AS v, count(*) AS n FROM part GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS r, sum(n) OVER (PARTITION BY cluster) AS size FROM c)
    SELECT cluster, size::bigint AS size, 'p_type' AS "column", v AS top, round_even(n * 100.0::double / size, 1) AS pct FROM r WHERE r = 1""")
def category_profile(spark, sf_dir):
    return summaries.category_profile(views.table(spark, sf_dir, "part"), ["p_type", "absent"], "p_brand")


@query("SELECT lang AS cluster, source AS value, round(count(*) * 100.0::double / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source")
def crosstab_pct(spark, sf_dir):
    found = summaries.crosstab_percent(views.table(spark, sf_dir, "documents"), "source", "lang")
    return found.select("cluster", "value", F.round("pct", 6).alias("pct"))


def _keywords_sql(bigrams: bool) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(keywords.ENGLISH | keywords.STREET_SCENE))
    pairs = "|| list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])" if bigrams else ""
    return rf"""WITH d AS (SELECT lang AS cluster, doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\pL\pN\pM_]{{2,}}'), lambda x: x NOT IN ({stop})) AS w FROM documents WHERE lang IS NOT NULL),
        n AS (SELECT cluster, count(*) AS docs FROM d GROUP BY 1),
        t AS (SELECT cluster, id, unnest(w {pairs}) AS term FROM d), c AS (SELECT cluster, id, term, count(*) AS tf FROM t GROUP BY ALL),
        v AS (SELECT cluster, term, count(*) AS df, sum(tf) AS total FROM c GROUP BY ALL),
        f AS (SELECT v.cluster, term, docs, ln((1.0::double + docs) / (1.0::double + df)) + 1 AS idf, row_number() OVER (PARTITION BY v.cluster ORDER BY total DESC, term) AS r FROM v JOIN n USING (cluster) WHERE df >= greatest(3, docs // 50)),
        w AS (SELECT c.cluster, id, c.term, docs, tf * idf AS w FROM c JOIN f ON c.cluster = f.cluster AND c.term = f.term WHERE r <= 1000),
        l AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY cluster, id)) AS x FROM w),
        s AS (SELECT cluster, term, sum(x) / any_value(docs) AS score FROM l GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 10) DESC, term DESC) AS rank FROM s)
        SELECT cluster, rank::int AS rank, term, round(score, 8) AS score FROM b WHERE rank <= 10"""


def _keywords(spark, sf_dir, bigrams):
    found = keywords.extract_keywords(views.table(spark, sf_dir, "documents"), text="text", cluster="lang", id_col="doc_id", bigrams=bigrams)
    return found.withColumn("score", F.round("score", 8))


@query(_keywords_sql(False))
def keywords_tfidf(spark, sf_dir):
    return _keywords(spark, sf_dir, False)


@query(_keywords_sql(True))
def keywords_bigrams(spark, sf_dir):
    return _keywords(spark, sf_dir, True)


# Spatial statistics


_EDGES = f"""{views.POINTS}, far AS (SELECT a.id, b.id AS nbr_id, (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) AS d FROM points a, points b WHERE a.id <> b.id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr_id) AS rank FROM far),
    edges AS (SELECT id, nbr_id, rank, 1.0::double / count(*) OVER (PARTITION BY id) AS w FROM ranked WHERE rank <= 8)"""


@query(f"WITH {_EDGES} SELECT id, nbr_id, rank::int AS rank, w FROM edges")
def knn_weights(spark, sf_dir):
    return neighbours.nearest_neighbours(views.points(spark, sf_dir), 8)


_PAIRS = """lab AS (SELECT id, cluster AS label FROM points), n AS (SELECT count(*)::double AS n FROM lab), m AS (SELECT label, count(*) AS m FROM lab GROUP BY 1),
    pairs AS (SELECT a.label, b.label AS other, sum(w) AS w FROM edges e JOIN lab a ON e.id = a.id JOIN lab b ON e.nbr_id = b.id GROUP BY ALL)"""
_TAIL = "1 / (1 + 0.2316419::double * abs(z))"


@query(f"""WITH {_EDGES}, {_PAIRS},
    s AS (SELECT sum(e.w) AS s0, sum(e.w * e.w) + sum(e.w * coalesce(b.w, 0)) AS s1 FROM edges e LEFT JOIN edges b ON e.id = b.nbr_id AND e.nbr_id = b.id),
    s2 AS (SELECT sum(power(coalesce(r, 0) + coalesce(c, 0), 2)) AS s2 FROM (SELECT id, sum(w) AS r FROM edges GROUP BY 1) x FULL JOIN (SELECT nbr_id AS id, sum(w) AS c FROM edges GROUP BY 1) y USING (id)),
    i AS (SELECT m.label, m.m, n.n, s0, s1, s2, m.m / n.n AS p, (coalesce((SELECT w FROM pairs WHERE label = m.label AND other = m.label), 0)
        - m.m / n.n * coalesce((SELECT sum(w) FROM pairs WHERE other = m.label), 0)) / (n.n * (m.m / n.n) * (1 - m.m / n.n)) * n.n / s0 AS i FROM m, n, s, s2),
    v AS (SELECT *, -1 / (n - 1) AS e, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - (1 - 3 * p * (1 - p)) / (p * (1 - p)) * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0))
        / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS v FROM i),
    z AS (SELECT *, (i - e) / sqrt(v) AS z FROM v), t AS (SELECT *, {_TAIL} AS t FROM z)
    SELECT label, m AS n, round(i, 8) + 0.0::double AS i, round(e, 8) AS expected_i, round(z, 6) + 0.0::double AS z_score,
        round((999 * exp(-z * z / 2) * 0.3989422804014327::double * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))) + 1) / 1000, 6) AS p_value FROM t""")
def moran_global(spark, sf_dir):
    found = moran.moran_global(views.points(spark, sf_dir))
    return found.select("label", "n", _r(F.col("i"), 8).alias("i"), F.round("expected_i", 8).alias("expected_i"), _r(F.col("z_score"), 6).alias("z_score"), F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {_EDGES}, {_PAIRS},
    same AS (SELECT e.id, any_value(a.label) AS label, count(*) FILTER (a.label = b.label) AS x FROM edges e JOIN lab a ON e.id = a.id JOIN lab b ON e.nbr_id = b.id GROUP BY e.id),
    cases AS (SELECT DISTINCT label, x, m, n FROM same JOIN m USING (label), n),
    mass AS (SELECT label, x, m, n, j, factorial(8) / factorial(j::int) / factorial((8 - j)::int) * list_product([CASE WHEN i < j THEN (m - 1 - i)::double ELSE n - m - (i - j) END / (n - 1 - i) for i in range(8)]) AS q FROM cases, range(9) r(j)),
    tails AS (SELECT label, x, m, n, sum(q) FILTER (j >= x) AS hi, coalesce(sum(q) FILTER (j < x), 0) AS lo FROM mass GROUP BY ALL),
    p AS (SELECT label, x, (999 * least(hi, lo, 0.5) + 1) / 1000 AS p, CASE WHEN x / 8.0::double > m / n THEN 1 ELSE 4 END AS q FROM tails)
    SELECT id, CASE WHEN p < 0.05 THEN q ELSE 0 END AS lisa_cluster, round(p, 8) AS lisa_p_value, p < 0.05 AS lisa_significant FROM same JOIN p USING (label, x)""")
def moran_local(spark, sf_dir):
    return moran.moran_local(views.points(spark, sf_dir)).select("id", "lisa_cluster", F.round("lisa_p_value", 8).alias("lisa_p_value"), "lisa_significant")


@query(f"""WITH {_EDGES}, {_PAIRS}, rounds AS (SELECT r AS round FROM range(1000) t(r)),
    h AS (SELECT round, id, row_number() OVER (PARTITION BY round ORDER BY CASE WHEN round = 0 THEN '' ELSE md5(id::varchar || '|' || round::varchar) END, id) AS a FROM lab, rounds),
    l AS (SELECT round, label, row_number() OVER (PARTITION BY round ORDER BY id) AS a FROM lab, rounds),
    dealt AS (SELECT round, id, label FROM h JOIN l USING (round, a)),
    pr AS (SELECT x.round, x.label, y.label AS other, sum(w) AS w FROM edges e JOIN dealt x ON e.id = x.id JOIN dealt y ON e.nbr_id = y.id AND x.round = y.round GROUP BY ALL),
    i AS (SELECT r.round, m.label, round((coalesce((SELECT w FROM pr WHERE pr.round = r.round AND pr.label = m.label AND pr.other = m.label), 0)
        - m.m / n.n * coalesce((SELECT sum(w) FROM pr WHERE pr.round = r.round AND pr.other = m.label), 0)) / (n.n * (m.m / n.n) * (1 - m.m / n.n)), 10) AS i FROM m, n, rounds r)
    SELECT a.label, round(any_value(b.i), 8) AS i, count(*) FILTER (a.i >= b.i) AS larger, round((least(count(*) FILTER (a.i >= b.i), 999 - count(*) FILTER (a.i >= b.i)) + 1) / 1000.0::double, 6) AS p_value
    FROM i a JOIN i b ON a.label = b.label AND b.round = 0 WHERE a.round > 0 GROUP BY a.label""")
def moran_perm_p(spark, sf_dir):
    found = moran.moran_permutations(views.points(spark, sf_dir), permutations=999)
    return found.select("label", F.round("i", 8).alias("i"), "larger", F.round("p_value", 6).alias("p_value"))


# Vectors

_PROBE = list(np.cos(np.arange(64) * 0.7).round(4))
_PROBE_SQL = f"[{', '.join(f'{x}::double' for x in _PROBE)}]"
_DOT = "list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::double * x[2]))"
_DISTANCE_SQL = {
    "ip": _DOT,
    "l2": "list_sum(list_transform(list_zip(embedding, q), lambda x: power(x[1]::double - x[2], 2)))",
    "cosine": f"1 - {_DOT} / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) * list_sum(list_transform(q, lambda x: x * x)))",
}


def _topk_sql(metric: str) -> str:
    return f"WITH {views.VECTORS}, d AS (SELECT id, label, round({_DISTANCE_SQL[metric]}, 6) + 0.0::double AS distance FROM vectors, (SELECT {_PROBE_SQL} AS q)) SELECT * FROM d ORDER BY distance {'DESC' if metric == 'ip' else ''}, id LIMIT 10"


def _topk(spark, sf_dir, metric):
    return vector_store.top_k(views.vectors(spark, sf_dir), _PROBE, 10, metric).select("id", "label", _r(F.col("distance"), 6).alias("distance"))


@query(_topk_sql("ip"))
def vector_topk_ip(spark, sf_dir):
    return _topk(spark, sf_dir, "ip")


@query(_topk_sql("l2"))
def vector_topk_l2(spark, sf_dir):
    return _topk(spark, sf_dir, "l2")


@query(_topk_sql("cosine"))
def vector_topk_cosine(spark, sf_dir):
    return _topk(spark, sf_dir, "cosine")


@query(f"""WITH {views.VECTORS}, d AS (SELECT a.id AS query_id, b.id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double))
    / sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))), 6) + 0.0::double AS distance FROM vectors a, vectors b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, rank::int AS rank, distance FROM r WHERE rank <= 5""")
def vector_join(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vector_store.top_k_join(v, v.select(F.col("id").alias("query_id"), "embedding"), 5, "cosine").select("query_id", "id", "rank", _r(F.col("distance"), 6).alias("distance"))


@query(f"WITH {views.VECTORS} SELECT id, CASE WHEN id % 4 = 0 THEN label + 100 ELSE label END AS label FROM vectors UNION ALL SELECT id + 1000000, label + 100 FROM vectors WHERE id % 4 = 0")
def vector_upsert(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    some = v.where("id % 4 = 0").withColumn("label", F.col("label") + 100)
    return vector_store.upserted(v, some.unionByName(some.withColumn("id", F.col("id") + 1000000))).select("id", "label")


@query(f"WITH {views.VECTORS} SELECT id, label FROM vectors WHERE label <> 3")
def vector_delete(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    return vector_store.without(v, v.where("label = 3").select("id")).select("id", "label")


@query(f"""WITH {views.VECTORS}, n AS (SELECT id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) AS u FROM vectors)
    SELECT id, round(u[1], 6) + 0.0::double AS head, round(sqrt(list_sum(list_transform(u, lambda y: y * y))), 6) AS size FROM n""")
def l2_normalize(spark, sf_dir):
    u = views.vectors(spark, sf_dir).select("id", vectors.normalized(F.col("embedding")).alias("u"))
    return u.select("id", _r(F.col("u")[0], 6).alias("head"), F.round(vectors.norm(F.col("u")), 6).alias("size"))


_CENTROIDS = [list(np.cos(np.arange(64) * (k + 1) * 0.3).round(4) / 8) for k in range(10)]
_CENTROIDS_SQL = f"c(k, q) AS (VALUES {', '.join(f'({k}, [' + ', '.join(f'{float(x)!r}::double' for x in c) + '])' for k, c in enumerate(_CENTROIDS))})"
_ASSIGN = f"near AS (SELECT id, label, embedding, k, round({_DISTANCE_SQL['l2']}, 9) AS d FROM vectors, c), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM near)"


@query(f"WITH {views.VECTORS}, {_CENTROIDS_SQL}, {_ASSIGN} SELECT id, k::int AS cluster FROM best WHERE r = 1")
def centroid_assign(spark, sf_dir):
    return views.vectors(spark, sf_dir).select("id", clustering.nearest_centroid(F.col("embedding"), np.array(_CENTROIDS))["cluster"].alias("cluster"))


def _cell_sql() -> str:
    cells = vector_store.probed(_PROBE, _CENTROIDS, 3, "l2")
    return f"""WITH {views.VECTORS}, {_CENTROIDS_SQL}, {_ASSIGN}, inside AS (SELECT id, k, embedding FROM best WHERE r = 1 AND k IN ({", ".join(str(int(c)) for c in cells)}))
        SELECT id, k::int AS cell, round({_DISTANCE_SQL["l2"]}, 6) AS distance FROM inside, (SELECT {_PROBE_SQL} AS q) ORDER BY distance, id LIMIT 10"""


@query(_cell_sql())
def cell_probe(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumn("cell", clustering.nearest_centroid(F.col("embedding"), np.array(_CENTROIDS))["cluster"])
    return vector_store.cell_probe(v, _PROBE, _CENTROIDS, 10, 3, "l2").select("id", "cell", F.round("distance", 6).alias("distance"))


@query(_topk_sql("cosine"))
def cell_search(spark, sf_dir):
    """Cells of trained centroids, few of which are probed before bounds rule out others: the rows of an exact search."""
    v = views.vectors(spark, sf_dir)
    centroids, _ = clustering.fit_kmeans(v.select(vector_store.in_cell_space(F.col("embedding"), "cosine").alias("embedding")), 10, seeds=(42,), max_iter=20)
    v = cut(v.withColumn("cell", clustering.nearest_centroid(vector_store.in_cell_space(F.col("embedding"), "cosine"), centroids)["cluster"]))
    found = vector_store.cell_search(v, _PROBE, centroids, vector_store.cell_radii(v, centroids, "cosine"), 10, 3, "cosine")
    return found.select("id", "label", _r(F.col("distance"), 6).alias("distance"))


def _lloyd_sql(k: int, steps: int, last: str) -> str:
    parts = [views.VECTORS, f"x AS (SELECT id, unnest(range(64)) AS pos, unnest(embedding)::double AS v FROM vectors)", f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, list_transform(embedding, lambda y: y::double) AS q FROM vectors ORDER BY id LIMIT {k})"]
    for s in range(steps + 1):
        parts.append(f"n{s} AS (SELECT id, k, round({_DISTANCE_SQL['l2']}, 9) AS d FROM vectors, c{s}), a{s} AS (SELECT id, k, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM n{s}) WHERE r = 1)")
        if s < steps:
            parts.append(f"m{s} AS (SELECT k, list(v ORDER BY pos) AS q FROM (SELECT k, pos, round(avg(v), 9) AS v FROM a{s} JOIN x USING (id) GROUP BY k, pos) GROUP BY k)")
            parts.append(f"c{s + 1} AS (SELECT c{s}.k, coalesce(m{s}.q, c{s}.q) AS q FROM c{s} LEFT JOIN m{s} USING (k))")
    return f"WITH {', '.join(parts)} {last}"


@query(_lloyd_sql(4, 2, "SELECT id, k::int AS cluster FROM a2"))
def lloyd_fixed(spark, sf_dir):
    return clustering.lloyd(views.vectors(spark, sf_dir), 4, 2)[0].select("id", "cluster")


@query(" UNION ALL ".join(f"(SELECT * FROM ({_lloyd_sql(k, 1, f'SELECT {k} AS k, round(sum(d), 4) AS inertia FROM a1')}))" for k in (2, 3, 4)))
def elbow_inertia(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    out = None
    for k in (2, 3, 4):
        one = clustering.inertia(v, clustering.lloyd(v, k, 1)[1])
        out = one if out is None else out.unionByName(one)
    return out.select("k", F.round("inertia", 4).alias("inertia"))


@query()
def kmeans_ml(spark, sf_dir):
    clusterer = clustering.SemanticClusterer(config=clustering.ClusterConfig(n_clusters=10), id_col="id")
    return clusterer.cluster(views.vectors(spark, sf_dir)).select("id", "cluster")


@query()
def elbow_curve(spark, sf_dir):
    """find_optimal_k itself: costs of 2 to 5 clusters, and the one where they bend most."""
    clusterer = clustering.SemanticClusterer(config=clustering.ClusterConfig(n_init=2), id_col="id")
    ks, costs = clusterer.find_optimal_k(views.vectors(spark, sf_dir), (2, 6))
    best = clustering.elbow(ks, costs)
    return spark.createDataFrame([(k, float(c), k == best) for k, c in zip(ks, costs, strict=True)], "k int, inertia double, best boolean")


@query(_topk_sql("cosine").replace("SELECT * FROM d", "SELECT id::varchar AS id, distance FROM d").replace("ORDER BY distance , id", "ORDER BY distance, id::varchar"))
def store_search(spark, sf_dir):
    """A vector store filled twice, so that upserts replace all, and searched."""
    store = vector_store.VectorStore(spark, _shared(spark, "store"), "cosine")
    rows = views.vectors(spark, sf_dir).select("id", "embedding")
    store.add(rows.withColumn("embedding", F.transform("embedding", lambda x: x + 1)))
    store.add(rows)
    return store.query(_PROBE, 10).select("id", _r(F.col("distance"), 6).alias("distance"))


@query(f"WITH {views.VECTORS} SELECT id::varchar AS id, CASE WHEN id % 5 = 0 THEN 'new' ELSE label::varchar END AS document FROM vectors WHERE id % 7 <> 0 OR id >= 100")
def store_changes(spark, sf_dir):
    """A vector store after an upsert of a fifth, the last of three rows each, and deletions by id."""
    store = vector_store.VectorStore(spark, _shared(spark, "store"), "l2", "ivf", nlist=4)
    rows = views.vectors(spark, sf_dir).select("id", "embedding", F.col("label").cast("string").alias("document"))
    store.add(rows)
    fifth = rows.where("id % 5 = 0").withColumn("n", F.explode(F.array(*map(F.lit, (1, 3, 2)))))
    store.add(fifth.withColumn("document", F.when(F.col("n") == 3, "new").otherwise("old")), order="n")
    store.delete([str(i) for i in range(0, 100, 7)])
    return store.rows().select("id", "document")


@query()
def hash_embed(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return ImageEmbedder().embed(docs, "text").select("doc_id", "embedding")


# Workflows


@query(f"""{_NEAR}, {views.ANSWERS}, {_JSON}, s AS ({_SCENE})
    SELECT near.id::varchar AS image_id, d AS distance_to_query_m, s.parse_error, s.scene_narrative, s.land_use_primary, s.street_type FROM near JOIN s ON near.id = s.id WHERE d <= 800""")
def describe_workflow(spark, sf_dir):
    """describe_point itself: a point's images, described by a model that answers by a rule, and joined to their metadata."""
    images = views.points(spark, sf_dir).join(views.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "lower(c_mktsegment) AS tag"), "id")
    images = images.select(F.col("id").cast("string").alias("image_id"), "lat", "lon", F.concat(F.lit("/data/"), "tag", F.lit("/"), "id", F.lit(".jpg")).alias("image_path"))
    register("describer", "rule", views.RuleDescriber)
    found = workflows.describe_point(spark, **views.CENTER, downloader=ImageDownloader(FrameSource(images)), describer=ImageDescriber(backend="rule"), buffer_m=800)
    return found.select("image_id", _r(F.col("distance_to_query_m")).alias("distance_to_query_m"), "parse_error", "scene_narrative", "land_use_primary", "street_type")


@query(SQL["moran_local"])
def analyze_workflow(spark, sf_dir):
    """analyze_spatial itself: the frame with local statistics."""
    return workflows.analyze_spatial(views.points(spark, sf_dir), id_col="id")["frame"].select("id", "lisa_cluster", F.round("lisa_p_value", 8).alias("lisa_p_value"), "lisa_significant")


@query()
def cluster_workflow(spark, sf_dir):
    """cluster_descriptions itself: texts built, embedded and clustered."""
    docs = views.table(spark, sf_dir, "documents").selectExpr("doc_id AS image_id", "text AS scene_narrative", "source AS place_character")
    return workflows.cluster_descriptions(docs, 4, n_init=2).select("image_id", "cluster")


@query(f"WITH {views.POINTS} SELECT id::varchar AS image_id, '' AS scene_narrative, 'error' AS land_use_primary, true AS parse_error FROM points")
def describe_unknown(spark, sf_dir):
    """The describing stage itself, with a model that knows no image: error rows."""
    paths = views.points(spark, sf_dir).select(F.concat(F.lit("/data/images/"), "id", F.lit(".jpg")).alias("path"))
    return ImageDescriber().describe_frame(paths).select("image_id", "scene_narrative", "land_use_primary", "parse_error")


@query()
def search_workflow(spark, sf_dir):
    """build_search_index and search_similar: descriptions embedded, stored and searched."""
    docs = views.table(spark, sf_dir, "documents").selectExpr("doc_id AS image_id", "text AS scene_narrative", "source")
    db = workflows.build_search_index(docs, _shared(spark, "index"), metadata_columns=["source"])
    found = workflows.search_similar(db, "a quiet street with trees", n_results=10)
    return vector_store.VectorDB.flattened(found, ["source"]).select(F.col("id").alias("doc_id"), F.round("distance", 5).alias("distance"), "source")


@query(f"""WITH {views.POINTS}, c AS (SELECT cluster, land_use_primary AS v, count(*) AS n FROM points GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS r FROM c),
    z AS (SELECT cluster, count(*) AS size FROM points GROUP BY 1) SELECT z.cluster, z.size, round_even(z.size * 100.0::double / (SELECT count(*) FROM points), 1) AS pct, r.v AS top FROM z JOIN r ON z.cluster = r.cluster AND r.r = 1""")
def report_table(spark, sf_dir):
    p = views.points(spark, sf_dir)
    return summaries.cluster_sizes(p).join(summaries.category_profile(p, ["land_use_primary"]).select("cluster", "top"), "cluster").select("cluster", "size", "pct", "top")


@query(f"""WITH {views.POINTS}, c AS (SELECT cluster, land_use_primary AS v, count(*) AS n FROM points GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) AS r FROM c),
    z AS (SELECT cluster, count(*) AS size FROM points GROUP BY 1)
    SELECT concat('| ', z.cluster, ' | ', z.size, ' | ', printf('%.1f', round_even(z.size * 100.0::double / (SELECT count(*) FROM points), 1)), ' % |  | ', r.v, ' |') AS line FROM z JOIN r ON z.cluster = r.cluster AND r.r = 1""")
def report_lines(spark, sf_dir):
    """The rows of the clusters' table in the report itself."""
    lines = [line for line in report.generate_report(views.points(spark, sf_dir)).splitlines() if line.startswith("| ") and line[2].isdigit()]
    return spark.createDataFrame([(line,) for line in lines], "line string")


@query(f"""WITH {views.ANSWERS}, {_JSON}, s AS ({_SCENE}), t AS (SELECT trim(tag) AS tag, count(*) AS count FROM (SELECT unnest(string_split(semantic_tags, ',')) AS tag FROM s) WHERE trim(tag) <> '' GROUP BY 1) SELECT * FROM t ORDER BY count DESC, tag LIMIT 3""")
def top_tags(spark, sf_dir):
    return summaries.tag_counts(text.with_scene_fields(views.answers(spark, sf_dir), "answer"), n=3)


@query("SELECT date_trunc('hour', ts)::timestamp AS window_start, event_type AS key, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windowed_counts(views.table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


__all__ = ["QUERIES", "SQL", "workflows"]
