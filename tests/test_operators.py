"""Rules of the operators that the catalogue's queries do not show: ties, nulls, empty input, errors, traps."""

import hashlib
import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import geo, text
from kerbside.operators import clustering, keywords, merge, moran, neighbours, summaries, vector_store
from kerbside.operators.spatial_query import BBoxQuery, LineQuery, PlaceQuery, PointQuery, PolygonQuery
from kerbside.plans import report, workflows
from kerbside.providers import ImageDescriber, ImageEmbedder, message, parse_json_response
from kerbside.prompts import create_custom_prompt, get_prompt_template
from kerbside.sources import tables
from kerbside.sources.images import FrameSource, ImageDownloader
from kerbside.streaming.ingest import describe_stream, metadata_stream


@pytest.fixture(scope="module")
def images(spark):
    """30 points in three groups that lie apart."""
    rng = random.Random(42)
    rows = []
    for i in range(30):
        c = i // 10
        rows.append((f"img_{i:04d}", f"A {'busy' if i % 2 else 'quiet'} street with {('shops', 'trees', 'offices')[c]} and people.", 41 + c * 0.01 + rng.random() / 1000, 28.97 + rng.random() / 1000, c, ("residential", "commercial", None)[i % 3], f"/data/img_{i:04d}.jpg"))
    return spark.createDataFrame(rows, "image_id string, scene_narrative string, lat double, lon double, cluster int, land_use_primary string, image_path string").cache()


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_bad_queries():
    for make in (
        lambda: PointQuery(lat=91, lon=0), lambda: PointQuery(lat=0, lon=181), lambda: PointQuery(lat=0, lon=0, buffer_m=-1), lambda: LineQuery(geometry=[(0, 0)]), lambda: LineQuery(geometry=[(0, 0), (1, 1)], buffer_m=0),
        lambda: BBoxQuery(minx=1, miny=0, maxx=0, maxy=1), lambda: PolygonQuery(geometry=[(0, 0), (1, 1)]), lambda: PlaceQuery(place_name=""), lambda: PlaceQuery(place_name="x", geocoder={}.__getitem__).resolved(),
    ):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        PointQuery(41.0, 28.9)
    with pytest.raises(TypeError):
        LineQuery(geometry="x")


def test_polygons_with_holes_and_parts(spark):
    outer, hole, other = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)], [(10, 10), (12, 10), (11, 12)]
    q = PolygonQuery(geometry=[outer, hole, other])
    points = [(0.5, 0.5), (2, 2), (0, 2), (1, 2), (11, 11), (5, 5), (4, 4)]
    df = spark.createDataFrame([(k, float(y), float(x)) for k, (x, y) in enumerate(points)], "id int, lat double, lon double")
    assert {r[0] for r in q.select_from(df).collect()} == {0, 4}
    wide = PolygonQuery(geometry=outer, buffer_m=120_000)
    assert {r[0] for r in wide.select_from(df).collect()} == {0, 1, 2, 3, 6} | ({5} if geo.point_distance(5, 5, 4, 4) <= 120_000 else set())


def test_lines_of_several_parts_and_vertices(spark):
    q = LineQuery(geometry=[[(0, 0), (1, 0)], [(1, 1), (2, 1)]])
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 2.0), (3, None, 1.0)], "id int, lat double, lon double")
    found = {r["id"]: r for r in q.add_distances(df).collect()}
    step = geo.point_distance(0, 0, 0, 1)
    assert found[1]["distance_to_line_m"] == 0 and found[1]["distance_along_line_m"] == pytest.approx(step)
    assert found[2]["distance_along_line_m"] == pytest.approx(step + geo.point_distance(1, 1, 1, 2)) and found[3]["distance_to_line_m"] is None


def test_box_holds_the_circle(spark):
    rng = random.Random(1)
    for _ in range(5):
        lat, lon, r = rng.uniform(-89.95, 89.95), rng.uniform(-180, 180), 10 ** rng.uniform(1, 6.5)
        q = PointQuery(lat=lat, lon=lon, buffer_m=r)
        df = spark.range(3000).select((F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
        assert q.select_from(df).count() == df.where(q.distances(F.col("lat"), F.col("lon"))["distance_to_query_m"] <= r).count()


def test_predicates_reach_the_scan(spark, images, tmp_path):
    images.write.parquet(str(tmp_path / "x"))
    q = PointQuery(lat=41.0, lon=28.97, buffer_m=300)
    plan = q.select_from(tables.load_results(spark, str(tmp_path / "x"), ["image_id", "lat", "lon"]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat" in plan and "ReadSchema: struct<image_id:string,lat:double,lon:double>" in plan


def test_wkb_bits(spark):
    values = [0.0, 1.0, -1.0, 28.97, -179.999, 1e-7, 123456.789, math.pi, -2.0**-20, 90.0]
    df = spark.createDataFrame([(x, y) for x in values for y in values], "lon double, lat double")
    for r in df.select("*", geo.wkb_point(F.col("lon"), F.col("lat")).alias("w")).collect():
        assert bytes(r["w"]) == struct.pack("<BIdd", 1, 1, r["lon"] + 0.0, r["lat"] + 0.0)
    big = spark.createDataFrame([(bytearray(struct.pack(">BIdd", 0, 1, -3.25, 7.5)),), (bytearray(b"\1\2\0\0\0" + b"0" * 30),), (None,)], "w binary")
    lon, lat = geo.point_of_wkb(F.col("w"))
    assert [tuple(r) for r in big.select(lon, lat).collect()] == [(-3.25, 7.5), (None, None), (None, None)]


def test_descriptions_of_answers(spark):
    cases = {None: None, "  ": None, "plain": "plain", '{"target_field": "t", "scene_narrative": "s"}': "t", '{"scene_narrative": null}': None, '{"z": "b", "n": 1, "a": "c"}': "b c", '{"n": 1}': '{"n":1}', '"word"': "word", "[1,2]": "[1,2]"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.parse_description(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == cases


def test_answers_on_the_driver():
    assert parse_json_response('```json\n{"a": 1}\n```') == {"a": 1} and parse_json_response('json {"a": 1}') == {"a": 1}
    assert "error" in parse_json_response("none")


def test_scene_defaults(spark):
    cases = ['{"error": "x"}', "[1]", '{"land_use_character": "flat"}', '{"land_use_character": {"primary": null}}', None, '{"semantic_tags": ["a", "b"]}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string")
    got = {r["k"]: r for r in text.with_scene_fields(df, "t").collect()}
    assert [got[k]["parse_error"] for k in range(6)] == [True, False, False, False, True, False]
    assert [got[k]["land_use_primary"] for k in range(6)] == ["error", "unknown", "unknown", None, "error", "unknown"]
    assert got[5]["semantic_tags"] == "a,b" and got[2]["usable"] is True and got[0]["usable"] is False


def test_ids_and_text(spark):
    paths = {"/data/images/0001.jpg": "0001", "C:\\photos\\123.png": "123", "x": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["i"] for r in df.select("p", text.extract_image_id(F.col("p")).alias("i")).collect()} == paths
    assert one(spark, text.extract_image_id(F.lit("result_42_desc.json"), r"(\d+)")) == "42"
    assert [one(spark, text.file_stem(F.lit(p))) for p in ("/a/b.c.jpg", "d", ".hidden", "e\\f.png")] == ["b.c", "d", ".hidden", "f"]
    df = spark.createDataFrame([("hello", " world ", ["x", "y"]), (None, "  ", None)], "a string, b string, c array<string>")
    assert [r[0] for r in df.select(text.compose_text(df, ["a", "b", "c", "none"])).collect()] == ["hello | world | x, y", ""]
    assert text.place_slug("Old Town, City") == "old_town_city"


def test_merges(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "image_id string, a string")
    b = spark.createDataFrame([(1, "other", 10), (1, "twice", 11)], "image_id int, A string, b int")
    assert sorted(r["b"] for r in merge.merge_metadata_and_descriptions(a, b).collect() if r["b"]) == [10, 11]
    out = merge.merge_data_sources(a, b.limit(1), spark.createDataFrame([(None, 5)], "image_id string, c int"))
    assert out.columns == ["image_id", "a", "b", "c"] and {(r["a"], r["c"]) for r in out.collect()} == {("x", None), ("y", None), ("z", 5)}
    with pytest.raises(ValueError):
        merge.merge_metadata_and_descriptions(a.drop("image_id"), b)


def test_profile_counts_nulls_in_the_share(spark, images):
    found = {(r["cluster"], r["column"]): r for r in summaries.category_profile(images).collect()}
    assert found[0, "land_use_primary"]["top"] == "residential" and found[0, "land_use_primary"]["pct"] == 40.0 and found[0, "land_use_primary"]["size"] == 10
    assert summaries.category_profile(images, ["absent"]).count() == 0


def brute_neighbours(points, k):
    out = {}
    for i, x, y in points:
        out[i] = [j for _, j in sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in points if j != i)[:k]]
    return out


@pytest.mark.parametrize("kind", ["even", "clumps", "same", "line", "few"])
def test_neighbours_are_exact(spark, kind):
    rng = random.Random(7)
    n = {"few": 5, "same": 60}.get(kind, 220)
    where = {"even": lambda: (rng.random(), rng.random()), "clumps": lambda: (rng.choice([0, 5, 5.001]) + rng.gauss(0, 1e-4), rng.choice([0, 1000]) + rng.gauss(0, 1e-4)), "same": lambda: (float(rng.randint(0, 2)), 0.0), "line": lambda: (2.0 ** rng.randint(0, 40), 0.0), "few": lambda: (rng.random(), 1.0)}[kind]
    points = [(i, *where()) for i in range(n)]
    df = spark.createDataFrame([*points, (None, 1.0, 1.0), (9999, None, 1.0)], "id bigint, lon double, lat double").repartition(3)
    got = {}
    for r in neighbours.nearest_neighbours(df, 8).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["nbr_id"]
    assert {i: [g[k] for k in sorted(g)] for i, g in got.items()} == brute_neighbours(points, 8)


def task_memory(spark, action):
    """The most memory in MB that a task of a stage of action's took for sorts and joins, on average over its tasks."""
    context, group = spark.sparkContext, f"group-{random.random()}"
    context.setJobGroup(group, "measured")
    action()
    context.setLocalProperty("spark.jobGroup.id", None)
    found, store = [0], context._jsc.sc().statusStore()
    for job in context.statusTracker().getJobIdsForGroup(group):
        for stage in context.statusTracker().getJobInfo(job).stageIds:
            data = store.lastStageAttempt(stage)
            found.append(data.peakExecutionMemory() / max(1, data.numCompleteTasks()) / 2**20)
    return max(found)


def test_neighbours_hold_no_table_of_pairs(spark):
    points = spark.range(30_000).selectExpr("id", "id * 7919 % 20011 / 1e6 AS lon", "id * 104729 % 20021 / 1e6 AS lat")
    assert task_memory(spark, lambda: neighbours.nearest_neighbours(points, 8).write.format("noop").mode("overwrite").save()) < 80


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_neighbours_across_tiles(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "TILE_CELLS", 2)
    rng = random.Random(3)
    make = str if kind == "string" else int
    points = [(make(i), rng.randint(0, 40) / 8, rng.randint(0, 40) / 8) for i in range(900)] + [(make(1000 + i), 1.0, 1.0) for i in range(30)]
    got = {}
    for r in neighbours.nearest_neighbours(spark.createDataFrame(points, f"id {kind}, lon double, lat double"), 5).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["nbr_id"]
    assert {i: [g[k] for k in sorted(g)] for i, g in got.items()} == brute_neighbours(points, 5)


def test_moran_sends_no_graph_through_the_driver(spark):
    points = spark.range(300).selectExpr("id", "id * 7919 % 20011 / 1e6 AS lon", "id * 104729 % 20021 / 1e6 AS lat", "id % 3 AS cluster")
    edges = neighbours.nearest_neighbours(points, 8)
    labels = points.select("id", F.col("cluster").alias("label"))
    plan = moran._labelled(edges, labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_moran_of_blocks_and_checkerboards(spark):
    cells = [(x * 12 + y, x / 10, y / 10, int(x < 6), (x + y) % 2) for x in range(12) for y in range(12)]
    df = spark.createDataFrame(cells, "id bigint, lon double, lat double, block int, board int")
    blocks = moran.moran_results(moran.moran_global(df, "block", k=4))
    board = moran.moran_results(moran.moran_global(df, "board", k=4))
    assert blocks[1].I > 0.7 and blocks[1].p_value < 0.01 and blocks[1].expected_I == pytest.approx(-1 / 143)
    assert board[1].I < -0.5 and board[1].z_score < -3
    local = moran.moran_local(df, "block", k=4).collect()
    assert len(local) == 144 and {r["lisa_cluster"] for r in local} <= {0, 1, 4}
    one_label = moran.moran_global(df.withColumn("one", F.lit(1)), "one", k=4).first()
    assert one_label["i"] is None and one_label["p_value"] is None


def test_moran_moments_are_those_of_permutations(spark):
    rng = np.random.default_rng(5)
    n = 60
    xy, y = rng.random((n, 2)), (rng.random(n) < 0.35).astype(float)
    near = brute_neighbours([(i, *xy[i]) for i in range(n)], 5)
    w = np.zeros((n, n))
    for i, js in near.items():
        w[i, js] = 0.2
    def value(v):
        z = v - v.mean()
        return z @ w @ z / (z @ z)
    sims = np.array([value(rng.permutation(y)) for _ in range(4000)])
    df = spark.createDataFrame([(i, float(xy[i, 0]), float(xy[i, 1]), int(y[i])) for i in range(n)], "id bigint, lon double, lat double, cluster int")
    r = moran.moran_results(moran.moran_global(df, k=5))[1]
    assert r.I == pytest.approx(value(y)) and r.z_score == pytest.approx((value(y) - sims.mean()) / sims.std(), abs=0.15)


def test_hashes_are_md5():
    for name in ("7", "1234567", "x" * 53, "y" * 64, "z" * 130):
        names = [name[:-1] + c for c in "abc"]
        raw = np.zeros((3, -(-len(name) // 4) * 4), np.uint8)
        raw[:, : len(name)] = np.frombuffer("".join(names).encode(), np.uint8).reshape(3, -1)
        got = moran.md5_head(np.ascontiguousarray(raw.view("<u4").T), len(name), b"|417")
        assert [int(g).to_bytes(8, "big") for g in got] == [hashlib.md5(f"{n}|417".encode()).digest()[:8] for n in names]


def test_rounds_are_dealt_in_tasks(spark, monkeypatch):
    points = spark.range(2_500).selectExpr("id", "id * 7919 % 20011 / 1e6 AS lon", "id * 104729 % 20021 / 1e6 AS lat", "cast(id * id % 7 % 3 AS string) AS cluster")
    edges = neighbours.nearest_neighbours(points, 4).where("rank < 4 OR id % 5 > 0").withColumn("w", F.col("rank") * 0.25).cache()
    test = lambda: sorted(moran.moran_permutations(points, permutations=30, edges=edges).collect())
    rows = []
    monkeypatch.setattr(moran, "HASHED", 999)
    used = task_memory(spark, lambda: rows.extend(test()))
    monkeypatch.setattr(moran, "HELD_POINTS", 0)
    shuffled = test()
    assert len(rows) == 3 and rows == shuffled and used < 80


def test_keywords_of_small_clusters(spark):
    rows = [(i, "park bench tree" if i % 2 else "park fountain", 0) for i in range(6)] + [(10, "lonely words", 1), (11, None, 1)]
    found = keywords.extract_keywords(spark.createDataFrame(rows, "image_id bigint, embedding_text string, cluster int"), 3).collect()
    assert {r["cluster"] for r in found} == {0} and "park" in {r["term"] for r in found}


def test_keyword_counts_are_bounded():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 4000), pa.array([" ".join(f"w{i}x{j}" for j in range(100)) for i in range(4000)])], ["cluster", "text"])
    tracemalloc.start()
    counted = sum(len(b) for b in keywords._counter(frozenset(), False, None)(iter([batch])))
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted == 400_000 and used < 60 << 20


def test_vector_scores_are_bounded():
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(4).normal(size=(4096, 4))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(4097, dtype=np.int32) * 4), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4096)), vectors], ["id", "v"])
    tracemalloc.start()
    found = pa.Table.from_batches(vector_store._scorer(pa.array(range(4096)), x, 5, "cosine")(iter([batch])))
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    far = np.round(1 - u @ u.T, 6)
    best = np.lexsort((np.broadcast_to(np.arange(4096), far.shape), far), axis=1)[:, :5]
    assert np.array_equal(found.column(1).to_numpy().reshape(-1, 5), best) and used < 200 << 20


@pytest.mark.parametrize("corner", range(3))
def test_slanted_edges_are_those_of_sql(spark, corner):
    import duckdb

    from kerbside.plans import catalogue, views

    (x1, y1), (x2, y2) = views.RING[corner], views.RING[(corner + 1) % 3]
    rows = [(i, y1 + (y2 - y1) * i / 2000, x1 + (x2 - x1) * i / 2000) for i in range(1, 2000)]
    rows = [(i, 41.0 + round((lat - 41) * 1e6) / 1e6, 28.97 + round((lon - 28.97) * 1e6) / 1e6) for i, lat, lon in rows]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    con = duckdb.connect()
    con.execute("CREATE TABLE points (id int, lat double, lon double)")
    con.executemany("INSERT INTO points VALUES (?, ?, ?)", rows)
    want = {r[0] for r in con.sql(f"SELECT id FROM points WHERE {catalogue._ring_sql()}").fetchall()}
    assert {r["id"] for r in PolygonQuery(geometry=views.RING).select_from(df).collect()} == want


def test_clustering(spark, images):
    clusterer = clustering.SemanticClusterer(ImageEmbedder(), clustering.ClusterConfig(n_clusters=3, n_init=2, max_iter=10))
    out = clusterer.cluster(images.drop("cluster"))
    assert out.count() == 30 and {r[0] for r in out.select("cluster").distinct().collect()} == {0, 1, 2}
    with pytest.raises(RuntimeError):
        clustering.SemanticClusterer().cluster(images)
    assert clustering.elbow([2, 3, 4, 5, 6, 7], [100, 80, 50, 40, 38, 37]) == 4 and clustering.elbow([2, 3], [5, 4]) == 3


@pytest.mark.parametrize("index_type", ["flat", "ivf"])
def test_vector_store(spark, tmp_path, index_type):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 8))
    rows = spark.createDataFrame([(f"id_{i}", x[i].tolist(), {"n": str(i)}) for i in range(20)], "id string, embedding array<double>, metadata map<string,string>")
    store = vector_store.VectorStore(spark, str(tmp_path / "s"), "l2", index_type, nlist=4, nprobe=4)
    assert store.count() == 0 and store.query(x[0].tolist()).count() == 0
    store.add(rows)
    store.add(rows.limit(5))
    assert store.count() == 20
    got = [r["id"] for r in store.query(x[3].tolist(), 4).collect()]
    assert got == [f"id_{i}" for i in np.argsort(((x - x[3]) ** 2).sum(axis=1))[:4]]
    store.delete(["id_3"])
    again = vector_store.VectorStore.load(spark, str(tmp_path / "s"))
    assert again.count() == 19 and again.state["metric"] == "l2" and again.query(x[3].tolist(), 1).first()["id"] != "id_3"
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>"))
    with pytest.raises(ValueError):
        vector_store.VectorStore(spark, str(tmp_path / "t"), "hamming")


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_cells_lose_no_neighbour(spark, tmp_path, metric):
    """Against brute force, with nprobe < nlist; by probing alone recall is below 0.9 here."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 16)) * (1 + np.arange(300) % 3)[:, None], 3).astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(f"{i:03d}", x[i].tolist()) for i in range(300)], "id string, embedding array<double>")
    store = vector_store.VectorStore(spark, str(tmp_path / "s"), metric, "ivf", nlist=20, nprobe=2)
    store.add(rows)
    cells = {r["id"]: r["cell"] for r in store.rows().collect()}
    share = []
    for q in x[::25]:
        far = {"ip": -(x @ q), "l2": ((x - q) ** 2).sum(axis=1), "cosine": 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)}[metric]
        want = [f"{i:03d}" for i in np.lexsort((np.arange(300), np.round(far, 6)))[:10]]
        assert [r["id"] for r in store.query(q.tolist(), 10).collect()] == want
        probed = vector_store.probed(q, store.state["centroids"], 2, metric)
        share.append(np.mean([cells[i] in probed for i in want]))
    assert np.mean(share) < 0.9


def test_cell_space(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, None), (2, [0.0, 0.0]), (3, [0.0, -2.0])], "id int, v array<float>").coalesce(1)
    assert [r[0] for r in df.select(vector_store.in_cell_space(F.col("v"), "cosine")).collect()] == [[0.6, 0.8], None, [0.0, 0.0], [0.0, -1.0]]


def test_bounds_rule_cells_out(spark):
    """Groups far from each other: no cell beyond the nearest can hold a neighbour, nor is one read."""
    x = np.array([[10.0 * (i % 4), 0.01 * i] for i in range(80)])
    centroids = [x[g::4].mean(axis=0).tolist() for g in range(4)]
    rows = spark.createDataFrame([(i, x[i].tolist(), i % 4) for i in range(80)], "id int, embedding array<double>, cell int")
    radii = vector_store.cell_radii(rows, centroids, "l2")
    assert radii == pytest.approx([np.abs(x[g::4] - centroids[g]).max() for g in range(4)])
    asked = rows.withColumn("embedding", F.when(F.col("cell") == 1, F.col("embedding")).otherwise(F.raise_error(F.lit("read"))))
    assert {r["cell"] for r in vector_store.cell_search(asked, [10.0, 0.3], centroids, radii, 10, 1, "l2").collect()} == {1}


def test_search(spark, images, tmp_path):
    db = workflows.build_search_index(images, str(tmp_path / "i"), metadata_columns=["cluster"])
    found = workflows.search_similar(db, images.first()["scene_narrative"], n_results=3)
    assert found.count() == 3 and abs(found.first()["distance"]) < 1e-5
    assert db.flattened(found, ["lat", "cluster"]).columns == ["id", "distance", "lat", "cluster"]
    with pytest.raises(ValueError):
        db.search()


def test_files(spark, images, tmp_path):
    out = tables.export_formats(images, str(tmp_path), "r", "GeoParquet geojson csv gpkg nonsense")
    assert sorted(out) == ["csv", "geojson", "geoparquet", "gpkg"]
    back = tables.load_geoparquet(spark, out["geoparquet"])
    assert back.count() == 30 and "geometry" in back.columns
    line = json.loads(spark.read.text(out["geojson"]).first()[0])
    assert line["type"] == "Feature" and line["geometry"]["type"] == "Point" and "lat" not in line["properties"]
    import sqlite3

    assert sqlite3.connect(out["gpkg"]).execute("SELECT count(*), min(length(geom)) FROM results").fetchone() == (30, 29)
    assert tables.load_results(spark, out["geoparquet"], ["image_id"], [("cluster", "==", 1), ("lat", "<", 99.0)]).count() == 10
    found = tables.summarize_results(spark, out["geoparquet"])
    assert found["rows"] == 30 and found["size_kb"] > 0 and found["categories"].count() == 2
    assert any("r.parquet" in p for p in tables.list_results(spark, str(tmp_path)))
    for bad in (lambda: tables.load_geoparquet(spark, str(tmp_path / "no")), lambda: tables.list_results(spark, str(tmp_path / "no"))):
        with pytest.raises(FileNotFoundError):
            bad()
    with pytest.raises(TypeError):
        tables.save_geoparquet(images, str(tmp_path / "z"))
    with pytest.raises(ValueError):
        tables.to_points(images.drop("lat"))


def test_metadata_csv(spark, tmp_path):
    assert tables.load_metadata(spark, str(tmp_path)).count() == 0
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/pids_raw.csv").write_text("id,lat,lon,captured_at\n7,41.0,28.97,1700000000000\n8,bad,28.98,\n")
    rows = {r["image_id"]: r for r in tables.load_metadata(spark, str(tmp_path), PointQuery(lat=41.0, lon=28.97)).collect()}
    assert rows["7"]["distance_to_query_m"] == 0 and str(rows["7"]["captured_at"]) == "2023-11-14 22:13:20" and rows["8"]["lat"] is None
    nearest = tables.load_metadata(spark, str(tmp_path), PointQuery(lat=41.0, lon=28.97, nearest_only=True))
    assert nearest.count() == 1


def test_download(spark, images, tmp_path):
    folder = str(tmp_path)

    def get(url):
        if "0003" in url:
            raise OSError("gone")
        return url.encode()

    def put(name, data):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)

    d = ImageDownloader(FrameSource(images), get, put)
    box = BBoxQuery(minx=28.9, miny=40.9, maxx=29.0, maxy=41.005)
    found = d.download(spark, box).collect()
    assert len(found) == 10 and {r["image_id"]: r["status"] for r in found}["img_0003"] == "failed" and sum(r["status"] == "ok" for r in found) == 9
    top = d.download(spark, box, metadata_only=True, max_images=3)
    every = sorted(r["distance_to_centroid_m"] for r in found)
    assert [r["distance_to_centroid_m"] for r in top.collect()] == every[:3]
    with pytest.raises(TypeError):
        d.select(spark, "no query")


def test_describing(spark, images, tmp_path):
    folder = tmp_path / "pics"
    folder.mkdir()
    for name in ("a.jpg", "b.PNG", "c.txt"):
        (folder / name).write_bytes(b"x")
    d = ImageDescriber(options={"known": {"a": '{"scene_narrative": "A lane"}'}})
    out = str(tmp_path / "out")
    assert {r["image_id"]: r["parse_error"] for r in d.describe(spark, str(folder), out).collect()} == {"a": False, "b": True}
    (folder / "d.jpeg").write_bytes(b"x")
    assert sorted(r["image_id"] for r in d.describe(spark, str(folder), out).collect()) == ["a", "b", "d"]
    assert d.describe(spark, str(folder), out, resume=False).count() == 3
    assert d.describe_single("x/a.jpg") == {"scene_narrative": "A lane"}
    with pytest.raises(ValueError):
        ImageDescriber("nonsense")
    with pytest.raises(ValueError):
        get_prompt_template("nonsense")
    assert create_custom_prompt("s", "u") == {"system": "s", "user": "u", "schema": None}
    assert ImageDescriber(template="simple", system_prompt="mine").prompt["system"] == "mine"
    assert message("t", "/a.jpg")[0] == {"type": "image", "image": "file:///a.jpg"} and message() == [{"type": "text", "text": ""}]


def test_workflow_and_report(spark, images, tmp_path):
    d = ImageDownloader(FrameSource(images.select("image_id", "lat", "lon", "image_path")))
    known = {f"img_{i:04d}": '{"scene_narrative": "Lane %d"}' % i for i in range(30)}
    out = workflows.describe_point(spark, 41.0, 28.97, d, ImageDescriber(options={"known": known}), buffer_m=2000, output_dir=str(tmp_path), max_images=5)
    assert out.count() == 5 and out.where("scene_narrative LIKE 'Lane%'").count() == 5
    place = workflows.describe_place(spark, "Here, There", d, ImageDescriber(), lambda n: {"type": "Point", "coordinates": [28.97, 41.0]}, buffer_m=500)
    assert 0 < place.count() < 30
    found = workflows.analyze_spatial(images, k_neighbors=3)
    assert set(found["global"]) == {0, 1, 2} and found["frame"].count() == 30
    made = report.generate_report(images, {0: ["shops"]}, found["global"], str(tmp_path / "r/report.md"))
    assert "| 0 | 10 | 33.3 % | shops |" in made and "| ** |" in made
    assert report.elbow_svg([2, 3, 4], [9.0, 4.0, 3.0]).startswith("<svg") and report.cluster_map_svg(images).count("<circle") >= 3
    assert "<rect" in report.category_svg(images) and "<svg" in report.lisa_map_svg(found["frame"])
    with pytest.raises(ValueError):
        report.category_distribution(images.select("cluster"))


def test_stream_describes_each_image_once(spark, images, tmp_path):
    incoming, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    some = images.withColumn("captured_at", F.timestamp_seconds(F.lit(1_700_000_000))).select("image_id", "lat", "lon", "captured_at", "image_path")
    for batch in (some.limit(5), some.limit(8)):
        batch.write.mode("append").parquet(incoming)
        describe_stream(metadata_stream(spark, incoming), ImageDescriber(), out, at, available_now=True).awaitTermination(120)
    assert spark.read.parquet(out).groupBy("image_id").count().where("count > 1").isEmpty()
    assert spark.read.parquet(out).count() == 8
