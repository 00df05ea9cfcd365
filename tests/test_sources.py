"""Backends, sources, the store's contract and versions: what the catalogue's queries don't reach."""

import json
import sys
import types

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kerbside import backends, providers
from kerbside.functions import geo
from kerbside.operators import keywords, vector_store
from kerbside.operators.spatial_query import BBoxQuery, LineQuery, PointQuery
from kerbside.plans import report
from kerbside.session import checkpoint_dir, ship
from kerbside.sources import images, tables


def test_last_token_pool():
    states = np.arange(2 * 4 * 3).reshape(2, 4, 3)
    assert backends.last_token_pool(states, [[1, 1, 0, 0], [1, 1, 1, 0]]).tolist() == [states[0, 1].tolist(), states[1, 2].tolist()]
    assert backends.last_token_pool(states, [[0, 0, 1, 1], [0, 1, 1, 1]]).tolist() == [states[0, 3].tolist(), states[1, 3].tolist()]
    assert backends.last_token_pool(states, [[1, 1, 1, 1], [1, 0, 0, 0]]).tolist() == [states[0, 3].tolist(), states[1, 0].tolist()]
    assert backends.last_token_pool(states[:1], [[0, 0, 0, 0]]).tolist() == [states[0, 0].tolist()]


def test_messages():
    assert providers.message() == [backends.words("")] == [dict(type="text", text="")]
    assert providers.message("t", "https://x/a.jpg") == [backends.picture("https://x/a.jpg"), backends.words("t")]
    two = providers.message(None, ["/a/b.jpg", "c.jpg"])
    assert two[0]["image"] == "file:///a/b.jpg" and two[1]["image"].startswith("file:///") and two[1]["image"].endswith("/c.jpg") and len(two) == 2


class Tensor:
    """As much of a tensor as the backends touch."""

    def __init__(self, x):
        self.x = np.asarray(x)
        self.shape = self.x.shape

    def float(self):
        return self

    cpu = float

    def numpy(self):
        return self.x

    def __getitem__(self, at):
        return Tensor(self.x[at])


class Batch(dict):
    def to(self, device):
        return self


class NoGrad:
    def __enter__(self):
        return None

    def __exit__(self, *_):
        return False


@pytest.fixture
def stub_models(monkeypatch):
    """Stand-ins for the model libraries: they count calls, and answer with what they were asked."""
    calls = []

    class Processor:
        @classmethod
        def from_pretrained(cls, name, **_):
            calls.append(("processor", name))
            return cls()

        def apply_chat_template(self, talk, tokenize, add_generation_prompt):
            return "|".join(p.get("text") or p.get("image") for m in talk for p in m["content"])

        def __call__(self, text, **more):
            n = len(text[0])
            return Batch(input_ids=Tensor(np.zeros((1, 2))), attention_mask=Tensor([[1] * n + [0] * 2]), text=text)

        def batch_decode(self, ids, skip_special_tokens):
            return [f"said {ids.shape[1]}"]

    class Network:
        device = "cpu"

        @classmethod
        def from_pretrained(cls, name, **_):
            calls.append(("network", name))
            return cls()

        def generate(self, input_ids, max_new_tokens, do_sample, **_):
            assert max_new_tokens == 2048 and do_sample is False
            return Tensor(np.zeros((1, 7)))

        def __call__(self, attention_mask, text, **_):
            n = attention_mask.shape[1]
            return types.SimpleNamespace(last_hidden_state=Tensor(np.arange(n * 4).reshape(1, n, 4)))

    class Engine:
        def __init__(self, **settings):
            calls.append(("engine", settings["seed"], settings.get("runner")))

        def generate(self, inputs, sampling_params):
            calls.append(("generate", len(inputs), sampling_params.temperature, sampling_params.max_tokens))
            return [types.SimpleNamespace(outputs=[types.SimpleNamespace(text=i["prompt"])]) for i in inputs]

        def embed(self, inputs):
            calls.append(("embed", len(inputs)))
            return [types.SimpleNamespace(outputs=types.SimpleNamespace(embedding=[float(len(i["prompt"])), 1.0])) for i in inputs]

    modules = {
        "torch": types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: False, device_count=lambda: 0), float32="f", bfloat16="b", no_grad=NoGrad),
        "transformers": types.SimpleNamespace(AutoProcessor=Processor, AutoModel=Network, AutoModelForVision2Seq=Network),
        "vllm": types.SimpleNamespace(LLM=Engine, SamplingParams=lambda **k: types.SimpleNamespace(**k)),
        "qwen_vl_utils": types.SimpleNamespace(process_vision_info=lambda talk, **k: (["img"], None, {}) if k else (["img"], None)),
    }
    for name, module in modules.items():
        made = types.ModuleType(name)
        made.__dict__.update(vars(module))
        made.__spec__ = types.SimpleNamespace(name=name)
        monkeypatch.setitem(sys.modules, name, made)
    return calls


def test_backends_with_stub_models(stub_models):
    told = backends.VllmDescriber()
    assert told.generate(["a.jpg", "b.jpg"], "S", "U") == ["S|a.jpg|U", "S|b.jpg|U"] and told.generate(["c.jpg"], "S", "U") == ["S|c.jpg|U"]
    assert [c for c in stub_models if c[0] == "engine"] == [("engine", 42, None)]  # loaded once
    assert ("generate", 2, 0.0, 2048) in stub_models
    assert backends.VllmEmbedder().embed([providers.message("xy"), providers.message("z")], "I").tolist() == [[4.0, 1.0], [3.0, 1.0]] and ("engine", 42, "pooling") in stub_models
    assert backends.TransformersDescriber().generate(["a.jpg", "b.jpg"], "S", "U") == ["said 5", "said 5"]
    found = backends.TransformersEmbedder().embed([providers.message("xy")], "I")  # "I|xy": four tokens, two of padding
    assert found.tolist() == [[12.0, 13.0, 14.0, 15.0]]


def test_auto_takes_what_can_run(stub_models):
    assert not backends.VllmDescriber.available() and backends.TransformersDescriber.available()
    assert providers.ImageDescriber().make is backends.TransformersDescriber and providers.ImageEmbedder().make is backends.TransformersEmbedder
    with pytest.raises(ValueError, match="unknown backend"):
        providers.ImageEmbedder(backend="none")


def test_auto_without_models():
    assert providers.ImageDescriber().make is providers.TableDescriber and providers.ImageEmbedder().make is providers.HashEmbedder


def test_hash_embedder(tmp_path):
    (tmp_path / "a.jpg").write_bytes(bytes(range(200)))
    (tmp_path / "b.jpg").write_bytes(bytes(range(200)))
    (tmp_path / "c.jpg").write_bytes(bytes(range(200, 0, -1)))
    embed = lambda items: providers.unit(providers.HashEmbedder(64).embed(items))
    a, b, c = embed([providers.message(None, str(tmp_path / f"{n}.jpg")) for n in "abc"])
    assert np.allclose(a, b) and a @ c < 0.9  # by what is in the files
    texts = embed([providers.message(t) for t in ("a quiet street", "a quiet street", "a quiet streets", "Ünrelated wörds", "")])
    assert np.allclose(texts[0], texts[1]) and texts[0] @ texts[2] > texts[0] @ texts[3] and not texts[4].any()
    alone = embed([providers.message("a quiet streets")])
    assert np.allclose(alone[0], texts[2])


def test_describe_commits_as_it_goes(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k:02d}.JPG").write_bytes(b"x")
    out = str(tmp_path / "out")
    calls = []

    class Crashing(providers.ImageDescriber):
        def describe_frame(self, images, path="path"):
            if len(calls) == 2:
                raise RuntimeError("lost")
            calls.append(1)
            return super().describe_frame(images, path)

    with pytest.raises(RuntimeError):
        Crashing(backend="table").describe(spark, str(tmp_path), out, commit_rows=3)
    kept = spark.read.parquet(out).count()
    assert 0 < kept < 12  # what was done before stays
    done = providers.ImageDescriber(backend="table").describe(spark, str(tmp_path), out, commit_rows=5)
    assert done.count() == 12 and done.select("image_id").distinct().count() == 12
    assert providers.ImageDescriber(backend="table").describe(spark, str(tmp_path), out, resume=False).count() == 12


def test_geoparquet_footer(spark, tmp_path):
    df = tables.to_points(spark.createDataFrame([(1, 41.0, 29.0), (2, None, None)], "id int, lat double, lon double"))
    path = tables.save_geoparquet(df.repartition(2), str(tmp_path / "deep/er/points.parquet"), compression="zstd")
    parts = sorted((tmp_path / "deep/er/points.parquet").glob("*.parquet"))
    for part in parts:
        told = json.loads(pq.read_metadata(part).metadata[b"geo"])
        assert told["primary_column"] == "geometry" and told["columns"]["geometry"]["encoding"] == "WKB"
        assert pq.read_metadata(part).row_group(0).column(0).compression == "ZSTD"
    assert sorted(map(str, spark.read.parquet(path).select("id", "lat").collect())) == ["Row(id=1, lat=41.0)", "Row(id=2, lat=None)"]
    tables.save_geoparquet(df, path, mode="append")
    assert spark.read.parquet(path).count() == 4
    tables.save_geoparquet(df.where("false"), path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == df.columns
    assert not list((tmp_path / "deep/er").glob("points.parquet.*"))


def test_listings(spark, tmp_path):
    for name in ("b.parquet", "a.parquet", "x/c.parquet", "x/y/d.parquet", "x/e.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    names = lambda pattern: [p.split(tmp_path.name + "/")[1] for p in tables.list_results(spark, str(tmp_path), pattern)]
    assert names("**/*.parquet") == ["a.parquet", "b.parquet", "x/c.parquet", "x/y/d.parquet"]
    assert names("*.parquet") == ["a.parquet", "b.parquet"] and names("x/*") == ["x/c.parquet", "x/e.csv"] and names("**/[cd].*") == ["x/c.parquet", "x/y/d.parquet"] and names("?.parquet") == ["a.parquet", "b.parquet"]
    with pytest.raises(FileNotFoundError):
        tables.list_results(spark, str(tmp_path / "none"))
    for name in ("2.png", "1.JPG", "x/0.webp", "n.txt"):
        (tmp_path / name).write_bytes(b"x")
    stems = lambda df: [r["path"].rsplit("/", 1)[-1] for r in df.collect()]
    assert stems(tables.resolve_images(spark, str(tmp_path))) == ["1.JPG", "2.png", "0.webp"]
    assert stems(tables.resolve_images(spark, str(tmp_path / "n.txt"))) == ["n.txt"] and stems(tables.resolve_images(spark, ["z.jpg", "a.jpg"])) == ["z.jpg", "a.jpg"]


def test_report_goes_where_it_is_told(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "cluster int, land_use_primary string")
    path = tmp_path / "new/folder/report.md"
    assert path.exists() is False and report.generate_report(df, output_path=f"file://{path}") == path.read_text(encoding="utf-8")


def test_remote_source_by_tiles(spark, tmp_path):
    ship(spark)
    log = tmp_path / "log"
    log.mkdir()

    def client(box, start, end, log=str(log)):
        import uuid
        from pathlib import Path

        Path(log, uuid.uuid4().hex).write_text(repr(box))
        for i in range(100):
            lat, lon = 41.0 + i * 0.0005, 29.0 + i * 0.0005
            if box[0] <= lon <= box[2] and box[1] <= lat <= box[3]:  # both borders: some images come twice
                yield {"image_id": str(i), "lat": lat, "lon": lon}

    source = images.RemoteSource(client, cache_dir=str(tmp_path / "cache"))
    query = PointQuery(lat=41.01, lon=29.01, buffer_m=500)
    found = images.download_images(spark, query, source, metadata_only=True, max_images=5)
    want = sorted(range(100), key=lambda i: geo.point_distance(41.0 + i * 0.0005, 29.0 + i * 0.0005, 41.01, 29.01))[:5]
    assert sorted(int(r["image_id"]) for r in found.collect()) == sorted(want)
    asked = len(list(log.iterdir()))
    assert asked == len(source.tiles(images.query_box(query))) > 1
    assert images.ImageDownloader(source).select(spark, query).count() > 5 and len(list(log.iterdir())) == asked  # from the cache
    images.ImageDownloader(source).select(spark, query, use_cache=False).count()
    assert len(list(log.iterdir())) > asked
    with pytest.raises(ValueError, match="query"):
        source.metadata(spark)


@pytest.mark.parametrize("query", [PointQuery(lat=41.0, lon=29.0, buffer_m=400), LineQuery(geometry=[(29.0, 41.0), (29.02, 41.01)], buffer_m=300), BBoxQuery(minx=29.0, miny=41.0, maxx=29.01, maxy=41.01, buffer_m=200)])
def test_query_box_holds_what_the_query_does(spark, query):
    west, south, east, north = images.query_box(query)
    grid = spark.range(0, 200).crossJoin(spark.range(0, 200).withColumnRenamed("id", "j")).select((F.lit(40.98) + F.col("id") * 0.0003).alias("lat"), (F.lit(28.98) + F.col("j") * 0.0003).alias("lon"))
    low, high, left, right = query.select_from(grid).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert south <= low and high <= north and west <= left and right <= east


def test_fetching(spark, tmp_path):
    ship(spark)
    chosen = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), (None,)], "image_id string")
    urls = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", None), (3, " ", None), (9, "u9", "t9")], "id int, url string, thumb_256_url string")
    folder = str(tmp_path)

    def get(url):
        if url == "u2":
            raise OSError("x" * 500)
        return url.encode()

    def put(name, data):
        from pathlib import Path

        Path(folder, name).write_bytes(data)

    loader = images.ImageDownloader(images.FrameSource(chosen), get, put)
    found = {r["image_id"]: (r["status"], r["error"]) for r in loader.fetch_from_urls(chosen, urls, 256, done=spark.createDataFrame([("4",)], "image_id string")).collect()}
    assert found == {"1": ("ok", None), "2": ("failed", f"OSError: {'x' * 500}"), "3": ("failed", "LookupError: no URL")} and (tmp_path / "1").read_text() == "t1"
    loader.lookup = lambda name, field: f"{name}/{field}" if name != "2" else None
    assert {r["image_id"]: r["status"] for r in loader.fetch(chosen, 2048).collect()} == {"1": "ok", "2": "failed", "3": "ok", "4": "ok"}
    assert (tmp_path / "3").read_text() == "3/thumb_2048_url"
    loader.lookup = None
    assert loader.fetch(chosen, 77).where("status = 'ok'").count() == 4 and (tmp_path / "4").read_text() == "4_1024.jpg"


def test_centroids_don_t_depend_on_winding():
    shell, hole, island = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (3.5, 2), (3.5, 3.5), (2, 3.5)], [(2.5, 2.5), (3, 2.5), (3, 3), (2.5, 3)]
    area, mx = 16 - 2.25 + 0.25, 16 * 2 - 2.25 * 2.75 + 0.25 * 2.75
    for rings in ([shell, hole, island], [shell[::-1], hole, island], [shell, hole[::-1], island[::-1]], [island, hole, shell]):
        assert geo.centroid(rings) == pytest.approx((mx / area, mx / area))
    parts = [[(0, 0), (1, 0), (1, 1), (0, 1)], [(10, 0), (10, 2), (12, 2), (12, 0)]]
    assert geo.centroid(parts) == pytest.approx((0.2 * 0.5 + 0.8 * 11, 0.2 * 0.5 + 0.8 * 1))
    touching = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 0), (2, 2), (0, 2)]]  # a hole that shares a corner
    assert geo.centroid(touching) == pytest.approx(((16 * 2 - 4) / 12, (16 * 2 - 4) / 12))


def test_joins_by_blocks_are_those_in_one(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(4)
    data = [(f"v{k:03d}", [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(150)]  # many ties
    corpus = spark.createDataFrame(data + [(None, [0.0] * 6), ("null", None)], "id string, embedding array<float>")
    queries = corpus.select(F.col("id").alias("query_id"), "embedding").repartition(3)
    x = np.array([v for _, v in data])
    for metric in ("ip", "l2", "cosine"):
        norm = np.linalg.norm(x, axis=1)
        far = {"ip": -(x @ x.T), "l2": ((x[:, None] - x) ** 2).sum(axis=2), "cosine": 1 - np.divide(x @ x.T, norm[:, None] * norm, out=np.zeros((150, 150)), where=norm[:, None] * norm > 0)}[metric]
        want = {(data[q][0], data[j][0], r + 1) for q in range(150) for r, j in enumerate(sorted(range(150), key=lambda j: (round(far[q, j], 6), data[j][0]))[:7])}  # noqa: B023
        for size in (64 << 20, 2000):
            monkeypatch.setattr(vector_store, "QUERY_BYTES", size)
            assert {(r["query_id"], r["id"], r["rank"]) for r in vector_store.top_k_join(corpus, queries, 7, metric).collect()} == want


def test_the_last_of_repeated_ids_wins(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<float>")
    new = spark.createDataFrame([("a", [5.0], 1), ("a", [3.0], 2), ("c", [9.0], 1), ("c", [8.0], 1)], "id string, embedding array<float>, n int")
    for df in (new, new.repartition(5)):
        assert sorted((r["id"], r["embedding"][0]) for r in vector_store.upserted(old, df, order="n").collect()) == [("a", 3.0), ("b", 2.0), ("c", 9.0)]
        assert sorted((r["id"], r["embedding"][0]) for r in vector_store.upserted(old, df.drop("n")).collect()) == [("a", 5.0), ("b", 2.0), ("c", 9.0)]


def test_versions_stay_readable(spark, tmp_path):
    store = vector_store.VectorStore(spark, str(tmp_path / "store"), "l2")
    rows = lambda low, high: spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(low, high)], "id string, embedding array<float>")
    store.add(rows(0, 5))
    before = store.query([0.0, 1.0], 10)
    store.add(rows(5, 9))
    assert before.count() == 5 and store.count() == 9  # a search from before the change
    for k in range(4):
        store.add(rows(9 + k, 10 + k))
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("v-")]) == vector_store.KEEP_VERSIONS
    assert len(store.vacuum(1)) == vector_store.KEEP_VERSIONS - 1 and vector_store.VectorStore.load(spark, str(tmp_path / "store")).count() == 13


def test_another_store_can_stand_in(spark, tmp_path):
    """VectorDB needs the contract, no more; images are found by extension in a fixed order."""
    for name in ("1.png", "1.jpg", "2.webp", "2.png", "3.gif"):
        (tmp_path / name).write_bytes(name.encode() * 9)

    class Kept:
        def add(self, rows, order=None):
            self.rows = rows

        def delete(self, ids):
            raise NotImplementedError

        def count(self):
            return self.rows.count()

        def query(self, vector, n_results=10):
            return vector_store.top_k(self.rows, vector, n_results, "cosine").select("id", "distance", F.lit("cosine").alias("metric"), "metadata")

    df = spark.createDataFrame([("1", "one", 41.0), ("2", "two", 41.1), ("3", None, None)], "image_id string, scene_narrative string, lat double")
    db = vector_store.VectorDB(Kept(), providers.ImageEmbedder())
    assert db.build(df, image_dir=str(tmp_path)) == 3
    paths = {r["image_id"]: r["_image_path"] and r["_image_path"].rsplit("/", 1)[-1] for r in vector_store.with_image_paths(df, str(tmp_path)).collect()}
    assert paths == {"1": "1.jpg", "2": "2.png", "3": None}
    found = db.search("one", str(tmp_path / "1.jpg"), 1).first()
    assert found["id"] == "1" and found["distance"] == pytest.approx(0, abs=1e-5) and found["metadata"] == {"lat": "41.0"}


def test_keywords_the_other_way(spark, monkeypatch):
    """So many clusters that terms don't go to every task: the same keywords by joins; and counts handed on early."""
    rng = np.random.default_rng(2)
    pool = ["plaza", "garden", "tower", "market", "bridge", "harbour", "chapel", "meadow"]
    rows = [(k % 3, k, " ".join(rng.choice(pool, 8))) for k in range(60)] + [(0, 99, None), (None, 98, "plaza"), (1, None, "plaza")]
    df = spark.createDataFrame(rows, "cluster int, image_id int, embedding_text string")
    read = lambda: [(r["cluster"], r["rank"], r["term"], round(r["score"], 9)) for r in keywords.extract_keywords(df, 5).orderBy("cluster", "rank").collect()]
    usual = read()
    assert len(usual) == 15
    monkeypatch.setattr(keywords, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(keywords, "FLUSH_TERMS", 5)
    assert read() == usual


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://there:7077"
        _jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False)))

        def getConf(self):
            return {}

    session = types.SimpleNamespace(sparkContext=Context(), conf={})
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        checkpoint_dir(session)
