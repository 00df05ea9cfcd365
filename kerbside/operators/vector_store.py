"""A vector store: versions of a Parquet table of (id, embedding, metadata, document, cell), and exact or cell-probing search.

Every change writes a new version and then moves the manifest to it, so readers see one version or the other. The last
KEEP_VERSIONS stay, so that a DataFrame from before a change can still be read; ``vacuum`` deletes the others, after each change and on demand. With
``index_type="ivf"`` the table is partitioned by the nearest of ``nlist`` centroids. A search reads ``nprobe`` cells, and then
each further cell that a bound from its radius doesn't rule out: it finds the same rows as an exact search.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.functions.vectors import METRICS, distance, literal, ranking
from kerbside.operators.clustering import fit_kmeans, nearest_centroid
from kerbside.functions.text import file_stem
from kerbside.sources import files
from kerbside.sources.tables import IMAGE_SUFFIXES, list_images

SCHEMA = "id string, embedding array<float>, metadata map<string,string>, document string"
QUERY_BYTES = 16 << 20
#: Distances that a task holds at once.
HELD_SCORES = 1 << 21
KEEP_VERSIONS = 3
CELL_ROWS = 1 << 20


def top_k(corpus: DataFrame, query: Sequence[float], k: int = 10, metric: str = "ip", vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """corpus with distance, the k nearest rows, ties by id: each task keeps its best k, nothing is sorted as a whole."""
    scored = corpus.where(F.col(vector).isNotNull()).withColumn("distance", distance(F.col(vector), literal(query), metric))
    return scored.orderBy(ranking(F.round("distance", 6), metric), id_col).limit(k)


def top_k_join(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", vector: str = "embedding", id_col: str = "id", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, rank, distance): the k nearest of corpus for each row of queries (query_id, embedding).

    Queries that fit in QUERY_BYTES go to every task, which multiplies matrices and keeps its best k for each query. More
    queries meet the corpus on the executors: both are cut into blocks of that size by a hash, and each pair of blocks is a task.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    kind, qkind = corpus.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    rows = corpus.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    known = queries.where(F.col(vector).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    n, width = known.agg(F.count("*"), F.max(F.size("v"))).first()
    out = f"query_id {qkind}, id {kind}, distance double"
    if not n:
        return corpus.sparkSession.createDataFrame([], f"query_id {qkind}, id {kind}, rank int, distance double")
    if n * width * 8 <= QUERY_BYTES:
        held = known.collect()  # at most QUERY_BYTES
        best = rows.mapInArrow(_scorer(pa.array([r[0] for r in held]), np.array([r[1] for r in held]), k, metric), out)
    else:
        best = _by_blocks(rows, known, n * width * 8, width, k, metric, out)
    order = Window.partitionBy("query_id").orderBy(ranking(F.col("distance"), metric), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "distance")


def _by_blocks(rows: DataFrame, known: DataFrame, size: int, width: int, k: int, metric: str, out: str) -> DataFrame:
    """The best k of each pair of a query block and a corpus block."""
    across, down = -(-size // QUERY_BYTES), max(1, -(-rows.count() * width * 8 // QUERY_BYTES))
    block = lambda name, blocks: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = known.select(block("q", across).alias("qb"), every(down).alias("cb"), "q", "v")
    right = rows.select(every(across).alias("qb"), block("id", down).alias("cb"), "id", "v")

    def score(queries: pa.Table, part: pa.Table) -> pa.Table:
        found = [b for b in _scorer(queries.column("q").combine_chunks(), _matrix(queries.column("v").combine_chunks()), k, metric)(part.select(["id", "v"]).to_batches())] if len(queries) else []
        return pa.Table.from_batches(found) if found else pa.table({"query_id": queries.column("q").slice(0, 0), "id": part.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(score, out)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _scorer(names: pa.Array, q: np.ndarray, k: int, metric: str):
    """The best k for each query; queries go in groups, so that no more than HELD_SCORES distances are held."""
    sign = -1.0 if metric == "ip" else 1.0
    few = max(1, HELD_SCORES // 4096)

    def scores(q: np.ndarray, squares: np.ndarray, x: np.ndarray) -> np.ndarray:
        dots = q @ x.T
        if metric == "ip":
            return dots
        if metric == "l2":
            return np.maximum(0, squares[:, None] - 2 * dots + (x * x).sum(axis=1))
        size = np.sqrt(squares)[:, None] * np.sqrt((x * x).sum(axis=1))
        return 1 - np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)

    def better(q: np.ndarray, squares: np.ndarray, best: tuple, x: np.ndarray, name: np.ndarray) -> tuple:
        row, far, ids, limit = best
        mine = sign * (np.round(scores(q, squares, x), 6) + 0.0)
        kth = np.partition(mine, k - 1, axis=1)[:, k - 1] if mine.shape[1] > k else np.inf
        here, which = np.nonzero(mine <= np.minimum(limit, kth)[:, None])
        if not len(here):
            return best
        row, far, ids = np.concatenate([row, here]), np.concatenate([far, mine[here, which]]), np.concatenate([ids, name[which]])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], far, row))  # ties by id
        row, far, ids = row[order], far[order], ids[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        row, far, ids = row[keep], far[keep], ids[keep]
        many = np.bincount(row, minlength=len(q)) >= k
        last = np.searchsorted(row, np.arange(len(q)), "right") - 1
        return row, far, ids, np.where(many, far[np.maximum(last, 0)], np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [q[g : g + few] for g in range(0, len(q), few)]
        squares = [(g * g).sum(axis=1) for g in groups]
        bests = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.full(len(g), np.inf)) for g in groups]
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                name = np.empty(len(part), object)
                name[:] = part.column(0).to_pylist()
                x = _matrix(part.column(1))
                bests = [better(g, s, best, x, name) for g, s, best in zip(groups, squares, bests, strict=True)]
        for g, (row, far, ids, _) in enumerate(bests):
            if len(row):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row + g * few)), pa.array(ids.tolist()), pa.array(sign * far + 0.0)], ["query_id", "id", "distance"])

    return run


def upserted(old: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """old with new's rows, which replace those of the same ids.

    Of several new rows of one id the last wins: that of the greatest ``order``, a column of new that does not go into the result; without
    one, or where it ties, the greatest row by its columns in their order, so that the outcome never depends on the partitioning.
    """
    values = [c for c in new.columns if c not in (id_col, order)]
    plain = [F.to_json(F.struct(f"`{c}`")) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in new.dtypes if c in values]
    last = Window.partitionBy(f"`{id_col}`").orderBy(*([F.desc(f"`{order}`")] if order else []), *(F.desc(c) for c in plain))
    one = new.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", *([order] if order else []))
    return old.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(one, allowMissingColumns=True)


def without(old: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return old.join(ids.select(id_col).distinct(), id_col, "left_anti")


def cell_probe(corpus: DataFrame, query: Sequence[float], centroids: Sequence[Sequence[float]], k: int = 10, nprobe: int = 2, metric: str = "ip", vector: str = "embedding", id_col: str = "id", cell: str = "cell") -> DataFrame:
    """top_k among the nprobe cells (a column of corpus) whose centroids are nearest to the query; other cells are not read if corpus is partitioned by them."""
    return top_k(corpus.where(F.col(cell).isin([int(c) for c in probed(query, centroids, nprobe, metric)])), query, k, metric, vector, id_col)


def probed(query: Sequence[float], centroids: Sequence[Sequence[float]], nprobe: int, metric: str) -> np.ndarray:
    c, q = np.asarray(centroids, np.float64), np.asarray(query, np.float64)
    if metric == "ip":
        far = -(c @ q)
    elif metric == "l2":
        far = ((c - q) ** 2).sum(axis=1)
    else:
        size = np.sqrt((c * c).sum(axis=1) * (q @ q))
        far = 1 - np.divide(c @ q, size, out=np.zeros(len(c)), where=size > 0)
    return np.argsort(np.round(far, 9), kind="stable")[:nprobe]


def in_cell_space(vector: Column, metric: str) -> Column:
    """The vector as cells are made of it: for cosine over its length, so that distances there follow from angles."""
    if metric != "cosine":
        return vector

    @F.arrow_udf("array<double>")
    def over_length(vectors: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(vectors)), sizes)
        length = np.sqrt(np.bincount(row, x * x, len(vectors)))
        flat = x / np.where(length > 0, length, 1)[row]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pc.is_null(vectors))

    return over_length(vector)


def cell_radii(corpus: DataFrame, centroids: Sequence[Sequence[float]], metric: str, vector: str = "embedding", cell: str = "cell") -> list[float]:
    """The largest distance of a cell's vectors from its centroid, for each centroid; -1 for a cell without vectors."""
    c = np.asarray(centroids, np.float64)

    @F.arrow_udf("double")
    def from_centroid(vectors: pa.Array, cells: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        return pa.array(np.sqrt(((x - c[cells.to_numpy(zero_copy_only=False)]) ** 2).sum(axis=1)))

    known = corpus.where(F.col(vector).isNotNull()).select(F.col(cell).alias("cell"), in_cell_space(F.col(vector), metric).alias("v"))
    found = {r[0]: r[1] for r in known.groupBy("cell").agg(F.max(from_centroid("v", "cell"))).collect()}  # a row a cell
    return [float(found.get(k, -1.0)) for k in range(len(c))]


def cell_bounds(query: Sequence[float], centroids: Sequence[Sequence[float]], radii: Sequence[float], metric: str) -> np.ndarray:
    """What no distance in a cell is nearer than: for ip the largest inner product, else the least distance."""
    c, q, r = np.asarray(centroids, np.float64), np.asarray(query, np.float64), np.asarray(radii, np.float64)
    if metric == "ip":
        return c @ q + np.sqrt(q @ q) * r
    if metric == "l2":
        return np.maximum(0, np.sqrt(((c - q) ** 2).sum(axis=1)) - r) ** 2
    size = np.sqrt(q @ q)
    if size == 0:
        return np.ones(len(c))
    return np.maximum(0, np.sqrt(((c - q / size) ** 2).sum(axis=1)) - r) ** 2 / 2


def cell_search(corpus: DataFrame, query: Sequence[float], centroids: Sequence[Sequence[float]], radii: Sequence[float], k: int = 10, nprobe: int = 2, metric: str = "ip", vector: str = "embedding", id_col: str = "id", cell: str = "cell") -> DataFrame:
    """top_k of the whole corpus by its cells (in_cell_space), given their radii.

    The nprobe likeliest cells give a k-th distance; then those cells are read whose bound isn't beyond it. Where vectors
    are spread so that no bound rules anything out, that is every cell.
    """
    bound = cell_bounds(query, centroids, radii, metric) * (-1 if metric == "ip" else 1)
    there = [int(i) for i in np.argsort(bound, kind="stable") if radii[i] >= 0]
    first = [int(i) for i in probed(query, centroids, len(centroids), metric) if radii[i] >= 0][:nprobe]
    near = top_k(corpus.where(F.col(cell).isin(first)), query, k, metric, vector, id_col)
    far = [r[0] for r in near.select("distance").collect()]  # k rows
    if len(far) < k:
        return top_k(corpus, query, k, metric, vector, id_col)
    kth = max(-x if metric == "ip" else x for x in far)
    # Ranks are by distances rounded to 6 digits; the slack also covers what sums lose.
    kept = [i for i in there if bound[i] <= kth + 2e-6 * max(1.0, abs(kth))]
    return near if set(kept) <= set(first) else top_k(corpus.where(F.col(cell).isin(kept)), query, k, metric, vector, id_col)


class BaseVectorStore(Protocol):
    """What a store of vectors offers; VectorDB and the workflows need no more, so another store can stand in."""

    def add(self, rows: DataFrame, order: str | None = None) -> None: ...

    def delete(self, ids: Sequence[str]) -> None: ...

    def count(self) -> int: ...

    def query(self, vector: Sequence[float], n_results: int = 10) -> DataFrame:
        """(id, distance, metric, metadata) of the nearest rows."""


class VectorStore:
    """metric: ip, l2 or cosine. index_type: flat or ivf, which find the same. on_conflict: upsert, or append for duplicates."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine", index_type: str = "flat", nlist: int = 100, nprobe: int = 8, on_conflict: str = "upsert"):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
        if index_type not in ("flat", "ivf"):
            raise ValueError(f"unknown index_type {index_type!r}")
        if on_conflict not in ("upsert", "append"):
            raise ValueError(f"unknown on_conflict {on_conflict!r}")
        self.spark, self.path = spark, path.rstrip("/")
        self.state = {"metric": metric, "index_type": index_type, "nlist": nlist, "nprobe": nprobe, "on_conflict": on_conflict, "version": None, "dimension": None, "centroids": None, "radii": None}
        if files.exists(spark, f"{self.path}/manifest.json"):
            self.state = json.loads(files.read_text(spark, f"{self.path}/manifest.json"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorStore:
        """The store at path, with the settings that it was made with."""
        if not files.exists(spark, f"{path.rstrip('/')}/manifest.json"):
            raise FileNotFoundError(f"no vector store at {path}")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        if self.state["version"] is None:
            return self.spark.createDataFrame([], f"{SCHEMA}, cell int")
        return self.spark.read.parquet(f"{self.path}/{self.state['version']}")

    def _write(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows = rows.drop("cell")
        if self.state["index_type"] == "ivf":
            if self.state["centroids"] is None:
                n = rows.where("embedding IS NOT NULL").count()
                if n:
                    found, _ = fit_kmeans(rows.select(in_cell_space(F.col("embedding"), self.state["metric"]).alias("embedding")), min(self.state["nlist"], n), seeds=(42,), max_iter=20)
                    self.state["centroids"] = found.tolist()
            near = nearest_centroid(in_cell_space(F.col("embedding"), self.state["metric"]), np.array(self.state["centroids"]))["cluster"] if self.state["centroids"] else F.lit(0)
            rows.withColumn("cell", F.coalesce(near, F.lit(0))).hint("rebalance", "cell").write.option("maxRecordsPerFile", CELL_ROWS).partitionBy("cell").parquet(f"{self.path}/{version}")
            if self.state["centroids"]:
                self.state["radii"] = cell_radii(self.spark.read.parquet(f"{self.path}/{version}"), self.state["centroids"], self.state["metric"])
        else:
            rows.withColumn("cell", F.lit(0)).write.parquet(f"{self.path}/{version}")
        self.state["versions"] = [version, *self.state.get("versions", [self.state["version"]] if self.state["version"] else [])]
        self.state["version"] = version
        files.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))
        self.vacuum()

    def vacuum(self, keep: int = KEEP_VERSIONS) -> list[str]:
        """Deletes all but the last ``keep`` versions, and says which."""
        gone = self.state.get("versions", [])[max(1, keep) :]
        if gone:
            self.state["versions"] = self.state["versions"][: max(1, keep)]
            files.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))
            for version in gone:
                files.delete(self.spark, f"{self.path}/{version}")
        return gone

    def add(self, rows: DataFrame, order: str | None = None) -> None:
        """Rows of (id, embedding) and, if there, metadata and document. All vectors need the store's dimension. Of rows with one id the last by ``order`` wins."""
        have = set(rows.columns)
        new = rows.select(
            F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"),
            (F.col("metadata").cast("map<string,string>") if "metadata" in have else F.lit(None).cast("map<string,string>")).alias("metadata"),
            (F.col("document").cast("string") if "document" in have else F.lit(None).cast("string")).alias("document"), *([F.col(f"`{order}`").alias("_order")] if order else []),
        )
        sizes = [r[0] for r in new.where("embedding IS NOT NULL").select(F.size("embedding")).distinct().limit(2).collect()]
        if len(sizes) > 1 or (sizes and self.state["dimension"] not in (None, sizes[0])):
            raise ValueError(f"vectors of {sizes} dimensions don't fit a store of {self.state['dimension']}")
        self.state["dimension"] = sizes[0] if sizes else self.state["dimension"]
        old = self.rows().drop("cell")
        self._write(upserted(old, new, order="_order" if order else None) if self.state["on_conflict"] == "upsert" else old.unionByName(new.drop("_order")))

    def delete(self, ids: Sequence[str]) -> None:
        gone = self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        self._write(without(self.rows(), gone))

    def count(self) -> int:
        return self.rows().count()

    def query(self, vector: Sequence[float], n_results: int = 10) -> DataFrame:
        """(id, distance, metadata) of the nearest; fewer rows if the store has fewer."""
        rows = self.rows()
        if self.state["index_type"] == "ivf" and self.state.get("radii"):  # a store of before has none yet, and is read whole
            rows = cell_search(rows, vector, self.state["centroids"], self.state["radii"], n_results, self.state["nprobe"], self.state["metric"])
        else:
            rows = top_k(rows, vector, n_results, self.state["metric"])
        return rows.select("id", "distance", F.lit(self.state["metric"]).alias("metric"), "metadata")

    def query_many(self, queries: DataFrame, n_results: int = 10) -> DataFrame:
        """(query_id, id, rank, distance) for queries (query_id, embedding), by the whole store."""
        return top_k_join(self.rows(), queries, n_results, self.state["metric"])


def with_image_paths(df: DataFrame, image_dir: str, id_column: str = "image_id") -> DataFrame:
    """df with _image_path: the image in a folder whose stem is the row's id, null where there is none."""
    there = list_images(df.sparkSession, image_dir, recursive=False).select("path", file_stem(F.col("path")).alias("_stem"), F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)).alias("kind"))
    place = F.array_position(F.array(*map(F.lit, IMAGE_SUFFIXES)), F.col("kind"))
    first = there.groupBy("_stem").agg(F.min(F.struct(place.alias("n"), "path")).alias("best")).select("_stem", F.col("best.path").alias("_image_path"))
    return df.join(first, F.col(f"`{id_column}`").cast("string") == F.col("_stem"), "left").drop("_stem")


class VectorDB:
    """Embeds the rows of a table into a store, and searches it by text or image."""

    def __init__(self, store: BaseVectorStore, embedder):
        self.store, self.embedder = store, embedder

    def build(self, df: DataFrame, text_column: str = "scene_narrative", metadata_columns: Sequence[str] | None = None, id_column: str = "image_id", image_column: str | None = None, image_dir: str | None = None) -> int:
        """Embeds text, and images if there is a column of their paths, and adds them with metadata; lat and lon always go along.

        image_dir: a folder with an image for a row, named by its id; of several, the first kind of IMAGE_SUFFIXES counts; rows without one are embedded by their text.
        """
        if image_dir is not None:
            df, image_column = with_image_paths(df, image_dir, id_column), "_image_path"
        names = [c for c in dict.fromkeys(["lat", "lon", *(metadata_columns or [])]) if c in df.columns]
        pairs = [x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        base = df.withColumns({"document": F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), "id": F.col(f"`{id_column}`").cast("string")})
        base = base.withColumn("metadata", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"))
        self.store.add(self.embedder.embed(base, "document", "embedding", image_column).select("id", "embedding", "metadata", "document"))
        return self.store.count()

    def search(self, query_text: str | None = None, query_image: str | None = None, n_results: int = 10) -> DataFrame:
        """(id, distance, metric, and a column for each metadata key that is asked for by ``flattened``)."""
        if query_text is None and query_image is None:
            raise ValueError("a search needs a text or an image")
        return self.store.query(self.embedder.embed_one(query_text, query_image), n_results)

    @staticmethod
    def flattened(found: DataFrame, keys: Sequence[str]) -> DataFrame:
        return found.select("id", "distance", *(F.col("metadata")[k].alias(k) for k in keys))
