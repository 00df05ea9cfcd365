"""K-Means over embeddings: Spark's own for use, and a deterministic Lloyd for fixed starts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.text import compose_text
from kerbside.functions.vectors import literal, squared_l2
from kerbside.operators import keywords, summaries
from kerbside.session import cut


@dataclass
class ClusterConfig:
    n_clusters: int | None = 10
    random_state: int = 42
    text_columns: Sequence[str] = ("scene_narrative", "semantic_tags", "place_character")
    separator: str = " | "
    k_range: tuple[int, int] = (2, 16)
    n_keywords: int = 10
    n_init: int = 10
    max_iter: int = 50


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.lit(0).alias("_"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def fit_kmeans(df: DataFrame, k: int, vector: str = "embedding", seeds: Iterable[int] = range(42, 52), max_iter: int = 50) -> tuple[np.ndarray, float]:
    """(centroids, cost) of the best of several starts. The rows are read from a checkpoint, not worked out again."""
    rows = cut(_features(df, vector))
    best = None
    for seed in seeds:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||").fit(rows)
        cost = model.summary.trainingCost
        if best is None or cost < best[1]:
            best = np.array(model.clusterCenters()), cost
    return best


def nearest_centroid(vector: Column, centroids: np.ndarray) -> Column:
    """struct<cluster, cost>: the nearest centroid, ties to the first, and the squared distance. By matrix products on Arrow batches."""
    c = np.asarray(centroids, np.float64)

    @F.arrow_udf("struct<cluster: int, cost: double>")
    def assign(vectors: pa.Array) -> pa.Array:
        ok = np.array(vectors.is_valid())
        label, cost = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        if ok.any():
            x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(ok.sum()), -1)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                near = ((part * part).sum(axis=1)[:, None] - 2 * part @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
                rows = np.flatnonzero(ok)[at : at + 4096]
                label[rows], cost[rows] = near, ((part - c[near]) ** 2).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(label), pa.array(cost)], ["cluster", "cost"], mask=pa.array(~ok))

    return assign(vector)


def assign_exact(vector: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """The nearest centroid by JVM expressions alone; distances are rounded to 9 digits first, ties go to the first."""
    distances = F.array(*(F.round(squared_l2(vector, literal(c)), 9) for c in centroids))
    return F.when(vector.isNotNull(), (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def lloyd(df: DataFrame, k: int, steps: int, vector: str = "embedding", id_col: str = "id") -> tuple[DataFrame, list[list[float]]]:
    """(df with cluster, centroids) after so many steps from the vectors of the k least ids. An empty cluster keeps its centroid."""
    known = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    centroids = [[float(x) for x in r[0]] for r in known.orderBy(id_col).limit(k).select(vector).collect()]
    for _ in range(steps):
        labelled = known.select(assign_exact(F.col(vector), centroids).alias("cluster"), F.posexplode(vector).alias("at", "x"))
        means = labelled.groupBy("cluster", "at").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x")).collect()  # k x dimensions
        for r in means:
            centroids[r["cluster"]][r["at"]] = r["x"]
    return df.withColumn("cluster", assign_exact(F.col(vector), centroids)), centroids


def inertia(df: DataFrame, centroids: Sequence[Sequence[float]], vector: str = "embedding") -> DataFrame:
    """(k, inertia) of fixed centroids."""
    distances = F.array_min(F.array(*(squared_l2(F.col(vector), literal(c)) for c in centroids)))
    return df.where(F.col(vector).isNotNull()).agg(F.lit(len(centroids)).alias("k"), F.sum(distances).alias("inertia"))


@dataclass
class SemanticClusterer:
    """Composes text, embeds it, clusters the vectors and describes the clusters.

    embedder: anything with ``embed(df, text_column, output_column)``; needed only where df has no embeddings yet.
    """

    embedder: object | None = None
    config: ClusterConfig = field(default_factory=ClusterConfig)
    embedding_column: str = "embedding"
    id_col: str = "image_id"

    def build_embedding_text(self, df: DataFrame, columns: Sequence[str] | None = None, separator: str | None = None) -> DataFrame:
        return df.withColumn("embedding_text", compose_text(df, list(columns or self.config.text_columns), self.config.separator if separator is None else separator))

    def embedded(self, df: DataFrame) -> DataFrame:
        if self.embedding_column in df.columns:
            return df
        if self.embedder is None:
            raise RuntimeError(f"df has no column {self.embedding_column!r} and there is no embedder")
        if "embedding_text" not in df.columns:
            df = self.build_embedding_text(df)
        return self.embedder.embed(df, "embedding_text", self.embedding_column)

    def find_optimal_k(self, df: DataFrame, k_range: tuple[int, int] | None = None) -> tuple[list[int], list[float]]:
        """(numbers of clusters, costs) for k_range, its end excluded."""
        ks = list(range(*(k_range or self.config.k_range)[:2]))
        rows = cut(self.embedded(df).select(self.embedding_column))
        return ks, [fit_kmeans(rows, k, self.embedding_column, self._seeds(), self.config.max_iter)[1] for k in ks]

    def _seeds(self) -> range:
        return range(self.config.random_state, self.config.random_state + self.config.n_init)

    def cluster(self, df: DataFrame, n_clusters: int | None = None, column_name: str = "cluster") -> DataFrame:
        """df with a label for each embedded row: 0 for the largest cluster, ties by the least id. Null without an embedding.

        Without any number of clusters, the one where the elbow of the costs bends most.
        """
        df = self.embedded(df)
        k = n_clusters or self.config.n_clusters
        if not k:
            k = elbow(*self.find_optimal_k(df))
        centroids, _ = fit_kmeans(df, k, self.embedding_column, self._seeds(), self.config.max_iter)
        near = nearest_centroid(F.col(self.embedding_column), centroids)["cluster"]
        found = df.select(F.col(f"`{self.id_col}`").alias("id"), near.alias("c")).where("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        order = [r["c"] for r in found.orderBy(F.desc("n"), "least").collect()]  # k rows
        renamed = F.create_map(*(F.lit(x) for pair in ((c, i) for i, c in enumerate(order)) for x in pair)) if order else None
        return df.withColumn(column_name, renamed[near] if order else F.lit(None).cast("int"))

    def extract_keywords(self, df: DataFrame, n_keywords: int | None = None, stop_words=keywords.ENGLISH | keywords.STREET_SCENE, text_column: str = "embedding_text", cluster_column: str = "cluster") -> DataFrame:
        return keywords.extract_keywords(df, n_keywords or self.config.n_keywords, stop_words, text_column, cluster_column, self.id_col)

    def analyze_categories(self, df: DataFrame, category_columns: Sequence[str] | None = None, cluster_column: str = "cluster") -> DataFrame:
        return summaries.category_profile(df, list(category_columns) if category_columns else None, cluster_column)


def elbow(ks: Sequence[int], costs: Sequence[float]) -> int:
    """The k where the costs bend most (largest second difference), the least one of ties; the last k of fewer than three."""
    if len(ks) < 3:
        return ks[-1]
    bends = [costs[i - 1] - 2 * costs[i] + costs[i + 1] for i in range(1, len(ks) - 1)]
    return ks[1 + max(range(len(bends)), key=lambda i: (bends[i], -i))]
