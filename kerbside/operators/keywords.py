"""TF-IDF keywords: each cluster is a corpus of its own."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.session import cut, ship

MAX_FEATURES = 1000
MIN_DOCS = 3

ENGLISH = frozenset(
    """a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does
    doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no
    nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they
    this those through to too under until up us very was we were what when where which while who whom why will with would you your yours""".split()
)
#: Words that descriptions of streets have whatever the street: of pictures, places in them, colours, sizes, and an answer's own members.
STREET_SCENE = frozenset(
    """about across adjacent ahead alongside ambient angle appear appears area attributes background bearing beige beyond black block blue bottom bright
    brown building buildings camera captured car cars center central clear clearly cloudy color colour common corner count cream dark day daytime depict
    depicted depicts direction display distance distant district element elements end facing false far feature featuring foreground frame front general
    gray green grey high image including large left light line located long looking low middle multiple narrow nearby next number occluded old one orange
    overall part partially partly path pavement photo photograph picture pink place position present red right road row scene section seen setting several
    short shot showing shown shows side sides sidewalk similar single size sky small space standing street streets streetview structure structures surface
    surrounding surroundings taken tall three top toward towards true two type typical unknown upper urban various vehicle vehicles view viewed visible
    way white wide within yellow""".split()
)
#: What a task counts before it hands its counts on, and how many terms in all go to every task.
FLUSH_TERMS = 1 << 17
BROADCAST_TERMS = 1 << 19
#: Texts that a Python worker unpacks at once.
TEXTS = 256


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def terms(text: Column, stop_words: Iterable[str], bigrams: bool = True) -> Column:
    """Words that are no stop words, and pairs of such words that follow one another once stop words are gone."""
    stop = sorted(set(stop_words))
    words = tokens(text)
    words = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
    if not bigrams:
        return words
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def extract_keywords(df: DataFrame, n_keywords: int = 10, stop_words: Iterable[str] = ENGLISH | STREET_SCENE, text: str = "embedding_text", cluster: str = "cluster", id_col: str = "image_id", bigrams: bool = True, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> DataFrame:
    """(cluster, rank, term, score): the terms of the highest mean TF-IDF.

    A term must occur in max(min_docs, documents // 50) of the cluster's documents. Of those terms the max_features most
    frequent count, ties by term. A document's weights are scaled to length 1 over them; means are over all documents,
    also those without any term. Ties of the rounded score go to the later term. Rows without a cluster or an id do not
    count; a null text has no terms. Clusters with too few documents give no rows.
    """
    ship(df.sparkSession)
    stop = frozenset(stop_words)
    docs = df.select(F.col(cluster).alias("cluster"), F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("cluster IS NOT NULL AND id IS NOT NULL")
    sizes = docs.groupBy("cluster").agg(F.count("*").alias("docs"))
    kind = docs.schema["cluster"].dataType.simpleString()
    texts = docs.select("cluster", "text")

    def frequent(pairs: bool, words: dict | None) -> DataFrame:
        counts = texts.mapInArrow(_counter(stop, pairs, words), f"cluster {kind}, term string, df bigint, total bigint")
        found = counts.groupBy("cluster", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).join(sizes, "cluster")
        return found.where(F.col("df") >= F.greatest(F.lit(min_docs), F.floor(F.col("docs") / 50)))

    vocabulary = cut(frequent(False, None))
    if bigrams:
        # A pair is in no more documents than either of its words, so pairs with a rare word need not be counted.
        words = _by_cluster(vocabulary, "df") if vocabulary.count() <= BROADCAST_TERMS else None
        vocabulary = vocabulary.unionByName(frequent(True, words))
    # row_number() <= max_features is a limit for each group: every task keeps no more rows than that before the shuffle.
    top = Window.partitionBy("cluster").orderBy(F.desc("total"), "term")
    features = vocabulary.withColumn("r", F.row_number().over(top)).where(F.col("r") <= max_features)
    idf = F.log((F.col("docs") + 1.0) / (F.col("df") + 1.0)) + 1.0
    features = cut(features.select("cluster", "term", "docs", idf.alias("idf")))
    if features.count() <= BROADCAST_TERMS:
        sums = texts.mapInArrow(_weigher(stop, bigrams, _by_cluster(features, "idf")), f"cluster {kind}, term string, w double")
    else:
        sums = _weighed_by_join(docs, features, stop, bigrams)
    scores = sums.groupBy("cluster", "term").agg(F.sum("w").alias("w")).join(sizes, "cluster").withColumn("score", F.col("w") / F.col("docs"))
    best = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 10)), F.desc("term"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_keywords).select("cluster", "rank", "term", "score")


_WORD = re.compile(r"\b\w\w+\b")


def _by_cluster(rows: DataFrame, value: str) -> dict:
    """cluster -> term -> value, of BROADCAST_TERMS rows at most."""
    out: dict = {}
    for r in rows.select("cluster", "term", value).collect():
        out.setdefault(r["cluster"], {})[r["term"]] = r[value]
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, len(batch), TEXTS):
        part = batch.slice(at, TEXTS)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _words(text: str, stop: frozenset) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in stop]


def _pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    return zip(words, words[1:], strict=False)


def _counter(stop: frozenset, pairs: bool, known: dict | None):
    """Counts of documents and of occurrences of each cluster's words, or pairs of known words; a task's counts are added up before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, kind = 0, pa.null()

        def flush() -> pa.RecordBatch:
            every = held.items()
            cluster = pa.array((c for c, (docs, _) in every for _ in docs), kind)
            term = pa.array((t for _, (docs, _) in every for t in docs), pa.string())
            df = pa.array((d for _, (docs, _) in every for d in docs.values()), pa.int64())
            total = pa.array((totals[t] for _, (docs, totals) in every for t in docs), pa.int64())
            return pa.RecordBatch.from_arrays([cluster, term, df, total], ["cluster", "term", "df", "total"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for cluster, text in _rows(batch):
                words = _words(text, stop)
                if pairs:
                    own = known.get(cluster, ()) if known is not None else None
                    words = [f"{a} {b}" for a, b in _pairs(words) if own is None or (a in own and b in own)]
                docs, totals = held.setdefault(cluster, (Counter(), Counter()))
                size -= len(docs)
                docs.update(set(words))
                totals.update(words)
                size += len(docs)
                if size > FLUSH_TERMS:
                    yield flush()
                    held, size = {}, 0
        yield flush()

    return run


def _weigher(stop: frozenset, bigrams: bool, weights: dict):
    """Sums of each cluster's weights of terms, each document's scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for cluster, text in _rows(batch):
                idf = weights.get(cluster)
                if idf:
                    words = _words(text, stop)
                    found = Counter(w for w in words if w in idf)
                    if bigrams:
                        found.update(t for a, b in _pairs(words) if (t := f"{a} {b}") in idf)
                    mine = [(t, n * idf[t]) for t, n in found.items()]
                    length = math.sqrt(sum(w * w for _, w in mine))
                    into = sums.setdefault(cluster, {})
                    for t, w in mine:
                        into[t] = into.get(t, 0.0) + w / length
        rows = [(c, t, w) for c, terms_ in sums.items() for t, w in terms_.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["cluster", "term", "w"])

    return run


def _weighed_by_join(docs: DataFrame, features: DataFrame, stop: frozenset, bigrams: bool) -> DataFrame:
    """The same weights, not yet summed, where there are so many clusters that their terms don't fit in a task."""
    counts = docs.select("cluster", "id", F.explode(terms(F.col("text"), stop, bigrams)).alias("term")).groupBy("cluster", "id", "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(features, ["cluster", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cluster", "id")))
    return weighed.select("cluster", "term", (F.col("w") / length).alias("w"))


def keywords_by_cluster(found: DataFrame) -> dict[object, list[str]]:
    """extract_keywords' rows as lists, for a report."""
    out: dict[object, list[str]] = {}
    for r in found.orderBy("cluster", "rank").collect():
        out.setdefault(r["cluster"], []).append(r["term"])
    return out
