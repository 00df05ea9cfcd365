"""URL filters: gradient-boosted trees over lexical features, trained from labelled URLs.

Features: length of the URL, host, path and query; depth; labels and hyphens of the host and its longest label; shares
of digits and of other signs; entropy of the characters; number of parameters; scheme, port, fragment; and for each of
the host's last one, two and three labels how often and how ill the labelled URLs with that suffix were labelled. All are
JVM expressions, and trees are fitted and applied by Spark's own GBTClassifier.

The trees are fitted on at most ``max_train_urls`` labelled URLs, chosen by a hash (half of each label if that choice has
only one). The suffix statistics count all labelled URLs. A training URL's own label is left out of them, together with the
others of its fold (one of ``FOLDS``): by its own alone, a common suffix's share would tell the label. They are looked up by ordinary joins with the distinct suffixes of the URLs, and with these once by the longest suffix.

Where pages are at hand and no list, ``page_labels`` judges each page by what it shows, which its URL doesn't say; ``filter_across_hosts`` then
scores the URLs of each fold of the hosts by a model of the other folds, so that no host's pages speak for themselves.

Defined results. A null or blank URL has score null and is not blocked; a score that equals the threshold blocks. Without labelled URLs of both kinds the score is
the only label, 0.0 if there is none. Null labels are not learned. URLs of any length are read whole. Repeated rows and null ids are scored like any
others. No rows give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.frames import col, cut

MAX_TRAIN_URLS = 20_000
TREES, DEPTH = 20, 4
THRESHOLD = 0.5
SUFFIXES = (1, 2, 3)
PRIOR_WEIGHT = 4.0
FOLDS = 10

#: What a page may show of signs that are no prose, of capitals, and of words that repeat the one before.
MAX_SIGNS, MAX_CAPITALS, MAX_REPEATS = 0.05, 0.3, 0.3
HOST_FOLDS = 2


def page_labels(pages: DataFrame, url="url", html="html") -> DataFrame:
    """(url, label) of each page: 1 for one whose visible text is no prose, null for one without any."""
    shown = F.regexp_replace(col(pages, html), r"(?is)<(script|style|nav)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    rows = pages.select(col(pages, url).alias("url"), F.regexp_replace(shown, "&amp;", "&").alias("shown"))
    n = F.greatest(F.length("shown"), F.lit(1))
    signs = F.regexp_count("shown", F.lit(r"(?U)[^\w\s.,']")) / n
    capitals = F.regexp_count("shown", F.lit(r"\p{Lu}")) / n
    repeats = F.regexp_count("shown", F.lit(r"(?U)\b(\w+)\s+(?=\1\b)")) / F.greatest(F.regexp_count("shown", F.lit(r"\S+")), F.lit(1))
    ill = (signs > MAX_SIGNS) | (capitals > MAX_CAPITALS) | (repeats > MAX_REPEATS)
    return rows.select("url", F.when(F.trim("shown") != "", ill.cast("int")).alias("label"))


def _host(url: Column) -> Column:
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)|^(?=[^/])", "")
    return F.lower(F.regexp_extract(rest, r"^(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_fold(url: Column, folds: int = HOST_FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(_host(url), F.lit("")), F.lit("host")), F.lit(folds))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def lexical(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """urls (with a column url) with lexical features and the host's suffixes; the features' names."""
    url = F.trim("url")
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)|^(?=[^/])", "")
    df = urls.withColumns({"_url": url, "_host": _host(F.col("url")), "_path": F.regexp_extract(rest, r"^(?://)?[^/?#]*([^?#]*)", 1), "_query": F.regexp_extract(url, r"\?([^#]*)", 1)})
    n = F.greatest(F.length("_url"), F.lit(1)).cast("double")
    labels = F.split("_host", r"\.")
    share = lambda c: (F.length("_url") - F.length(F.replace(F.col("_url"), c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split("_url", "")), F.lit(0.0), lambda a, c: a - F.when(c != "", share(c) * F.log(share(c))).otherwise(0.0))
    features = {
        "length": F.length("_url"),
        "host_length": F.length("_host"),
        "path_length": F.length("_path"),
        "query_length": F.length("_query"),
        "depth": F.regexp_count("_path", F.lit("/[^/]+")),
        "labels": F.size(labels),
        "hyphens": _count(F.col("_host"), "-"),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "digit_share": F.regexp_count("_url", F.lit("[0-9]")) / n,
        "sign_share": F.regexp_count("_url", F.lit("[^A-Za-z0-9/.:]")) / n,
        "entropy": entropy,
        "parameters": F.when(F.col("_query") == "", 0).otherwise(_count(F.col("_query"), "&") + 1),
        "secure": F.lower("_url").startswith("https:"),
        "port": F.col("_url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:[0-9]+"),
        "fragment": F.col("_url").contains("#"),
    }
    df = df.withColumns({k: v.cast("double") for k, v in features.items()})
    df = df.withColumns({f"_suffix{k}": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - k + 1), F.lit(k)), ".") for k in SUFFIXES})
    return df.drop("_url", "_host", "_path", "_query"), list(features)


def _with_statistics(df: DataFrame, statistics: DataFrame, prior: float, own: Column | None) -> tuple[DataFrame, list[str]]:
    """df with each suffix's number of labelled URLs and smoothed share of bad ones; own: labels of a sample, to leave out by folds."""
    names = []
    keys = [f"_suffix{k}" for k in SUFFIXES]
    last = keys[-1]  # has the shorter ones in it
    hosts = df.select(*keys).where(F.col(last).isNotNull()).distinct()
    for k in SUFFIXES:
        here = statistics.where(F.col("level") == k).select(F.col("suffix").alias(f"_suffix{k}"), F.col("n").alias(f"_n{k}"), F.col("bad").alias(f"_bad{k}"))
        hosts = hosts.join(here, f"_suffix{k}", "left")
    df = df.join(hosts.drop(*keys[:-1]), last, "left")
    for k in SUFFIXES:
        fold = Window.partitionBy(f"_suffix{k}", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))
        n = F.coalesce(f"_n{k}", F.lit(0)) - (F.lit(0) if own is None else F.count("*").over(fold))
        bad = F.coalesce(f"_bad{k}", F.lit(0)) - (F.lit(0) if own is None else F.sum(own).over(fold))
        df = df.withColumns({f"suffix{k}_count": F.log1p(n.cast("double")), f"suffix{k}_bad": (bad + PRIOR_WEIGHT * prior) / (n + PRIOR_WEIGHT)}).drop(f"_n{k}", f"_bad{k}")
        names += [f"suffix{k}_count", f"suffix{k}_bad"]
    return df, names


@dataclass
class UrlModel:
    """The trees, suffix statistics (level, suffix, n, bad) and the share of bad labelled URLs; no trees if that is all there is to know."""

    trees: GBTClassificationModel | None
    statistics: DataFrame | None
    prior: float


def train(labelled: DataFrame, url="url", label="label", max_train_urls=MAX_TRAIN_URLS) -> UrlModel:
    """A model of the labelled URLs (label 1: bad), with trees fitted on at most max_train_urls of them."""
    told = labelled.select(col(labelled, url).alias("url"), col(labelled, label).cast("int").alias("label")).where("trim(url) <> '' AND label IN (0, 1)")
    suffixes = lexical(told)[0].groupBy(*(f"_suffix{k}" for k in SUFFIXES)).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"_suffix{k}").alias("suffix")) for k in SUFFIXES)))
    statistics = cut(suffixes.select("n", "bad", levels.alias("s")).groupBy("s.level", "s.suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    n, bad = statistics.where(F.col("level") == SUFFIXES[0]).agg(F.sum("n"), F.sum("bad")).first()
    if not n or bad in (0, n):
        return UrlModel(None, None, float(bad / n) if n else 0.0)
    by_hash = [F.xxhash64("url"), "url", "label"]
    sample = cut(told.orderBy(*by_hash).limit(max_train_urls))
    if sample.select("label").distinct().count() < 2:
        good, ill = (told.where(F.col("label") == y).orderBy(*by_hash).limit(max(1, max_train_urls // 2)) for y in (0, 1))
        sample = cut(good.unionByName(ill))
    df, names = lexical(sample)
    df, more = _with_statistics(df, statistics, bad / n, F.col("label"))
    assembled = VectorAssembler(inputCols=names + more, outputCol="features").transform(df).select("features", F.col("label").cast("double"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.2).fit(cut(assembled))
    return UrlModel(trees, statistics, bad / n)


def filter_urls(pages: DataFrame, model: UrlModel, page_id="page_id", url="url", threshold=THRESHOLD) -> DataFrame:
    """(page_id, url, score, blocked) of every row."""
    rows = pages.select(col(pages, page_id).alias("page_id"), col(pages, url).alias("url"))
    known = F.trim("url") != ""
    if model.trees is None:
        scored = rows.withColumn("score", F.when(known, F.lit(model.prior)))
    else:
        df, names = lexical(rows)
        df, more = _with_statistics(df, model.statistics, model.prior, None)
        df = VectorAssembler(inputCols=names + more, outputCol="features", handleInvalid="keep").transform(df)
        scored = model.trees.transform(df).withColumn("score", F.when(known, F.round(vector_to_array("probability")[1], 6)))
    return scored.select("page_id", "url", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("blocked"))


def filter_across_hosts(pages: DataFrame, labelled: DataFrame, page_id="page_id", url="url", label="label", threshold=THRESHOLD, folds=HOST_FOLDS, max_train_urls=MAX_TRAIN_URLS) -> DataFrame:
    """(page_id, url, score, blocked) of every row; a URL's score comes from labelled URLs of hosts of the other folds alone."""
    told = cut(labelled.select(col(labelled, url).alias("url"), col(labelled, label).alias("label")))
    found = []
    for k in range(folds):
        model = train(told.where(host_fold(F.col("url"), folds) != k), max_train_urls=max_train_urls)
        found.append(filter_urls(pages.where(host_fold(col(pages, url), folds) == k), model, page_id, url, threshold))
    return functools.reduce(DataFrame.unionByName, found)
