"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Texts become counts of hashed byte 2-, 3- and 4-grams of lower-case letters. The family is the likeliest one under
multinomial naive Bayes. Within a family of several languages each pair has a linear SVM, trained by dual coordinate
descent on the square roots of the gram frequencies; the language with most votes wins, ties go to the larger sum of
margins, then to the earlier code.

The models are fitted on at most ``max_train_docs`` labelled documents, the same number of each language as far as it goes, chosen by a hash of doc_id and text; each sends a vector
of fixed size to the driver. Scoring reads whole texts.

Defined results. Null text and text without a letter have family and language null; texts of any length are read whole. Without labelled documents all have.
Labels that are null are not learned, nor are rows of a null doc_id; a language that no family lists is a family of its own. Repeated rows and null
doc_ids are scored like any others, repeated rows are learned once. Equally likely families: the first by name. No rows give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import textbytes
from kerbside.llm.frames import col

BUCKETS = 4096
MAX_TRAIN_DOCS = 2000
PASSES = 20
ROWS = 256

FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "is"], "germanic"),
    **dict.fromkeys(["fr", "es", "it", "pt", "ro", "ca", "gl"], "romance"),
    **dict.fromkeys(["ru", "pl", "cs", "uk", "sk", "bg", "sr", "hr", "sl"], "slavic"),
}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_LETTER[65:91] = range(97, 123)


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed grams, shape (texts, BUCKETS); texts without a letter have none."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, data, offsets in textbytes.slices(texts):
        letters = _LETTER[data].astype(np.uint32)
        n = len(offsets) - 1
        docs = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        gram = letters
        total = np.zeros(n * BUCKETS)
        for size in (2, 3, 4):
            if len(letters) < size:
                break
            gram = (gram[: len(letters) - size + 1] << np.uint32(8)) | letters[size - 1 :]
            inside = (docs[: len(gram)] == docs[size - 1 :]) & (gram & np.uint32(0xFFFF) != 0x2020)
            hashed = ((gram[inside] + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(20)
            total += np.bincount(docs[: len(gram)][inside].astype(np.int64) * BUCKETS + hashed, minlength=n * BUCKETS)
        some = np.bincount(docs, letters != 32, n) > 0
        out[row : row + n] = total.reshape(n, BUCKETS) * some[:, None]
    return out


def _unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = PASSES, seed: int = 0) -> np.ndarray:
    """The weights, bias last, of an L2-regularised squared-hinge linear SVM for y in {-1, 1}: dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diagonal = (x * x).sum(axis=1) + 0.5 / cost
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            after = max(0.0, alpha[i] - gradient / diagonal[i])
            if after != alpha[i]:
                w += (after - alpha[i]) * y[i] * x[i]
                alpha[i] = after
    return w


@dataclass
class Model:
    """families and their log-likelihoods of the grams; languages of each family; one SVM for each pair of languages of a family."""

    families: list[str] = field(default_factory=list)
    likelihood: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, counts: np.ndarray) -> list[tuple[str | None, str | None]]:
        if not self.families:
            return [(None, None)] * len(counts)
        best = (counts @ self.likelihood.T).argmax(axis=1)
        some, x = counts.any(axis=1), _unit(counts)
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(counts)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(some & (best == k))
            codes = self.languages[family]
            votes, margins = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for a, b in combinations(range(len(codes)), 2):
                w = self.pairs[codes[a], codes[b]]
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                margins[:, a] += m
                margins[:, b] -= m
            for row, pick in zip(rows, np.lexsort((margins, votes), axis=1)[:, -1] if len(codes) > 1 and len(rows) else [0] * len(rows), strict=True):
                out[row] = (family, codes[pick])
        return out


def fit(counts: np.ndarray, labels: list[str], families: dict[str, str] = FAMILIES) -> Model:
    """A model for gram counts with their language codes."""
    labels = np.array(labels, object)
    codes = sorted(set(labels))
    of = {c: families.get(c, c) for c in codes}
    model = Model(sorted(set(of.values())))
    smooth = np.array([counts[[of[c] == f for c in labels]].sum(axis=0, dtype=np.float64) + 0.5 for f in model.families]).reshape(len(model.families), BUCKETS)
    model.likelihood = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    model.languages = {f: [c for c in codes if of[c] == f] for f in model.families}
    x = _unit(counts)
    for of_family in model.languages.values():
        for a, b in combinations(of_family, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            model.pairs[a, b] = svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
    return model


def train(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", families: dict[str, str] = FAMILIES, max_train_docs=MAX_TRAIN_DOCS) -> Model:
    """A model fitted on at most max_train_docs of the documents that have a language."""
    i, code = col(docs, doc_id), col(docs, lang)
    keys = docs.where(i.isNotNull() & code.isNotNull()).select(code.alias("_lang"), F.xxhash64(i, col(docs, text)).alias("_h")).distinct()
    languages_ = keys.select("_lang").distinct().count()
    each = max(1, max_train_docs // max(1, languages_))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    some = keys.withColumn("_n", place).where(F.col("_n") <= each).orderBy("_n", "_h").limit(max_train_docs).select("_lang", "_h")
    rows = docs.where(i.isNotNull() & code.isNotNull()).select(code.alias("_lang"), F.xxhash64(i, col(docs, text)).alias("_h"), col(docs, text).alias("_text"))
    chosen = rows.join(F.broadcast(some), ["_lang", "_h"]).groupBy("_lang", "_h").agg(F.first("_text").alias("_text"))

    @F.arrow_udf(T.BinaryType())
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for at in range(0, len(texts), ROWS) for row in gram_counts(texts.slice(at, ROWS))], pa.binary())

    rows = chosen.select(F.col("_h").alias("h"), "_lang", counted("_text").alias("x")).collect()
    rows = [(r["h"], r["_lang"], np.frombuffer(r["x"], np.float32)) for r in rows]
    rows = sorted(((h, c, x) for h, c, x in rows if x.any()), key=lambda r: r[:2])
    return fit(np.array([x for _, _, x in rows]), [c for _, c, _ in rows], families) if rows else Model()


def identified(text: Column, model: Model) -> Column:
    """struct<family, language> of a text."""

    @F.arrow_udf("struct<family: string, language: string>")
    def identify(texts: pa.Array) -> pa.Array:
        found = [x for at in range(0, len(texts), ROWS) for x in model.predict(gram_counts(texts.slice(at, ROWS)))]
        return pa.StructArray.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["family", "language"])

    return identify(text)


def languages(docs: DataFrame, model: Model, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, family, language) of every row."""
    found = docs.select(col(docs, doc_id).alias("doc_id"), identified(F.lower(col(docs, text)), model).alias("found"))
    return found.select("doc_id", "found.family", "found.language")
