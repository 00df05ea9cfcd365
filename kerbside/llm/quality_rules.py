"""Quality rules: a linear-chain conditional random field labels a document's lines, and the share of content decides.

Each line has counts of its characters by class, of words that repeat the word before, and of lines equal to it in its
document. A chain of two states, boilerplate and content, is trained by maximum likelihood: the lines of documents
labelled good count as content, those of documents labelled bad as boilerplate unless good documents have the same line. Viterbi decoding gives each line the
state of the best sequence. A document stays if at least ``MIN_SHARE`` of its bytes are in content lines.

The model is fitted on at most ``max_train_docs`` labelled documents, chosen by a hash of doc_id and text, whole chains each. Scoring reads every line of every text.

Defined results. Null, empty and blank texts have no content: share 0, rejected; texts of any length are read whole. Without labelled documents of both
kinds there is nothing to learn: every line counts as content. A doc_id with contradicting labels, or a null one, is
not used for training; ids are of any type. Repeated rows and null doc_ids are scored like any others, repeated rows are learned once. Where two sequences of states score the same, Viterbi takes
boilerplate, from the last line on; a share that equals ``MIN_SHARE`` stays. No rows give no rows. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import textbytes
from kerbside.llm.frames import col, fresh

MIN_SHARE = 0.5
MAX_TRAIN_DOCS = 2000
FEATURES = 14
STEPS = 200

LOWER, UPPER, DIGIT, BLANK, MARK, SHOUT, PIPE, SYMBOL = range(8)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = LOWER
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = MARK
_CLASS[ord("!")] = SHOUT
_CLASS[ord("|")] = PIPE
_END = np.zeros(256, bool)  # a line that ends so may end a sentence
_END[[ord(c) for c in ".!?:;\"')"]] = True


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each line, its bytes, its features, its hash) for a run of texts; blank lines are left out."""
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    starts, ends = cuts[:-1], cuts[1:]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FEATURES)), np.zeros(0, np.uint64)
    classes = _CLASS[data]
    capital = np.zeros(len(data), bool)  # Latin letters above ASCII: their second byte tells
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    classes[capital] = UPPER
    n = len(starts)
    counts = np.bincount(np.repeat(np.arange(n) * 8, ends - starts) + classes, minlength=n * 8).reshape(n, 8)
    first, last = textbytes.runs(textbytes.WORD[data], cuts)
    line = np.searchsorted(starts, first, "right") - 1
    words = np.bincount(line, minlength=n)
    hashes = textbytes.span_hashes(data, first, last)
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[again], minlength=n)
    docs = textbytes.owner(starts, offsets)

    full = np.flatnonzero(counts.sum(axis=1) > counts[:, BLANK])
    counts, words, repeats, docs, starts, ends = counts[full], words[full], repeats[full], docs[full], starts[full], ends[full]
    solid = ends - starts - counts[:, BLANK]
    trimmed = ends - (data[ends - 1] == 10)
    whole = textbytes.span_hashes(data, starts, trimmed)
    _, where, twins = np.unique(np.stack([docs.astype(np.uint64), whole]), axis=1, return_inverse=True, return_counts=True)
    capitals = counts[:, UPPER] / solid
    some = np.maximum(words, 1)
    features = np.stack(
        [
            np.ones(len(full)),
            capitals,
            capitals > 0.5,
            np.minimum(1, 4 * counts[:, SYMBOL] / solid),
            np.minimum(1, counts[:, SHOUT] / some),
            np.minimum(1, 2 * counts[:, PIPE] / some),
            counts[:, DIGIT] / solid,
            repeats / some,
            repeats > 0.5 * words,
            np.log1p(solid) / 8,
            words < 4,
            _END[data[np.maximum(trimmed - 1, starts)]],
            np.minimum(1, counts[:, MARK] / some),
            np.minimum(1, (twins[where.ravel()] - 1) / 4),
        ],
        axis=1,
    )
    return docs, ends - starts, features, whole


@dataclass
class Chain:
    """Weights (states, features), transitions (from, to) and the scores of the first state. State 1 is content."""

    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def decode(self, docs: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The states of the best sequences (Viterbi); docs is sorted, its runs are the chains."""
        scores = features @ self.weights.T
        if not len(docs):
            return np.zeros(0, np.int64)
        heads = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        lengths = np.diff(np.append(heads, len(docs)))
        heads, lengths = heads[o := np.argsort(-lengths, kind="stable")], lengths[o]
        best = scores.copy()
        best[heads] += self.first
        came = np.zeros((len(docs), 2), np.int8)
        alive = len(heads)
        for t in range(1, lengths[0]):
            alive = int(np.searchsorted(-lengths, -t, "left"))
            at = heads[:alive] + t
            ways = best[at - 1][:, :, None] + self.steps
            came[at] = ways.argmax(axis=1)
            best[at] += ways.max(axis=1)
        states = np.zeros(len(docs), np.int64)
        ends = heads + lengths - 1
        states[ends] = best[ends].argmax(axis=1)
        for t in range(lengths[0] - 1, 0, -1):
            alive = int(np.searchsorted(-lengths, -t, "left"))
            at = heads[:alive] + t
            states[at - 1] = came[at, states[at]]
        return states


def _likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, heads: np.ndarray, lengths: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Minus the mean log-likelihood a line and its gradient, by forward-backward over all chains at once; heads go by falling length."""
    n = x.shape[1]
    w, a, p = theta[: 2 * n].reshape(2, n), theta[2 * n : -2].reshape(2, 2), theta[-2:]
    s = x @ w.T
    s[heads] += p
    top = s.max(axis=1, keepdims=True)
    e, steps = np.exp(s - top), np.exp(a)
    forward, scale, backward = e.copy(), np.empty(len(x)), np.ones_like(e)
    longest = lengths[0]
    alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = heads[: alive[t]] + t
        if t:
            forward[at] *= forward[at - 1] @ steps
        scale[at] = forward[at].sum(axis=1)
        forward[at] /= scale[at, None]
    for t in range(longest - 1, 0, -1):
        at = heads[: alive[t]] + t
        backward[at - 1] = (e[at] * backward[at]) @ steps.T / scale[at, None]
    marginal = forward * backward
    marginal /= marginal.sum(axis=1, keepdims=True)
    inner = np.ones(len(x), bool)
    inner[heads] = False
    now = np.flatnonzero(inner)
    pair = forward[now - 1][:, :, None] * steps * (e[now] * backward[now] / scale[now, None])[:, None, :]
    truth = np.eye(2)[y]
    seen = np.einsum("ni,nj->ij", truth[now - 1], truth[now])
    gradient = np.concatenate([((truth - marginal).T @ x).ravel(), (seen - pair.sum(axis=0)).ravel(), (truth - marginal)[heads].sum(axis=0)])
    value = s[np.arange(len(x)), y].sum() + (seen * a).sum() - np.log(scale).sum() - top.sum()
    return -value / len(x) + 0.5 * ridge * theta @ theta, -gradient / len(x) + ridge * theta


def fit(chains: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, ridge: float = 1e-5) -> Chain:
    """Maximum likelihood for whole chains of (features, states), by BFGS: the likelihood is concave."""
    chains = sorted((c for c in chains if len(c[0])), key=lambda c: -len(c[0]))
    if len({int(v) for _, s in chains for v in (s.min(), s.max())}) < 2:
        return Chain(np.stack([np.zeros(FEATURES), np.eye(FEATURES)[0]]), np.zeros((2, 2)), np.zeros(2))
    lengths = np.array([len(f) for f, _ in chains])
    heads = np.cumsum(lengths) - lengths
    x, y = np.concatenate([f for f, _ in chains]), np.concatenate([s for _, s in chains])
    theta = np.zeros(2 * x.shape[1] + 6)
    inverse = np.eye(len(theta))
    value, gradient = _likelihood(theta, x, y, heads, lengths, ridge)
    for _ in range(steps):
        way = -inverse @ gradient
        size, slope = 1.0, gradient @ way
        while True:
            after, slope_after = _likelihood(theta + size * way, x, y, heads, lengths, ridge)
            if after <= value + 1e-4 * size * slope or size < 1e-9:
                break
            size /= 2
        moved, turned = size * way, slope_after - gradient
        theta, gained = theta + moved, value - after
        value, gradient = after, slope_after
        if gained < 1e-9 or np.abs(gradient).max() < 1e-6:
            break
        curve = moved @ turned
        if curve > 1e-12:
            turn = np.eye(len(theta)) - np.outer(moved, turned) / curve
            inverse = turn @ inverse @ turn.T + np.outer(moved, moved) / curve
    n = x.shape[1]
    return Chain(theta[: 2 * n].reshape(2, n), theta[2 * n : -2].reshape(2, 2), theta[-2:])


def train(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", quality="quality", max_train_docs=MAX_TRAIN_DOCS) -> Chain:
    """A chain fitted on at most max_train_docs documents of labels (doc_id, quality 0 or 1)."""
    told = labels.select(col(labels, doc_id).alias("_id"), col(labels, quality).cast("int").alias("_good")).where("_id IS NOT NULL AND _good IN (0, 1)")
    told = told.groupBy("_id").agg(F.min("_good").alias("_good"), F.max("_good").alias("_most")).where("_good = _most").drop("_most")
    some = told.orderBy(F.xxhash64("_id"), "_id").limit(max_train_docs)
    rows = docs.select(col(docs, doc_id).alias("_id"), col(docs, text).alias("_text")).join(F.broadcast(some), "_id")
    rows = rows.select("_id", "_good", "_text", F.xxhash64("_id", "_text").alias("_h"))
    # Ids may repeat: of their rows, so many again, each text once.
    few = rows.select("_h", "_id").distinct().orderBy("_h", "_id").limit(max_train_docs).select("_h")
    chosen = rows.join(F.broadcast(few.distinct()), "_h").groupBy("_h", "_id", "_good").agg(F.first("_text").alias("_text")).select("_text", "_good", "_h")

    def lines(batches):
        for batch in batches:
            texts, good, ids = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for row, data, offsets in textbytes.slices(texts):
                rows, _, features, hashes = line_features(data, offsets)
                for k in np.unique(rows):
                    yield pa.RecordBatch.from_pylist([{"h": int(ids[row + k]), "good": int(good[row + k]), "x": features[rows == k].ravel().tolist(), "lines": hashes[rows == k].astype(np.int64).tolist()}], schema)

    schema = pa.schema([("h", pa.int64()), ("good", pa.int32()), ("x", pa.list_(pa.float64())), ("lines", pa.list_(pa.int64()))])
    found = chosen.mapInArrow(lines, "h bigint, good int, x array<double>, lines array<bigint>").collect()
    found = sorted((r["h"], r["good"], r["x"], r["lines"]) for r in found)
    shared = {h for _, good, _, hashes in found if good for h in hashes}
    return fit([(np.reshape(x, (-1, FEATURES)), np.array([good or h in shared for h in hashes], np.int64)) for _, good, x, hashes in found])


def content_share(text: Column, chain: Chain) -> Column:
    """The share of a text's bytes, blank lines aside, that are in content lines; 0 without any."""

    @F.arrow_udf(T.DoubleType())
    def share(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for row, data, offsets in textbytes.slices(texts):
            docs, sizes, features, _ = line_features(data, offsets)
            states = chain.decode(docs, features)
            n = len(offsets) - 1
            out[row : row + n] = np.bincount(docs, sizes * (states == 1), n) / np.maximum(np.bincount(docs, sizes, n), 1)
        return pa.array(out)

    return share(text)


def keep_good(docs: DataFrame, chain: Chain, text="text", min_share=MIN_SHARE) -> DataFrame:
    """The rows of docs with enough content."""
    (share,) = fresh(docs, "_share")
    return docs.withColumn(share, content_share(col(docs, text), chain)).where(F.col(share) >= min_share).drop(share)


def good_documents(docs: DataFrame, chain: Chain, doc_id="doc_id", text="text", min_share=MIN_SHARE) -> DataFrame:
    """(doc_id, content_share) of the rows that stay."""
    return docs.select(col(docs, doc_id).alias("doc_id"), content_share(col(docs, text), chain).alias("content_share")).where(F.col("content_share") >= min_share)
