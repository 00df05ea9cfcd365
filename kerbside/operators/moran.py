"""Global and local Moran's I of labels over a nearest-neighbour graph.

Each label is a 0/1 variable: is a point of that label or not. Sums over all points and labels would be a table of
points times labels. But with rows of weights that add to 1, a label's cross product is the weight of the edges between
its own points, less its share times the weight of all edges to its points. So one count of edges by the pair of labels
at their ends serves all labels. A label with no variance (all points, or none) has a null I.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.neighbours import nearest_neighbours
from kerbside.session import cut, ship

PERMUTATIONS = 999
#: The most points whose graph a task of the permutation test holds (about 100 bytes a point); hashes are worked out so many at once.
HELD_POINTS = 1 << 23
HASHED = 1 << 14


@dataclass
class MoranResult:
    I: float | None  # noqa: E741
    expected_I: float
    p_value: float | None
    z_score: float | None


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of a standard normal, to 7 decimals (the rational approximation 26.2.17 of Abramowitz and Stegun)."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = F.lit(1.330274429)
    for a in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = F.lit(a) + t * poly
    return F.exp(-x * x / 2) * F.lit(0.3989422804014327) * t * poly


def pseudo_p(tail: Column, permutations: int = PERMUTATIONS) -> Column:
    """What a permutation test of so many rounds gives on average: never below 1 / (rounds + 1)."""
    return (F.lit(float(permutations)) * tail + F.lit(1.0)) / F.lit(permutations + 1.0)


def _large(df: DataFrame) -> DataFrame:
    """df as a side that is shuffled: the planner takes a graph for as small as the points it came from, and would send all of it through the driver."""
    return df.hint("merge")


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    ends = labels.select(F.col("id").alias("nbr_id"), F.col("label").alias("nbr_label"))
    return edges.join(_large(labels.select("id", "label")), "id").join(_large(ends), "nbr_id")


def _labels(points: DataFrame, column: str, id_col: str) -> DataFrame:
    return points.select(F.col(id_col).alias("id"), F.col(column).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")


def moran_global(points: DataFrame, column: str = "cluster", k: int = 8, id_col: str = "id", x: str = "lon", y: str = "lat", edges: DataFrame | None = None) -> DataFrame:
    """(label, n, i, expected_i, z_score, p_value) of each label.

    z_score has the mean and variance that I has over all permutations of the labels, by formula; p_value is the normal
    tail on that side, as a permutation test would report it. Points without a label do not count.
    """
    known = points.where(F.col(column).isNotNull())
    edges = cut(nearest_neighbours(known, k, id_col, x, y)) if edges is None else edges
    labels = cut(_labels(known, column, id_col))
    n = labels.count()
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    pairs = _labelled(edges, labels).groupBy("label", "nbr_label").agg(F.sum("w").alias("w"))
    own = pairs.where("label = nbr_label").select("label", F.col("w").alias("own"))
    into = pairs.groupBy(F.col("nbr_label").alias("label")).agg(F.sum("w").alias("into"))
    # S0, S1, S2 of the weights: they are the graph's alone.
    back = edges.select(F.col("id").alias("nbr_id"), F.col("nbr_id").alias("id"), F.col("w").alias("wb"))
    both = edges.join(_large(back), ["id", "nbr_id"], "left").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") * F.coalesce("wb", F.lit(0.0))).alias("wb")).first()
    columns = edges.groupBy(F.col("nbr_id").alias("id")).agg(F.sum("w").alias("c"))
    rows = edges.groupBy("id").agg(F.sum("w").alias("r"))
    s2 = rows.join(_large(columns), "id", "full").agg(F.sum(F.pow(F.coalesce("r", F.lit(0.0)) + F.coalesce("c", F.lit(0.0)), 2))).first()[0] or 0.0
    s0, s1 = both["s0"] or 0.0, (both["ww"] or 0.0) + (both["wb"] or 0.0)

    p = F.col("n") / F.lit(float(max(n, 1)))
    z2 = F.lit(float(n)) * p * (1 - p)
    i = (F.coalesce("own", F.lit(0.0)) - p * F.coalesce("into", F.lit(0.0))) / F.nullif(z2, F.lit(0.0)) * F.lit(n / s0 if s0 else 1.0)
    expected = -1.0 / (n - 1) if n > 1 else 0.0
    out = sizes.join(own, "label", "left").join(into, "label", "left")
    if n < 4 or not s0:
        none = F.lit(None).cast("double")
        return out.select("label", "n", i.alias("i"), F.lit(expected).alias("expected_i"), none.alias("z_score"), none.alias("p_value"))
    kurtosis = (1 - 3 * p * (1 - p)) / F.nullif(p * (1 - p), F.lit(0.0))
    a = F.lit(float(n)) * (F.lit((n * n - 3.0 * n + 3) * s1 - n * s2 + 3 * s0 * s0))
    b = kurtosis * F.lit((n * n - n) * s1 - 2.0 * n * s2 + 6 * s0 * s0)
    variance = (a - b) / F.lit((n - 1.0) * (n - 2.0) * (n - 3.0) * s0 * s0) - F.lit(expected * expected)
    z = (F.col("i") - F.lit(expected)) / F.sqrt(F.when(F.col("variance") > 0, F.col("variance")))
    found = out.select("label", "n", i.alias("i"), variance.alias("variance")).withColumn("z_score", z)
    return found.select("label", "n", "i", F.lit(expected).alias("expected_i"), "z_score", pseudo_p(normal_tail(F.col("z_score"))).alias("p_value"))


def moran_results(found: DataFrame) -> dict:
    """moran_global's rows (one a label) by label."""
    return {r["label"]: MoranResult(r["i"], r["expected_i"], r["p_value"], r["z_score"]) for r in found.orderBy("label").collect()}


def hypergeometric(x: Column, draws: int, marked: Column, others: Column) -> Column:
    """P(X = x) for draws without repeating from marked and other items; all unrolled, draws is a graph's k."""
    comb = F.lit(1.0)
    for j in range(draws):
        comb = comb * F.when(F.lit(j) < x, (draws - j) / (F.lit(j) + 1.0)).otherwise(1.0)
    product = F.lit(1.0)
    for i in range(draws):
        hit = marked - i
        miss = others - (i - x)
        term = F.when(F.lit(i) < x, hit).otherwise(miss) / (marked + others - i)
        product = product * F.greatest(term, F.lit(0.0))
    return comb * product


def moran_local(points: DataFrame, column: str = "cluster", p_threshold: float = 0.05, k: int = 8, id_col: str = "id", x: str = "lon", y: str = "lat", edges: DataFrame | None = None) -> DataFrame:
    """points with lisa_cluster, lisa_p_value and lisa_significant for each point's own label.

    The number of a point's neighbours with its label is hypergeometric over conditional permutations, so p is exact:
    the smaller tail, as a permutation test of 999 rounds would report it. lisa_cluster is 1 (more than the label's share
    among the neighbours) or 4 (no more) where p is below the threshold, else 0. A point without any such neighbour has
    the least p. Points without a label, and labels of all points, get 0, null and false.
    """
    known = points.where(F.col(column).isNotNull())
    edges = cut(nearest_neighbours(known, k, id_col, x, y)) if edges is None else edges
    labels = cut(_labels(known, column, id_col))
    n = labels.count()
    near = _labelled(edges, labels).groupBy("id").agg(F.first("label").alias("label"), F.count_if(F.col("label") == F.col("nbr_label")).alias("same"), F.count("*").alias("k"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("m"))
    cases = near.groupBy("label", "same", "k").agg(F.lit(1).alias("one")).join(sizes, "label").where(F.col("m") < n)
    # p is worked out once for each case (label, own neighbours): labels times k + 1 rows.
    marked, others = (F.col("m") - 1).cast("double"), F.lit(float(n)) - F.col("m")
    mass = [hypergeometric(F.lit(j), d, marked, others) for d in (min(k, max(n - 1, 0)),) for j in range(d + 1)]
    at_least = sum((F.when(F.col("same") <= j, q).otherwise(0.0) for j, q in enumerate(mass)), F.lit(0.0))
    below = sum((F.when(F.col("same") > j, q).otherwise(0.0) for j, q in enumerate(mass)), F.lit(0.0))
    p = pseudo_p(F.least(at_least, below, F.lit(0.5)))
    high = F.col("same") / F.col("k") > F.col("m") / F.lit(float(max(n, 1)))
    cases = cases.select("label", "same", "k", p.alias("lisa_p_value"), F.when(high, 1).otherwise(4).alias("quadrant"))
    found = near.join(cases, ["label", "same", "k"]).select(F.col("id").alias("_id"), "quadrant", "lisa_p_value")
    out = points.join(_large(found), F.col(f"`{id_col}`") == F.col("_id"), "left").drop("_id")
    sure = F.coalesce(F.col("lisa_p_value") < p_threshold, F.lit(False))
    return out.withColumns({"lisa_cluster": F.when(sure, F.col("quadrant")).otherwise(0), "lisa_significant": sure}).drop("quadrant")


def moran_permutations(points: DataFrame, column: str = "cluster", permutations: int = 99, k: int = 8, id_col: str = "id", x: str = "lon", y: str = "lat", edges: DataFrame | None = None) -> DataFrame:
    """(label, i, larger, p_value): the permutation test itself, with permutations fixed by md5(id, round).

    Each round deals the labels to the points in the order of a hash: a sort of all points for each round, which is what the
    test asks for; moran_global's formula has the same mean and variance without it. Rounds are shared out among tasks that
    hold the graph and deal one round after the other, so no table of points times rounds is made; a graph of more than
    HELD_POINTS points is dealt by shuffles instead.
    """
    known = points.where(F.col(column).isNotNull())
    edges = cut(nearest_neighbours(known, k, id_col, x, y)) if edges is None else edges
    labels = cut(_labels(known, column, id_col))
    n = max(labels.count(), 1)
    dealer = _dealt_in_tasks if n <= HELD_POINTS else _dealt_by_shuffles
    p, own = F.col("m") / F.lit(float(n)), F.col("own") - F.col("m") / F.lit(float(n)) * F.col("into")
    i = F.round(own / F.nullif(F.lit(float(n)) * p * (1 - p), F.lit(0.0)), 10)
    values = dealer(edges, labels, permutations).select("round", "label", i.alias("i"))
    real = values.where("round = 0").select("label", F.col("i").alias("real"))
    counted = values.where("round > 0").join(real, "label").groupBy("label").agg(F.first("real").alias("i"), F.count_if(F.col("i") >= F.col("real")).alias("larger"))
    fold = F.least(F.col("larger"), F.lit(permutations) - F.col("larger"))
    return counted.select("label", "i", "larger", ((fold + 1.0) / F.lit(permutations + 1.0)).alias("p_value"))


def _dealt_by_shuffles(edges: DataFrame, labels: DataFrame, permutations: int) -> DataFrame:
    """(round, label, m, own, into): a label's points, the weight of edges between them and of all edges to them."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("round")
    key = F.when(F.col("round") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("round").cast("string"))))
    every = labels.select("id", "label", rounds).withColumn("key", key)
    # Round 0 keeps the labels. In the others, the point at a rank by hash gets the label at that rank by id.
    by_hash = every.select("round", "id", F.row_number().over(Window.partitionBy("round").orderBy("key", "id")).alias("at"))
    by_id = every.select("round", "label", F.row_number().over(Window.partitionBy("round").orderBy("id")).alias("at"))
    dealt = by_hash.join(_large(by_id), ["round", "at"]).select("round", "id", "label")
    ends = dealt.select("round", F.col("id").alias("nbr_id"), F.col("label").alias("nbr_label"))
    pairs = edges.join(_large(dealt), "id").join(_large(ends), ["round", "nbr_id"]).groupBy("round", "label", "nbr_label").agg(F.sum("w").alias("w"))
    own = pairs.groupBy("round", "label").agg(F.sum(F.when(F.col("label") == F.col("nbr_label"), F.col("w")).otherwise(0.0)).alias("own"))
    into = pairs.groupBy("round", F.col("nbr_label").alias("label")).agg(F.sum("w").alias("into"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("m")).select("label", "m", rounds)
    frame = sizes.join(own, ["round", "label"], "left").join(into, ["round", "label"], "left")
    return frame.select("round", "label", "m", F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("into", F.lit(0.0)).alias("into"))


def _dealt_in_tasks(edges: DataFrame, labels: DataFrame, permutations: int) -> DataFrame:
    """The same by tasks that hold the graph, each for its share of the rounds."""
    spark = labels.sparkSession
    ship(spark)
    # Places by id: rows count on within the partitions of a sort, whose sizes are a number each.
    inorder = cut(labels.repartitionByRange("id").sortWithinPartitions("id"))
    part = F.spark_partition_id()
    sizes = dict((r[0], r[1]) for r in inorder.groupBy(part.alias("part")).count().collect())
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)])]).tolist()
    first = F.element_at(F.array(*(F.lit(int(b)) for b in before)), part + 1)
    at = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + first).cast("int")
    placed = cut(inorder.select("id", "label", at.alias("at")))
    ends = placed.select(F.col("id").alias("nbr_id"), F.col("at").alias("to"))
    arcs = edges.select("id", "nbr_id", "w").join(_large(ends), "nbr_id").groupBy("id").agg(F.collect_list("to").alias("to"), F.collect_list(F.col("w").cast("double")).alias("w"))
    blocks = max(1, min(permutations + 1, spark.sparkContext.defaultParallelism))
    graph = cut(placed.join(_large(arcs), "id", "left").select("at", F.col("id").cast("string").alias("name"), "label", "to", "w"))
    rows = graph.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*").repartitionById(blocks, "block")
    kind = labels.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_dealer(permutations, blocks), f"round int, label {kind}, m bigint, own double, into double")


def _dealer(permutations: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, to, counts, weights, values, groups, chunks = 0, [], [], [], [], [], {}, []
        for batch in batches:
            if not len(batch):
                continue
            block = batch.column(0)[0].as_py()
            place, near = batch.column(1).to_numpy(), batch.column(4)
            at.append(place)
            chunks.append(batch.column(3))
            counts.append(pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False).astype(np.int32))
            to.append(near.flatten().to_numpy())
            w = batch.column(5).flatten().to_numpy()
            weights.append(w[:1] if len(w) and (w == w[0]).all() else w)
            names = batch.column(2)
            sizes = pc.binary_length(names).to_numpy()
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                text = "".join(names.take(pa.array(mine)).to_pylist()).encode()
                wide = np.zeros((len(mine), -(-int(size) // 4) * 4), np.uint8)
                wide[:, :size] = np.frombuffer(text, np.uint8).reshape(len(mine), size)
                groups.setdefault(int(size), []).append((place[mine], np.ascontiguousarray(wide.view("<u4").T)))
        if not at:
            return
        groups = {size: (np.concatenate([g[0] for g in parts]), np.concatenate([g[1] for g in parts], axis=1)) for size, parts in groups.items()}
        coded = pa.chunked_array(chunks).combine_chunks().dictionary_encode()
        values, m = coded.dictionary, len(coded.dictionary)
        at = np.concatenate(at)
        n = len(at)
        code = np.empty(n, np.uint8 if m <= 256 else np.int32)
        code[at] = coded.indices.to_numpy()
        same_w = len({float(w[0]) for w in weights if len(w)}) <= 1 and all(len(w) <= 1 or len(t) == 1 for w, t in zip(weights, to, strict=True))
        one = next((float(w[0]) for w in weights if len(w)), 0.0)
        into_w = np.zeros(n)
        for t, w in zip(to, weights, strict=True):
            into_w += np.bincount(t, None if same_w else np.broadcast_to(w, len(t)), n) * (one if same_w else 1.0)
        lots = np.bincount(code, minlength=m)
        starts = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
        for r in range(block, permutations + 1, blocks):
            dealt = code if r == 0 else _deal(code, groups, f"|{r}".encode(), n)
            own = np.zeros(m)
            for s, c, t, w in zip(starts[:-1], counts, to, weights, strict=True):
                mine = np.repeat(dealt[at[s : s + len(c)]], c)
                same = mine == dealt[t]
                own += np.bincount(mine[same], None if same_w else np.broadcast_to(w, len(t))[same], m) * (one if same_w else 1.0)
            into = np.bincount(dealt, into_w, m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, r, np.int32)), values, pa.array(lots), pa.array(own), pa.array(into)], ["round", "label", "m", "own", "into"])

    return run


def _deal(code: np.ndarray, groups: dict, suffix: bytes, n: int) -> np.ndarray:
    """The labels by place, given to the places in the order of md5(name + suffix), ties by place."""
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    keys, done = np.empty(n, np.uint64), 0
    for size, (places, words) in groups.items():
        for s in range(0, len(places), HASHED):
            head = md5_head(words[:, s : s + HASHED], size, suffix)
            keys[done : done + len(head)] = (head & ~low) | places[s : s + HASHED].astype(np.uint64)
            done += len(head)
    keys.sort()
    order = (keys & low).astype(np.int64)
    # The few whose first bits are the same are put in order by the whole hash.
    tied = np.flatnonzero((keys[1:] >> bits) == (keys[:-1] >> bits))
    if len(tied):
        wanted = np.unique(np.concatenate([order[tied], order[tied + 1]]))
        whole = {}
        for size, (places, words) in groups.items():
            for j in np.flatnonzero(np.isin(places, wanted)):
                whole[int(places[j])] = hashlib.md5(np.ascontiguousarray(words[:, j]).tobytes()[:size] + suffix).digest()
        for run in np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1):
            order[run[0] : run[-1] + 2] = sorted(order[run[0] : run[-1] + 2].tolist(), key=lambda a: (whole[a], a))
    dealt = np.empty_like(code)
    dealt[order] = code
    return dealt


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def md5_head(words: np.ndarray, size: int, suffix: bytes) -> np.ndarray:
    """The first 64 bits of the MD5 of many texts of one size, given as little-endian words in rows, each with the same suffix."""
    total = size + len(suffix)
    span = ((total + 8) // 64 + 1) * 64
    rest = bytearray(span)
    rest[size:total] = suffix
    rest[total] = 0x80
    rest[-8:] = (8 * total).to_bytes(8, "little")
    fixed = np.frombuffer(bytes(rest), "<u4")
    start = [np.full(words.shape[1], v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for first in range(0, span // 4, 16):
        a, b, c, d = start
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += np.uint32((_SINES[i] + int(fixed[first + g])) & 0xFFFFFFFF)
            if first + g < len(words):
                f += words[first + g]
            turned = f << np.uint32(_TURNS[i])
            f >>= np.uint32(32 - _TURNS[i])
            turned |= f
            turned += b
            a, d, c, b = d, c, b, turned
        start = [x + y for x, y in zip(start, (a, b, c, d), strict=True)]
    return (start[0].byteswap().astype(np.uint64) << np.uint64(32)) | start[1].byteswap().astype(np.uint64)
