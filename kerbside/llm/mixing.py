"""Mixing sources to target weights, with exact quotas, by a multivariate-hypergeometric splitting tree.

1. Quotas. The largest draw that has the weights, every row once at most: the source with the fewest rows for its weight gives
   all it has, the others in proportion, rounded down. Achieved and target weights differ by less than a row of each source.
2. Blocks. The rows of a source are ranked by a keyed hash and cut into blocks of ``block_rows`` (more, where there would be
   more than MAX_BLOCKS blocks). A keyed bijection (swap-or-not) permutes the block numbers by arithmetic alone; the first
   blocks in that order are drawn, the last one cut short where the quota is not a multiple.
3. Splitting tree. At each node, half of the node's shards get a multivariate-hypergeometric draw from its vector of
   blocks by source, the other half gets the rest: every shard has the block counts of a uniform random deal, and all
   counts add up exactly. A node's generator is seeded by its number, so tasks grow the tree each for its own run of
   shards: from the root down to that run, then all below. A node holds the sources that it has blocks of, nothing else.
   The driver knows one number a source.
4. A shard takes its blocks, no block twice, and shuffles their rows locally, by a keyed hash.

Only keys (two hashes of the whole row) are counted, ranked and dealt; equal rows travel as one with a count. A text moves
twice: to where its place is known and, if drawn, to its shard. A shard is a task.

Defined results. A null source is a source of its own (weight key None). A source without a weight, or with one of 0 or less,
is not drawn; a weight without rows is passed over. A null doc_id, null or empty text and texts of any length are rows like any other. Equal
rows are interchangeable; rows of equal hashes are ordered by a second hash, then count as equal. No rows, or no weight above 0, give no rows. Other columns, whatever
their names, pass through; if one is named shard or slot, the new column's name begins with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import textbytes
from kerbside.llm.frames import col, cut, fresh, ranked

EXPONENT = 0.8
BLOCK_ROWS = 16
SHARD_ROWS = 8192
PER_BUCKET = 1 << 16
MAX_BLOCKS = 1 << 29  # numpy draws from fewer than a billion
MAX_PARTITIONS = 100_000
SHARDS_A_TASK = 1024
SEED = 20240229
ROUNDS = 24
BROADCAST_ROWS = 100_000  # sources beyond that are joined by a shuffle


def tempered(docs: DataFrame, priorities: Mapping, source="source", exponent=EXPONENT, default=1.0) -> dict:
    """Weights rows ** exponent, which lifts small sources against large ones, times a priority (``default`` where none is given)."""
    return {r[0]: priorities.get(r[0], default) * r[1] ** exponent for r in docs.groupBy(col(docs, source)).agg(F.count("*")).collect()}


def quotas(rows: Mapping, weights: Mapping) -> dict:
    """Rows to draw of each source; see 1 above."""
    able = {s: Fraction(weights[s]) for s, n in rows.items() if n > 0 and weights.get(s) is not None and weights[s] > 0}
    unit = min((rows[s] / w for s, w in able.items()), default=0)  # rows for a weight of 1
    return {s: int(unit * able[s]) if s in able else 0 for s in rows}


def _halves(counts: np.ndarray, node: int, first: int, middle: int, last: int, seed: int) -> np.ndarray:
    """What the left half of a node's shards gets."""
    total = int(counts.sum())
    return np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, total * (middle - first) // (last - first), method="marginals")


def leaves(blocks: np.ndarray, shards: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, sources, first block of each, blocks of each) for the shards from first to last that have any: leaves of the splitting tree."""
    sources = np.flatnonzero(blocks)
    stack = [(1, 0, shards, sources, np.zeros(len(sources), np.int64), np.asarray(blocks, np.int64)[sources])]
    while stack:
        node, a, b, sources, begin, counts = stack.pop()
        if b <= first or a >= last or not len(sources):
            continue
        if b - a == 1:
            yield a, sources, begin, counts
            continue
        middle = (a + b) // 2
        left = _halves(counts, node, a, middle, b, seed)
        for number, low, high, starts, here in ((2 * node + 1, middle, b, begin + left, counts - left), (2 * node, a, middle, begin, left)):
            some = here > 0
            stack.append((number, low, high, sources[some], starts[some], here[some]))


def _rounds(source: np.ndarray, block: np.ndarray, sizes: np.ndarray, seed: int, order: range) -> np.ndarray:
    x, n, s = block.astype(np.int64), sizes[source].astype(np.int64), source.astype(np.uint64)
    for r in order:
        round_ = np.uint64(seed * 1000 + r)
        key = (textbytes.mix(textbytes.mix(s + np.uint64(1)) + round_) >> np.uint64(2)).astype(np.int64)
        mirror = (key - x) % n
        most = np.maximum(x, mirror).astype(np.uint64)
        swap = textbytes.mix(textbytes.mix(most + (s << np.uint64(40))) ^ textbytes.mix(np.array([round_ + np.uint64(1 << 32)])))
        x = np.where(swap & np.uint64(1), mirror, x)
    return x


def permute(source: np.ndarray, block: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A keyed bijection of each source's block numbers: in each round a number and its mirror swap or not, by a hash of the larger."""
    return _rounds(source, block, sizes, seed, range(ROUNDS))


def unpermute(source: np.ndarray, at: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The block at a place of that order: each round undoes itself."""
    return _rounds(source, at, sizes, seed, range(ROUNDS - 1, -1, -1))


class Deal:
    """Which blocks are drawn, and how many rows of each; a few numbers a source."""

    def __init__(self, rows: list[int], drawn: list[int], block_rows: int, shards: int, seed: int):
        self.rows, self.drawn = np.array(rows, np.int64), np.array(drawn, np.int64)
        self.block_rows, self.shards, self.seed = block_rows, shards, seed
        self.blocks = -(-self.rows // block_rows)
        every = np.arange(len(self.rows))
        self.short_at = permute(every, self.blocks - 1, self.blocks, seed)
        self.missing = self.blocks * block_rows - self.rows  # what the short block lacks
        taken = -(-self.drawn // block_rows)
        # With the short block among the first ones, one block more may be needed.
        covered = taken * block_rows - np.where(self.short_at < taken, self.missing, 0)
        self.taken = np.minimum(self.blocks, taken + (covered < self.drawn))

    def blocks_of(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, source of each block, its number, rows to take of it) for a run of shards."""
        for shard, sources, begin, counts in leaves(self.taken, self.shards, first, last, self.seed):
            source = np.repeat(sources, counts)
            at = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            before = at * self.block_rows - np.where(self.short_at[source] < at, self.missing[source], 0)
            size = self.block_rows - np.where(self.short_at[source] == at, self.missing[source], 0)
            yield shard, source, unpermute(source, at, self.blocks, self.seed), np.clip(self.drawn[source] - before, 0, size)


def _key(docs: DataFrame, salt: int) -> Column:
    """A hash of the whole row; nulls count, and maps by their JSON."""
    plain = [F.to_json(F.struct(col(docs, c))) if "map<" in t or "variant" in t else col(docs, c) for c, t in docs.dtypes]
    return F.xxhash64(F.lit(salt), *(c.isNull() for c in plain), *plain)


def _places(rows: DataFrame, deal: Deal, names: DataFrame, per_bucket: int, widest: int) -> DataFrame:
    """(a, b, shard, slot), a row for each row drawn, from rows (source, a, b, c): c equal rows with the hashes a and b."""
    keyed = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).select("number", "buckets", "a", "b", "c")
    ranks = ranked(keyed, "number", ["a", "b"], per_bucket, widest)
    size = deal.block_rows
    blocks = ranks.select("*", F.explode(F.expr(f"sequence(rank div {size}, (rank + c - 1) div {size})")).alias("block"))
    blocks = blocks.select("number", "block", "a", "b", F.expr(f"greatest(rank - block * {size}, 0)").alias("from"), F.expr(f"least(rank + c - block * {size}, {size})").alias("to"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                for shard, source, block, keep in deal.blocks_of(run * SHARDS_A_TASK, (run + 1) * SHARDS_A_TASK):
                    yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(block), pa.array(np.full(len(source), shard)), pa.array(keep)], ["number", "block", "shard", "keep"])

    runs = -(-deal.shards // SHARDS_A_TASK)  # their number says nothing of the table's size, so it must not be planned as a broadcast
    table = rows.sparkSession.range(0, runs, 1, min(runs, MAX_PARTITIONS)).mapInArrow(dealt, "number bigint, block bigint, shard bigint, keep bigint")
    within = F.explode(F.expr("sequence(`from`, least(`to`, keep) - 1)")).alias("within")
    drawn = blocks.join(table.hint("merge"), ["number", "block"]).where("least(`to`, keep) > `from`").select("a", "b", "shard", "block", within)
    w = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(deal.seed), "a", "block", "within"), "a", "b", "block", "within")
    return drawn.select("a", "b", "shard", (F.row_number().over(w) - 1).cast("bigint").alias("slot"))


def mixed_documents(docs: DataFrame, weights: Mapping | DataFrame, source="source", block_rows=BLOCK_ROWS, shard_rows=SHARD_ROWS, per_bucket=PER_BUCKET, seed=SEED, places=True) -> DataFrame:
    """The rows drawn, laid out shard by shard and shuffled within each: the columns of docs and, if ``places``, shard and slot.

    weights: the target weight of each source, a mapping or a table (source, weight); only their proportions count.
    """
    spark = docs.sparkSession
    if isinstance(weights, DataFrame):
        weights = {r[0]: r[1] for r in weights.collect()}  # one row a source
    shard, slot, a, b, its_a, its_b, number = fresh(docs, "shard", "slot", "_a", "_b", "_its_a", "_its_b", "_number")
    keyed = docs.withColumns({a: _key(docs, seed), b: _key(docs, seed + 1)})
    rows = cut(keyed.groupBy(col(docs, source).alias("source"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c")))
    found = rows.groupBy("source").agg(F.sum("c"), F.count("*"), F.max("c")).collect()  # one row a source
    drawn = quotas({r[0]: r[1] for r in found}, weights)
    found = sorted((r for r in found if drawn[r[0]]), key=lambda r: (r[0] is not None, str(r[0])))
    if not found:
        empty = docs.where(F.lit(False))
        return empty.withColumns({shard: F.lit(0).cast("bigint"), slot: F.lit(0).cast("bigint")}) if places else empty
    block_rows = max(block_rows, -(-sum(r[1] for r in found) // MAX_BLOCKS))
    shards = max(1, -(-sum(drawn.values()) // max(shard_rows, block_rows)))
    deal = Deal([r[1] for r in found], [drawn[r[0]] for r in found], block_rows, shards, seed)
    names = spark.createDataFrame([(r[0], k, max(1, -(-r[2] // per_bucket))) for k, r in enumerate(found)], f"name {docs.schema[source].dataType.simpleString()}, number bigint, buckets bigint")
    names = F.broadcast(names) if len(found) <= BROADCAST_ROWS else names
    widest = max(r[3] for r in found)
    place = _places(rows, deal, names, per_bucket, widest).select(F.col("a").alias(its_a), F.col("b").alias(its_b), F.col("shard").alias(shard), F.col("slot").alias(slot))
    if widest > 1:  # equal rows go as one, before the shuffle too
        keyed = keyed.withColumn(number, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(0)))).where(F.col(number) == 1).drop(number)
    parts = min(shards, MAX_PARTITIONS)
    out = keyed.join(place, (F.col(a) == F.col(its_a)) & (F.col(b) == F.col(its_b))).drop(a, b, its_a, its_b)
    out = out.repartitionById(parts, F.expr(f"cast(`{shard}` * {parts} div {shards} as int)")).sortWithinPartitions(shard, slot)
    return out if places else out.drop(shard, slot)
