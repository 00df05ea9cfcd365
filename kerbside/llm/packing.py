"""Packing documents into sequences: shortest-pack-first over the length histogram.

Lengths are placed longest first. Packs that look alike are kept as one pattern with a count, so the work depends on
the longest length and not on the number of documents: a length goes into the patterns with the most room left
(the shortest packs), splitting a pattern when only some of its packs are filled, and opens new packs when nothing has
room. A slot of a pattern holds a run of ranks of one length. The documents are ranked within their length, and the
broadcast pattern table (at most a few rows for each length up to ``max_length``, whatever the input) gives each rank
its pack and offset.

A document longer than ``max_length`` is cut into pieces: full ones and a rest, so all of it is packed.

Defined results. Null and blank texts have length 0 and are in no pack; so are texts of a null length. A null doc_id is packed like any other; repeated rows
are packed each: they are ranked as one with a count, so any number of them burdens no task. Ties of length go by a hash of doc_id, piece and text. No rows give no packs.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.frames import col, cut, ranked

MAX_LENGTH = 2048
PER_BUCKET = 1 << 16


def word_count(text: str | Column) -> Column:
    """Words by white space, counted in the JVM."""
    return F.regexp_count(text, F.lit(r"\S+"))


def spread(histogram: dict[int, int], max_length: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Patterns (packs, slots) for a histogram of lengths from 1 to max_length.

    A slot (length, first, depth, stride) puts depth documents of that length into every pack: in pack i, those of the
    ranks first + i + j * stride for j < depth.
    """
    room: dict[int, list[tuple[int, list]]] = defaultdict(list)
    spaces: list[int] = []  # a heap of the negated spaces that room has

    def put(space: int, packs: int, slots: list) -> None:
        if not room[space]:
            heapq.heappush(spaces, -space)
        room[space].append((packs, slots))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and spaces and -spaces[0] >= length:
            space = -spaces[0]
            packs, slots = room[space].pop()
            if not room[space]:
                heapq.heappop(spaces)
            if left < packs:
                put(space, packs - left, [(size, first + left, depth, stride) for size, first, depth, stride in slots])
                packs = left
            # Several rounds at once, as long as these packs stay the shortest.
            below = -spaces[0] if spaces else 0
            depth = max(1, min((space - below) // length, left // packs))
            put(space - depth * length, packs, [*slots, (length, rank, depth, packs)])
            rank, left = rank + packs * depth, left - packs * depth
        if left:
            per = max_length // length
            full, rest = divmod(left, per)
            for packs, depth in ((full, per), (1, rest)):
                if packs and depth:
                    put(max_length - depth * length, packs, [(length, rank, depth, packs)])
                    rank += packs * depth
    return [pattern for space in sorted(room) for pattern in room[space]]


def pack_documents(docs: DataFrame, doc_id="doc_id", length: Column | None = None, text="text", max_length=MAX_LENGTH, per_bucket=PER_BUCKET) -> DataFrame:
    """(doc_id, piece, start, n_tokens, pack_id, pack_offset): where each piece of each document goes.

    length: a column with the tokens of each document, such as a tokenizer's count; by default its words. start is the
    piece's place in its document, pack_offset that in its pack. Pieces never overlap, and no pack exceeds max_length.
    """
    spark = docs.sparkSession
    size = F.coalesce(length if length is not None else word_count(col(docs, text)), F.lit(0)).cast("bigint")
    salt = F.xxhash64(col(docs, text)) if text in docs.columns else F.lit(0)
    sized = docs.select(col(docs, doc_id).alias("doc_id"), size.alias("size"), salt.alias("salt")).where("size > 0")
    pieces = sized.select("doc_id", "size", "salt", F.explode(F.expr(f"sequence(0L, (size - 1) div {max_length})")).alias("piece"))
    pieces = pieces.select("doc_id", F.col("piece").cast("int"), (F.col("piece") * max_length).alias("start"), F.expr(f"least({max_length}, size - piece * {max_length})").alias("n_tokens"), F.xxhash64("doc_id", "piece", "salt").alias("a"))
    pieces = cut(pieces.groupBy("doc_id", "piece", "start", "n_tokens", "a").agg(F.count("*").alias("c")))
    found = pieces.groupBy("n_tokens").agg(F.sum("c"), F.count("*"), F.max("c")).collect()  # max_length rows at most
    histogram = {r[0]: r[1] for r in found}

    slots, base = [], 0
    for packs, held in spread(histogram, max_length):
        offset = 0
        for size_, first, depth, stride in held:
            slots.append((size_, first, depth, stride, packs, base, offset))
            offset += size_ * depth
        base += packs
    names = ["size", "first", "depth", "stride", "packs", "base", "offset"]
    slots = spark.createDataFrame(slots, ", ".join(f"{n} bigint" for n in names))

    buckets = spark.createDataFrame([(r[0], max(1, -(-r[2] // per_bucket))) for r in found], "n_tokens bigint, buckets bigint")
    order = ranked(pieces.join(F.broadcast(buckets), "n_tokens"), "n_tokens", ["a", "doc_id", "piece"], per_bucket, max((r[3] for r in found), default=0))
    order = order.withColumn("rank", F.explode(F.expr("sequence(rank, rank + c - 1)")))
    x = F.col("rank") - F.col("first")
    here = (F.col("n_tokens") == F.col("size")) & (x >= 0) & (x < F.col("depth") * F.col("stride")) & (F.pmod(x, F.col("stride")) < F.col("packs"))
    return order.join(F.broadcast(slots), here).select(
        "doc_id", "piece", "start", "n_tokens",
        (F.col("base") + F.pmod(x, F.col("stride"))).alias("pack_id"),
        (F.col("offset") + F.floor(x / F.col("stride")) * F.col("n_tokens")).alias("pack_offset"),
    )
