"""Packing and mixing: no token lost, no pack too full, exact quotas, disjoint blocks."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.llm import mixing, packing


def naive(histogram, room):
    """One document at a time, longest first, into the pack with the most room left."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            best = max(range(len(packs)), key=lambda i: packs[i], default=None)
            if best is not None and packs[best] >= length:
                packs[best] -= length
            else:
                packs.append(room - length)
    return len(packs)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=150, deadline=None)
def test_patterns_place_every_rank_once(histogram):
    patterns = packing.spread(histogram, 40)
    seen = defaultdict(list)
    for packs, slots in patterns:
        assert packs > 0 and sum(size * depth for size, _, depth, _ in slots) <= 40
        for size, first, depth, stride in slots:
            seen[size] += [first + i + j * stride for i in range(packs) for j in range(depth)]
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in histogram.items()}
    total = sum(n * c for n, c in histogram.items())
    assert sum(p for p, _ in patterns) <= max(naive(histogram, 40) * 1.1 + 2, -(-total // 40))


def check_packs(found, sizes, room):
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        packs[r["pack_id"]].append((r["pack_offset"], r["n_tokens"]))
    for spans, whole in [(pieces, None), (packs, room)]:
        for key, parts in spans.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at <= whole if whole else at == sizes[key]
    assert set(pieces) == {i for i, n in sizes.items() if n}
    assert sorted(packs) == list(range(len(packs)))


def test_documents_are_packed_whole(frame):
    rng = np.random.default_rng(1)
    data = [(i, "w " * int(rng.integers(0, 90))) for i in range(300)] + [(1000, "w " * 30_000), (1001, None), (1002, ""), (1003, "  \n")]
    found = packing.pack_documents(frame(data), max_length=64, per_bucket=16).collect()
    check_packs(found, {i: len((t or "").split()) for i, t in data}, 64)


def test_packing_odd_rows(frame):
    many = packing.pack_documents(frame([(None, "a b c")] * 500 + [(None, f"a b {i}") for i in range(50)]).withColumns({"n_tokens": F.lit("x"), "piece": F.lit("y"), "start": F.lit("z")}), max_length=6, per_bucket=64).collect()
    assert len({(r["pack_id"], r["pack_offset"]) for r in many}) == 550 and len({r["pack_id"] for r in many}) == 275
    found = packing.pack_documents(frame([(None, "a b c"), (1, "x y"), (1, "x y"), (1, "x y")]), max_length=4).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == {(None, 3): 1, (1, 2): 3}
    assert len({(r["pack_id"], r["pack_offset"]) for r in found}) == 4
    assert packing.pack_documents(frame([])).count() == 0 and packing.pack_documents(frame([(1, None)])).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=10))
@settings(max_examples=150, deadline=None)
def test_patterns_are_those_of_one_document_at_a_time(histogram):
    """As few packs as when each document goes, longest first, into the pack with the most room: rounds at once change nothing."""
    assert sum(p for p, _ in packing.spread(histogram, 40)) == naive(histogram, 40)


@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 500), max_size=6), st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0, 9), max_size=7))
@settings(max_examples=100, deadline=None)
def test_quotas_are_the_largest_with_the_weights(sizes, weights):
    drawn = mixing.quotas(sizes, weights)
    able = [s for s in sizes if sizes[s] and weights.get(s, 0) > 0]
    assert set(drawn) == set(sizes) and all(drawn[s] == 0 for s in sizes if s not in able)
    if able:
        unit = min(Fraction(sizes[s]) / Fraction(weights[s]) for s in able)
        assert all(0 <= unit * Fraction(weights[s]) - drawn[s] < 1 and drawn[s] <= sizes[s] for s in able)
        assert any(drawn[s] == sizes[s] for s in able)  # so no larger draw has the weights


def dense(blocks, shards, seed):
    """The whole tree, each node with all sources: shard by shard, the bounds of each source's blocks."""
    out = {}

    def go(node, a, b, begin, counts):
        if b - a == 1:
            out[a] = {s: (begin[s], begin[s] + counts[s]) for s in counts if counts[s]}
            return
        middle, some = (a + b) // 2, [s for s in counts if counts[s]]
        left = dict.fromkeys(counts, 0)
        if some:
            total = sum(counts.values())
            draw = np.random.default_rng([seed, node]).multivariate_hypergeometric([counts[s] for s in some], total * (middle - a) // (b - a), method="marginals")
            left |= dict(zip(some, draw.tolist()))
        go(2 * node, a, middle, begin, left)
        go(2 * node + 1, middle, b, {s: begin[s] + left[s] for s in counts}, {s: counts[s] - left[s] for s in counts})

    go(1, 0, shards, dict.fromkeys(range(len(blocks)), 0), dict(enumerate(blocks)))
    return out


@given(st.lists(st.integers(0, 60), min_size=1, max_size=5), st.integers(1, 9), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_every_run_of_shards_grows_the_same_tree(blocks, shards, run):
    want = dense(blocks, shards, 5)
    got = {k: {int(s): (int(b), int(b + n)) for s, b, n in zip(*leaf)} for first in range(0, shards, run) for k, *leaf in mixing.leaves(np.array(blocks), shards, first, min(shards, first + run), 5)}
    assert got == {k: v for k, v in want.items() if v}
    for s, n in enumerate(blocks):
        spans = sorted(v[s] for v in want.values() if s in v)
        assert [x for a, b in spans for x in range(a, b)] == list(range(n))
    totals = [sum(b - a for a, b in v.values()) for v in want.values()]
    assert max(totals) - min(totals) <= 2 * shards


def test_the_deal_is_hypergeometric():
    """Chi-square of one source's blocks in one shard of four, over many seeds, against the hypergeometric law."""
    blocks, shards, runs = [6, 4, 10], 4, 4000
    seen = Counter()
    for seed in range(runs):
        leaf = next((x for x in mixing.leaves(np.array(blocks), shards, 2, 3, seed)), None)
        seen[int(leaf[3][leaf[1] == 0].sum()) if leaf else 0] += 1
    law = {k: math.comb(6, k) * math.comb(14, 5 - k) / math.comb(20, 5) for k in range(6)}
    cells = [(seen[k], runs * law[k]) for k in range(4)] + [(seen[4] + seen[5], runs * (law[4] + law[5]))]
    assert sum((o - e) ** 2 / e for o, e in cells) < 18.5  # 4 degrees of freedom, p = 0.001


def test_block_order_is_a_permutation():
    sizes = np.array([1, 2, 37, 256])
    for s, n in enumerate(sizes):
        at = mixing.permute(np.full(n, s), np.arange(n), sizes, 7)
        assert sorted(at.tolist()) == list(range(n))
        assert mixing.unpermute(np.full(n, s), at, sizes, 7).tolist() == list(range(n))


def brute_mix(df, weights, block_rows, shard_rows, per_bucket, seed):
    """Counter of (doc_id, text, source, shard), dealt block by block in plain Python; equal rows are interchangeable."""
    keys = df.select("doc_id", "text", "source", mixing._key(df, seed).alias("a"), mixing._key(df, seed + 1).alias("b")).collect()
    groups = defaultdict(list)
    for r in keys:
        groups[r["source"]].append(r)
    drawn = mixing.quotas({s: len(g) for s, g in groups.items()}, weights)
    names = sorted((s for s in groups if drawn[s]), key=lambda s: (s is not None, str(s)))
    sizes = np.array([-(-len(groups[s]) // block_rows) for s in names])
    queues = []
    for k, s in enumerate(names):
        buckets = -(-len({(r["a"], r["b"]) for r in groups[s]}) // per_bucket)
        ranked = sorted(groups[s], key=lambda r: (r["a"] % buckets, r["a"], r["b"]))
        blocks = [ranked[i : i + block_rows] for i in range(0, len(ranked), block_rows)]
        left, queue = drawn[s], []
        for b in mixing.unpermute(np.full(sizes[k], k), np.arange(sizes[k]), sizes, seed):
            if left:
                queue.append(blocks[b][:left])
                left -= len(queue[-1])
        queues.append(queue)
    shards = max(1, -(-sum(drawn.values()) // shard_rows))
    out = Counter()
    for shard, spans in dense([len(q) for q in queues], shards, seed).items():
        for k, (x, y) in spans.items():
            for block in queues[k][x:y]:
                out.update((r["doc_id"], r["text"], r["source"], shard) for r in block)
    return out


MIXED = [(i, f"t{i}", "big" if i % 10 else "small") for i in range(2000)] + [(5000 + i, None if i % 3 else "", None) for i in range(30)] + [(None, None, "small")] * 40 + [(7, "again", "big")] * 333
UNEQUAL = {"big": 3.0, "small": 1.0, None: 0.2, "absent": 5.0}


def test_mixing_is_the_deal_by_hand(frame):
    df = frame(MIXED)
    want = brute_mix(df, UNEQUAL, 16, 128, 100, 99)
    for data in (df, df.repartition(7)):
        got = mixing.mixed_documents(data, UNEQUAL, shard_rows=128, per_bucket=100, seed=99)
        assert got.columns == [*df.columns, "shard", "slot"]
        found = got.collect()
        assert Counter((r["doc_id"], r["text"], r["source"], r["shard"]) for r in found) == want
        slots = defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) > 3


def test_shards_have_the_target_weights(frame):
    found = mixing.mixed_documents(frame(MIXED), mixing.tempered(frame(MIXED), {"small": 2.0}, exponent=0.5), block_rows=1, shard_rows=100).collect()
    drawn, by_shard = Counter(r["source"] for r in found), defaultdict(Counter)
    for r in found:
        by_shard[r["shard"]][r["source"]] += 1
    assert drawn["small"] / drawn["big"] == pytest.approx(2 * 240**0.5 / 2133**0.5, rel=0.02)
    assert np.std([c["small"] / c.total() - drawn["small"] / drawn.total() for c in by_shard.values()]) < 0.12


def test_shards_are_laid_out_one_by_one(frame):
    parts = mixing.mixed_documents(frame(MIXED), UNEQUAL, shard_rows=128).select("shard", "slot", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in parts}) == len({r["shard"] for r in parts}) == len({(r["p"], r["shard"]) for r in parts})
    assert [(r["shard"], r["slot"]) for r in parts] == sorted((r["shard"], r["slot"]) for r in parts)


def test_mixing_weights_and_odd_rows(frame, spark):
    data = [(i, "t" * (i % 7), "abc"[i % 3]) for i in range(300)] + [(None, None, "a")] * 3
    drawn = Counter(r["source"] for r in mixing.mixed_documents(frame(data), {"a": 1.0, "b": 3.0}).collect())
    assert drawn == {"b": 100, "a": 33}
    table = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None), ("d", 4.0)], "source string, weight double")
    assert mixing.mixed_documents(frame(data), table).count() == 133
    assert mixing.mixed_documents(frame(data), {}).count() == 0 and mixing.mixed_documents(frame(data), {"a": 0, "b": -1}).count() == 0
    empty = mixing.mixed_documents(frame([]), {"a": 1})
    assert empty.count() == 0 and empty.columns == [*frame([]).columns, "shard", "slot"]
    same = mixing.mixed_documents(frame([(1, "r", "a")] * 50 + [(2, "q", "b")] * 20), {"a": 2, "b": 1}, per_bucket=8)
    assert Counter(r["doc_id"] for r in same.collect()) == {1: 40, 2: 20}
    clash = mixing.mixed_documents(frame(data).withColumns({"shard": F.lit("x"), "SLOT": F.lit("y"), "_a": F.lit(1)}), {"a": 1.0})
    assert clash.columns[-2:] == ["__shard", "_slot"] and {tuple(r) for r in clash.select("shard", "SLOT", "`_a`").collect()} == {("x", "y", 1)}
    assert mixing.mixed_documents(frame(data), {"a": 1.0}, places=False).columns == frame(data).columns
    maps = spark.createDataFrame([("a", {"k": 1}), ("a", {"k": 2}), ("a", None)], "source string, m map<string, int>")
    assert sorted(str(r["m"]) for r in mixing.mixed_documents(maps, {"a": 1}).collect()) == ["None", "{'k': 1}", "{'k': 2}"]
