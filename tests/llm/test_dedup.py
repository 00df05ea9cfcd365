"""Exact dedup and SimHash near-dedup, against brute force and in the odd cases."""

import random
import string
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbside.llm import exact_dedup, simhash

from .conftest import rows

LONG = "word and other words " * 40_000


def words(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(n))


@given(st.lists(st.binary(max_size=9000).map(lambda b: b.decode("latin-1")), max_size=6), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_fingerprints_of_parts_combine(parts, _):
    whole = exact_dedup.fingerprints(pa.array(["".join(parts)]))
    each = exact_dedup.fingerprints(pa.array(parts, pa.string()))
    assert exact_dedup.combine(list(zip(*(x.tolist() for x in each)))) == tuple(int(x[0]) for x in whole)


def test_fingerprint_is_the_polynomial():
    text = "añb" * 3000
    a, b, n = (int(x[0]) for x in exact_dedup.fingerprints(pa.array([text])))
    data = text.encode()
    for got, p, r in ((a, exact_dedup.PRIMES[0], exact_dedup.BASES[0]), (b, exact_dedup.PRIMES[1], exact_dedup.BASES[1])):
        want = 0
        for c in reversed(data):
            want = (want * r + c) % p
        assert got == want
    assert n == len(data)


ODD = [(1, "a b"), (2, "a b"), (3, None), (4, None), (5, ""), (6, ""), (None, "a b"), (None, "q"), (7, "c"), (7, "c"), (8, "x"), (8, "y"), (9, "y"), (10, LONG), (11, LONG), (12, LONG + "!")]


def brute_copies(data):
    least = {}
    for i, t in data:
        if i is not None and t is not None:
            least[t] = min(i, least.get(t, i))
    return sorted({(i, least[t]) for i, t in data if i is not None and t is not None and i != least[t]}, key=str)


@pytest.mark.parametrize("options", [{}, {"huge_chars": 3}, {"primes": (7, 11), "bases": (3, 5)}])
def test_exact_copies(frame, options):
    """Also with pieces of a few characters, and with fingerprints that collide all the time."""
    data = [(i, t[-40:] if t and options else t) for i, t in ODD] + [(100 + i, f"t{i % 13}") for i in range(60)]
    assert rows(exact_dedup.exact_copies(frame(data), **options)) == brute_copies(data)


@pytest.mark.parametrize("options", [{}, {"huge_chars": 3}, {"primes": (7, 11), "bases": (3, 5)}])
def test_drop_copies_keeps_one_row_of_each_text(frame, options):
    short = lambda t: t[-40:] if t and options else t
    df = frame([(i, short(t)) for i, t in ODD])
    kept = exact_dedup.drop_copies(df, **options)
    assert kept.columns == df.columns
    got = rows(kept.select("doc_id", "text"))
    want = [(1, "a b"), (3, None), (4, None), (5, ""), (None, "a b"), (None, "q"), (7, "c"), (8, "x"), (8, "y"), (10, LONG), (12, LONG + "!")]
    assert got == sorted([(i, short(t)) for i, t in want], key=str)


def test_dedup_of_nothing(frame):
    for f in (exact_dedup.exact_copies, exact_dedup.drop_copies, simhash.near_copies, simhash.drop_near_copies):
        assert f(frame([])).count() == 0


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(5)
    for bits_set in (2, 6, 32):  # dense and sparse tries
        w = rng.integers(0, 1 << bits_set, 700, dtype=np.uint64) << np.uint64(32 - bits_set)
        keys = np.sort(rng.integers(0, 3, 700))
        w = np.sort((keys.astype(np.uint64) << np.uint64(32)) | w)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        end = np.append(begin[1:], 700)
        budgets = np.array([0] + [1] * 8 + [3] * 24)
        found = set()
        for i, j in simhash.trie_pairs(w, (begin, end, begin, end, np.zeros(len(begin), np.int8)), 0, budgets, 32):
            for a, b in zip(i.tolist(), j.tolist()):
                pair = (min(a, b), max(a, b))
                assert pair not in found
                found.add(pair)
        near = lambda a, b: keys[a] == keys[b] and all(((int(w[a] ^ w[b]) & 0xFFFFFFFF) >> (32 - d)).bit_count() <= budgets[d] for d in range(1, 33))  # noqa: B023, E731
        want = {(a, b) for a in range(700) for b in range(a + 1, 700) if near(a, b)}
        assert want <= found


def near_codes(rng, n, groups, flips):
    """n signatures around a few centres, each with so many bits flipped."""
    bits = rng.integers(0, 2, (groups, 256))[rng.integers(0, groups, n)]
    for row in bits:
        row[rng.choice(256, rng.integers(0, flips + 1), replace=False)] ^= 1
    return np.packbits(bits, axis=1)


def brute_parts(codes):
    whole = codes.view(np.uint64)
    root = np.arange(len(codes))
    for a in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(whole ^ whole[a]).sum(axis=1) <= simhash.BUDGET)
        low = root[near].min()
        root[np.isin(root, root[near])] = low
    return root.tolist()


def searched(codes, cuts):
    """Components from all node pairs, one task at a time."""
    rows, pairs = simhash.file_under(codes, cuts)
    root = np.arange(len(codes))
    for pair in np.unique(pairs):
        mine = rows[pairs == pair]
        u, v = simhash.near_links(np.full(len(mine), pair), mine, codes[mine])
        root = simhash._components(len(root), root[u], root[v])[root]
    return root.tolist()


@pytest.mark.parametrize("cut", [0, 3, 8, 11])
@pytest.mark.parametrize("flips", [8, 15, 31])
def test_search_finds_the_components_of_all_pairs(cut, flips):
    rng = np.random.default_rng(cut + flips)
    codes = np.unique(near_codes(rng, 150, 40, flips), axis=0)
    cuts = np.zeros(8192, np.int64)
    cuts[rng.random(8192) < 0.01 if cut > 8 else slice(None)] = cut
    assert searched(codes, cuts) == brute_parts(codes)


def test_a_dense_group_costs_no_square(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE_PAIRS", 256)
    codes = np.unique(near_codes(np.random.default_rng(1), 900, 2, 18), axis=0)
    checked = []
    check = simhash._Linker.check
    monkeypatch.setattr(simhash._Linker, "check", lambda self, i, j: (checked.append(len(i)), check(self, i, j)))
    pairs = np.zeros(len(codes), np.int64)
    codes[:, :8] = codes[0, :8]  # all in one leaf
    u, v = simhash.near_links(pairs, np.arange(len(codes)), codes)
    root = np.arange(len(codes))
    assert simhash._components(len(root), u, v).tolist() == brute_parts(codes)
    assert sum(checked) < len(codes) ** 2 / 8


def test_one_key_of_many_signatures_is_quick():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (60_000, 32), dtype=np.uint8)
    t = time.time()
    u, _ = simhash.near_links(np.zeros(len(codes), np.int64), np.arange(len(codes)), codes)
    assert not len(u) and time.time() - t < 5


def test_heavy_keys_are_cut_up(frame):
    data = corpus()
    want = sorted(((i, r) for i, r in brute_groups(data).items() if i != r), key=str)
    assert rows(simhash.near_copies(frame(data), node_rows=1)) == want


def test_ids_of_any_type(frame):
    data = corpus()
    roots = brute_groups(data)
    groups = {}
    for i, r in roots.items():
        groups.setdefault(r, []).append(f"d{i}")
    df = frame(data).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert rows(simhash.near_copies(df)) == sorted(((i, min(g)) for g in groups.values() for i in g if i != min(g)), key=str)
    assert sorted(r[0] for r in simhash.drop_near_copies(df).select("doc_id").collect()) == sorted(min(groups.get(roots.get(i, i), [f"d{i}"])) for i in {roots.get(i, i) for i, _ in data})
    assert rows(exact_dedup.exact_copies(df.unionByName(df.withColumn("doc_id", F.concat(F.lit("x"), "doc_id"))))) == sorted(((f"xd{i}", f"d{i}") for i, _ in data), key=str)


def brute_groups(data):
    """doc_id -> least doc_id of its component, from all pairs of signatures."""
    data = [(i, t.lower()) for i, t in data if i is not None and t]
    codes, known = simhash.signatures(pa.array([t for _, t in data]))
    root = {i: i for i, _ in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bits = [int.from_bytes(c.tobytes(), "big") for c in codes]
    for a in range(len(data)):
        for b in range(a):
            if known[a] and known[b] and (bits[a] ^ bits[b]).bit_count() <= simhash.BUDGET:
                x, y = find(data[a][0]), find(data[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus():
    rng = random.Random(3)
    data = []
    for k in range(12):
        base = words(rng, 120).split()
        for c in range(1 + k % 5):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            data.append((len(data), " ".join(copy)))
    chain = words(rng, 100).split()
    for _ in range(8):  # each a little farther from the first
        for _ in range(4):
            chain[rng.randrange(100)] = words(rng, 1)
        data.append((len(data), " ".join(chain)))
    return data


def test_near_copies_are_those_of_all_pairs(frame):
    data = corpus() + [(900, None), (901, ""), (902, " .,!"), (None, corpus()[0][1]), (903, LONG), (904, LONG.upper()), (905, "solo"), (906, "SOLO")]
    want = sorted(((i, r) for i, r in brute_groups(data).items() if i != r), key=str)
    assert rows(simhash.near_copies(frame(data))) == want
    assert (904, 903) in want and (906, 905) in want


def test_one_document_of_each_group_stays(frame):
    data = corpus() + [(900, None), (901, ""), (None, corpus()[0][1]), (950, "same here"), (950, "same here")]
    df = frame(data)
    kept = simhash.drop_near_copies(df)
    roots = brute_groups(data)
    want = sorted([(i, t) for i, t in dict.fromkeys(data) if i is None or roots.get(i, i) == i], key=str)
    assert rows(kept.select("doc_id", "text")) == want and kept.columns == df.columns


def test_thousands_of_near_copies_are_one_group(frame):
    rng = random.Random(9)
    base = words(rng, 200).split()
    data = [(i, " ".join([*base[:-1], f"w{i}"])) for i in range(1500)]
    found = simhash.near_copies(frame(data)).collect()
    assert len(found) == 1499 and {r["duplicate_of"] for r in found} == {0}


def test_unrelated_documents_are_left_alone(frame):
    rng = random.Random(11)
    assert simhash.near_copies(frame([(i, words(rng, 60)) for i in range(300)])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(102, 100), (102, 101)], "u bigint, v bigint")
    got = dict(rows(simhash.components(links)))
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
