"""The pipeline against a version in plain Python, stage by stage."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kerbside.functions import textbytes
from kerbside.llm import mixing, packing, pipeline, quality_rules, queries
from kerbside.llm.frames import table

from .test_dedup import brute_groups
from .test_packing_mixing import check_packs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def brute_share(text, chain):
    for _, data, offsets in textbytes.slices(pa.array([text])):
        docs, sizes, x, _ = quality_rules.line_features(data, offsets)
        if not len(docs):
            return 0.0
        best, came = x[0] @ chain.weights.T + chain.first, []
        for row in x[1:]:
            ways = best[:, None] + chain.steps
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row @ chain.weights.T
        states = [int(best.argmax())]
        for c in reversed(came):
            states.append(int(c[states[-1]]))
        return float(sizes[np.array(states[::-1]) == 1].sum() / sizes.sum())
    return 0.0


def test_stages_against_plain_python(spark, sf):
    docs = table(spark, sf, "documents")
    before = texts(docs)
    chain = quality_rules.train(docs, table(spark, sf, "labels"))
    after = []
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after.append(docs)

    good = {i: t for i, t in before.items() if brute_share(t, chain) >= quality_rules.MIN_SHARE}
    assert texts(after[0]) == good
    least = {}
    for i in sorted(good):
        least.setdefault(good[i], i)
    unique = {i: t for t, i in least.items()}
    assert texts(after[1]) == unique
    roots = brute_groups(list(unique.items()))
    apart = {i: t for i, t in unique.items() if roots.get(i, i) == i}
    assert texts(after[2]) == apart
    source = {r["doc_id"]: r["source"] for r in after[2].collect()}
    mixed = texts(after[3])
    sizes = Counter(source.values())
    weights = {s: pipeline.PRIORITIES[s] * n**mixing.EXPONENT for s, n in sizes.items()}
    assert Counter(source[i] for i in mixed) == {s: n for s, n in mixing.quotas(sizes, weights).items() if n}
    assert mixed.items() <= apart.items()
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packs(packed, {i: len(t.split()) for i, t in mixed.items()}, packing.MAX_LENGTH)
    whole = pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


GOOD = "A plain line of prose, with an end.\nAnother line of it, number {}."
BAD = "BUY NOW!!! $$$ | | | {}\n### *** $$$ !!! BUY NOW!!!"
LONG = "\n".join(f"A long text has many lines, of which this is the one with number {k}." for k in range(4000))


def odd_documents(spark, folder):
    """Labelled documents, and rows with nulls, empty and very long texts, repeats, copies, ties, and extra columns of clashing names."""
    words = lambda k: " ".join(f"w{(k * 37 + j * j) % 9973}" for j in range(120)) + "."
    rows = [(i, GOOD.format(f"{i} {words(i)}"), "src1") for i in range(40)] + [(100 + i, BAD.format(i), "src2") for i in range(40)]
    rows += [(200, None, "src1"), (201, "", None), (202, " \n ", "src1"), (None, GOOD.format("x" + words(500)), "src1"), (None, GOOD.format("x" + words(500)), "src1"), (None, None, None)]
    rows += [(300, LONG, None), (301, LONG, "src9"), (302, LONG + "\nAnd more.", "src9"), (5, rows[5][1], "src1"), (5, rows[5][1], "src1"), (6, GOOD.format("other " + words(700)), "src3"), (303, rows[7][1], "src2")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), k, "x", "y") for k, (i, t, s) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, `_rank` int, code string, shard string")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (300, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "odd")
    odd_documents(spark, folder)
    docs = table(spark, folder, "documents")
    kept = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
        assert kept[-1].columns == docs.columns
    chain = quality_rules.train(docs, table(spark, folder, "labels"))
    before, good, exact, near, mixed = map(pairs, kept)
    assert good == Counter({k: n for k, n in before.items() if k[1] and brute_share(k[1], chain) >= quality_rules.MIN_SHARE})
    assert {i for i, _ in good} >= {*range(40), None, 300, 301, 302} and not {i for i, _ in good} & {*range(100, 140), 200, 201, 202}
    least = {}
    for i, t in good:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    want = Counter({(i, t): 1 for t, i in least.items()})
    want.update({k: n for k, n in good.items() if k[0] is None})  # they can't be named
    assert exact == want and (303, before and kept[0].where("doc_id = 303").first()["text"]) not in exact
    named = [(i, t) for i, t in exact if i is not None]
    numbered = {k: (n, t) for k, (n, t) in enumerate(sorted(named))}  # doc_id 6 has two texts
    roots = brute_groups([(k, t) for k, (_, t) in numbered.items()])
    stay = Counter(numbered[k] for k in numbered if roots.get(k, k) == k)
    stay.update({k: n for k, n in exact.items() if k[0] is None})
    assert near == stay and (302, LONG + "\nAnd more.") not in near and (300, LONG) in near
    sizes = Counter(r["source"] for r in kept[3].collect())
    weights = {s: pipeline.PRIORITIES.get(s, pipeline.PRIORITY) * n**mixing.EXPONENT for s, n in sizes.items()}
    assert Counter(r["source"] for r in kept[4].collect()) == {s: n for s, n in mixing.quotas(sizes, weights).items() if n} and not mixed - near
    packed = pipeline.STAGES[-1][1](spark, kept[4], folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in kept[4].collect())
    assert sum(r["n_tokens"] for r in packed) == sum(len(t.split()) * n for (_, t), n in mixed.items())
    spans = defaultdict(list)
    for r in packed:
        spans[r["pack_id"]].append((r["pack_offset"], r["n_tokens"]))
    for held in spans.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and held[-1][0] + held[-1][1] <= packing.MAX_LENGTH
    assert sorted(map(str, pipeline.run(spark, folder).collect())) == sorted(map(str, packed))


def test_stages_on_an_empty_table(spark, sf, tmp_path):
    folder = str(tmp_path / "empty")
    docs = table(spark, sf, "documents").where("false")
    docs.write.parquet(f"{folder}/documents.parquet")
    table(spark, sf, "labels").write.parquet(f"{folder}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    found = pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "n_tokens", "pack_id", "pack_offset"] and found.count() == 0


def test_intermediates_go_to_the_shared_folder_and_away(spark, sf):
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(shared)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert pipeline.run(spark, sf).count() > 0
    folders = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith("pipeline-")]
    assert folders and all([x.getPath().getName() for x in files.listStatus(f)] == ["3"] for f in folders)  # what the result reads; the end of the application takes it


def test_all_queries_are_there():
    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 11
    assert Counter(name.split("_")[0] for name in queries.QUERIES) == {**{f"op{n}": 1 for n in range(1, 11)}, "pipeline": 1}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for file in os.listdir(sf):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    df = queries.QUERIES[name](spark, sf)
    want = db.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in order]) for r in want.fetchall())
