"""The store of vector cells against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosea.operators.vector_store import VectorStore, write_part


def by_hand(vectors, queries, k):
    """{(query, key): (distance, rank)}; ``vectors`` is a list of (key, vector)."""
    out = {}
    for q, v in queries:
        d = sorted((float(np.round(np.sqrt(np.cumsum((np.array(x) - np.array(v)) ** 2)[-1]), 6)), key) for key, x in vectors)
        for rank, (distance, key) in enumerate(d[:k], 1):
            out[q, key] = (distance, rank)
    return out


def found(df, key="unit_id"):
    return {(r.query_id, r[key]): (r.distance, r.semantic_rank) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12)) * 10
    vectors = [(f"u{i:05}", (centres[i % 30] + rng.normal(size=12) * 0.2).tolist()) for i in range(6000)]
    vectors += [(f"same{i:03}", centres[0].tolist()) for i in range(40)]  # ties
    queries = [(i, (centres[i % 30] + rng.normal(size=12) * 0.3).tolist()) for i in range(60)] + [(900, centres[0].tolist()), (901, [0.0] * 12)]
    return vectors, queries


def test_exact_and_few_vectors_compared(spark, tmp_path, clustered):
    vectors, queries = clustered
    store = VectorStore.build(spark.createDataFrame(vectors, "unit_id string, embedding array<double>").repartition(3), f"file://{tmp_path}/v", key="unit_id", dim=12)
    q = spark.createDataFrame(queries, "query_id long, qv array<double>")
    looked = []
    got = store.search(q, 10, looked=looked)
    assert found(got) == by_hand(vectors, queries, 10)
    cells, compared, everything = looked[0]
    assert compared * 4 < everything and cells < len(store.cells()) * len(queries) / 4


def test_few_queries_find_what_many_do(spark, tmp_path, clustered):
    vectors, queries = clustered
    store = VectorStore.build(spark.createDataFrame(vectors, "unit_id string, embedding array<double>"), f"file://{tmp_path}/v", key="unit_id", dim=12)
    some = queries[:3] + queries[-2:]
    looked = []
    got = store.search(spark.createDataFrame(some, "query_id long, qv array<double>"), 10, looked=looked)
    assert found(got) == by_hand(vectors, some, 10) and looked[0][1] * 3 < looked[0][2]
    gone = spark.createDataFrame([("first", f"u{k:05}") for k in range(0, 6000, 2)], "seq string, unit_id string")
    left = [v for v in vectors if not (v[0][0] == "u" and int(v[0][1:]) % 2 == 0)]
    assert found(store.search(spark.createDataFrame(some, "query_id long, qv array<double>"), 4, gone=gone)) == by_hand(left, some, 4)


def test_only_needed_folders_are_read(spark, tmp_path, clustered):
    vectors, _ = clustered
    store = VectorStore.build(spark.createDataFrame(vectors, "unit_id string, embedding array<double>"), f"file://{tmp_path}/v", key="unit_id", dim=12)
    every = store.blocks([(r["seq"], r["cell"]) for r in store.cells()])
    one = store.blocks([("first", store.cells()[0]["cell"])])
    assert one.select(F.input_file_name()).distinct().count() < every.select(F.input_file_name()).distinct().count() / 10
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(" in plan and plan.count("Scan parquet") <= 2


def test_allowed_gone_and_newer_parts(spark, tmp_path, clustered):
    vectors, queries = clustered
    kind = "unit_id string, embedding array<double>"
    old = write_part(spark.createDataFrame(vectors, kind), f"file://{tmp_path}/a", "old", key="unit_id", dim=12)
    moved = [(k, [x + 1.0 for x in v]) for k, v in vectors[:500:3]]
    new = write_part(spark.createDataFrame(moved, kind), f"file://{tmp_path}/a", "new", key="unit_id", dim=12)
    store = VectorStore(spark, f"file://{tmp_path}/a", (old, new), "unit_id", "string", 12)
    dropped = [k for k, _ in vectors[500:2000:2]]
    gone = spark.createDataFrame([("old", k) for k, _ in moved] + [("old", k) for k in dropped], "seq string, unit_id string")
    now = dict(vectors) | dict(moved)
    now = {k: v for k, v in now.items() if k not in set(dropped)}
    q = spark.createDataFrame(queries, "query_id long, qv array<double>")
    assert found(store.search(q, 7, gone=gone)) == by_hand(list(now.items()), queries, 7)
    may = [k for k in now if k.endswith("7")]
    allowed = spark.createDataFrame([(k,) for k in may], "unit_id string")
    assert found(store.search(q, 7, gone=gone, allowed=allowed)) == by_hand([(k, now[k]) for k in may], queries, 7)


def test_awkward_vectors_and_queries(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (None, [0.0, 0.0]), (8, [0.0, 0.0])]
    store = VectorStore.build(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), f"file://{tmp_path}/v", key="vec_id", dim=2)
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [nan, 1.0])], "query_id long, qv array<float>")
    assert found(store.search(q, 10), "vec_id") == {(1, 1): (0.0, 1), (1, 8): (0.0, 2), (1, 2): (5.0, 3)}
    none = VectorStore.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), f"file://{tmp_path}/n", key="vec_id", dim=2)
    assert none.search(q, 3).collect() == [] == none.rows().collect()


def test_more_queries_than_a_pack_in_one_cell(spark, tmp_path, monkeypatch):
    from mnemosea.operators import vector_store

    monkeypatch.setattr(vector_store, "PACK_QUERIES", 8)
    monkeypatch.setattr(vector_store, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    queries = [(i, rng.normal(size=4).tolist()) for i in range(90)]
    store = VectorStore.build(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), f"file://{tmp_path}/v", key="vec_id", dim=4, cells=2)
    assert found(store.search(spark.createDataFrame(queries, "query_id long, qv array<double>"), 5), "vec_id") == by_hand(vectors, queries, 5)
