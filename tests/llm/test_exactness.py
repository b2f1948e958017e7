"""Cases where rounding, batches or the order of a draw could lose or change rows."""

import collections
import math
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemosea.llm import knn_join, mixing, near_dup


@pytest.mark.parametrize("pivots", [None, 1, 3])
def test_scores_beyond_exact_doubles_keep_their_last_place(spark, pivots):
    far, best, second = [2.0**24, 1 / 64], [2.0**17, 3 / 64], [2.0**17, 2 / 64]  # 2 ** 53 + 3 and + 2 in 64ths
    df = spark.createDataFrame([(0, far), (1, best), (2, second)], "vec_id long, embedding array<double>")
    for k in (1, 2):
        got = knn_join.voronoi_top_k(df, F.col("vec_id") == 0, k=k, pivots=pivots).collect()
        assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 2**53 + 3), (2, 2, 2**53 + 2)][:k]


def test_large_random_scores_are_exact(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(-(2**33), 2**33, (300, 3))
    rows = [(i, (x / 64).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in knn_join.voronoi_top_k(df, F.col("vec_id") % 50 == 0, k=7, pivots=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in range(0, 300, 50):
        score = {j: max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v[i], v[j], strict=True)))) for j in range(300) if j != i}
        order = sorted(score, key=lambda j: (-score[j], j))[:7]
        assert sorted(got[i]) == [(k, j, score[j]) for k, j in enumerate(order, 1)]


def test_components_that_overflow_lose_no_row(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in knn_join.voronoi_top_k(df, F.col("vec_id") == 0, k=3).collect()]
    assert sorted(got) == [(1, 1, 2**63 - 1), (2, 3, 4096), (3, 2, -(2**63))]


def test_the_draw_is_the_ranking_by_pareto_odds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), "abcd"[int(rng.integers(0, 4))]) for i in range(1500)] + [(5000, None, "a"), (5001, "", "b"), (5002, "x " * 900, "c"), (5003, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df, share=1.1).collect()
    by_source = collections.defaultdict(list)
    for r in out:
        by_source[r.source].append(r)
    assert len(out) == len(rows) and len(by_source) == 5
    drawn = 0
    for own in by_source.values():
        size, target = own[0].source_size, own[0].target
        whole = math.floor(target / size)
        f, rest, mean = target / size - whole, target - whole * size, size / len(own)

        def rank(r, f=f, mean=mean):
            if not f or not r.size:
                return math.inf
            u = ((r.row % 2**64 >> 11) + 0.5) / 2**53
            p = 1 - (1 - f) ** ((r.size / mean) ** 0.5)
            return u / (1 - u) / (p / (1 - p))

        words, want = 0, {}
        for r in sorted(own, key=rank):
            more = f > 0 and words + r.size / 2 <= rest
            if r.size:
                want[r.doc_id] = whole + more
            words += r.size
            drawn += more
        assert {r.doc_id: r.copies for r in own if r.size} == want
    assert drawn > 100


def test_runs_of_band_keys_over_many_batches(spark):
    """Keys whose classes lie in several Arrow batches give the pairs that they give in one."""
    rows = [(k, n) for k in range(40) for n in range(k % 15 + 1)]
    df = spark.createDataFrame(rows, "key long, node long")
    small = {(k, n) for k, n in rows if k % 15 + 1 > near_dup.SHORT_RUN}
    pairs = {(a, b) for k in range(40) if k % 15 + 1 <= near_dup.SHORT_RUN for a in range(k % 15 + 1) for b in range(a + 1, k % 15 + 1)}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 3, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = near_dup._runs(df).collect()
            assert {(r.a, r.b) for r in got if r.b is not None} == pairs
            assert sorted((r.key, r.a) for r in got if r.b is None) == sorted(small)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_runs_are_read_as_a_stream():
    """The scan asks for a batch only when it has handed on what it made of the one before."""
    import pyarrow as pa

    asked = []

    def batches():
        for k in range(50):
            asked.append(k)
            yield pa.RecordBatch.from_pydict({"key": pa.array([k, k], pa.int64()), "node": pa.array([1, 2], pa.int64())})

    frame = mock.MagicMock()
    near_dup._runs(frame)
    scan = frame.repartition.return_value.sortWithinPartitions.return_value.mapInArrow.call_args[0][0]
    made = scan(batches())
    next(made)
    assert len(asked) <= 2
