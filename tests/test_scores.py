"""Scores of many queries at once, and what must not be made, read or written more than once for them."""

import glob
import random

import pytest
from pyspark.sql import functions as F
from test_index_store import SCHEMA, by_hand, rows, text_of

from mnemosea.operators import index_store, recall, search, vector_store
from mnemosea.plans import catalogue
from mnemosea.sources.bridge import Tables

QUERIES = [" ".join(f"w{(7 * k + j * j) % 60}" for j in range(1 + k % 5)) for k in range(24)]


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def changed(spark):
    """An index of two segments with dead units, of small ranges, and what it holds."""
    patch = pytest.MonkeyPatch()
    patch.setattr(index_store, "RANGE_UNITS", 8)
    rng = random.Random(5)
    units = {f"u{k}": (text_of(rng, rng.randint(0, 2)), text_of(rng, rng.choice([3, 5, 10, 40, 200]))) for k in range(200)}
    frame = lambda some: spark.createDataFrame(rows(some), SCHEMA)
    index = search.rebuild(frame(units))
    new = {f"u{k}": ("", text_of(rng, 12)) for k in range(0, 260, 13)}
    gone = ["u1", "u2"]
    units = {u: x for u, x in units.items() if u not in gone} | new
    index = search.update(index, frame(new), frame(units), gone=spark.createDataFrame([(u,) for u in gone], "unit_id string"))
    yield index, units
    patch.undo()


def test_many_queries_with_the_dead_and_with_marks(spark, changed, monkeypatch):
    index, units = changed
    assert index.has_dead and len(QUERIES) > search.FEW
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    want = {(k, u): s for k, q in enumerate(QUERIES) for u, s in by_hand(units, q).items()}
    marks = {u: [m for m in (0, 1) if (int(u[1:]) + m) % 3 == 0 or u.endswith("7")] for u in units}
    told = spark.createDataFrame([(u, m) for u, own in marks.items() for m in own], "unit_id string, mark int")
    for pairs in (search.PAIRS, 20):  # all queries at once, and in blocks
        monkeypatch.setattr(search, "PAIRS", pairs)
        got = search.scores(index, asked).collect()
        assert {(r.query_id, r.unit_id): r.bm25 for r in got} == pytest.approx(want, abs=2e-6) and len(got) == len(want)
        assert all(r.terms == len({w for w in QUERIES[r.query_id].split() if w in " ".join(units[r.unit_id]).split()}) for r in got)
        best = {}
        for r in search.scores(index, asked, told, {0: 3, 1: 5}).collect():
            best.setdefault((r.query_id, r.mark), []).append((r.bm25, r.unit_id))
        for k in range(len(QUERIES)):
            for m, cap in ((0, 3), (1, 5)):
                own = sorted((s, u) for (q, u), s in want.items() if q == k and m in marks[u])[:cap]
                assert [s for s, _ in sorted(best.get((k, m), []))[:cap]] == pytest.approx([s for s, _ in own], abs=2e-6)
    top = {(r.query_id, r.lexical_rank): r.bm25 for r in search.lexical(index, asked, 4).collect()}
    assert top == pytest.approx({(k, n): s for k in range(len(QUERIES)) for n, (s, _) in enumerate(sorted((s, u) for (q, u), s in want.items() if q == k)[:4], 1)}, abs=2e-6)


def test_no_row_is_made_for_a_posting(spark, sf):
    """Blocks of a range meet as they are: what is found is neither opened nor summed by rows that are shuffled."""
    for name in ("fts_match", "explain_bm25"):
        plan = plan_of(catalogue.QUERIES[name](spark, sf))
        assert "Generate" not in plan.split("MapInArrow")[0] and "Generate explode(arrays_zip" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]


def test_candidates_are_computed_once(spark, sf):
    t = Tables(spark, sf)
    found = search.lexical_with_fallback(t.index, t.queries, 5)
    assert "MapInArrow" not in plan_of(found)
    enriched = recall.enriched(found, t.units, t.nodes, t.verification, t.peers)
    assert "Join LeftSemi" in plan_of(enriched) and "broadcast" in plan_of(enriched).lower()
    assert "Window" not in plan_of(recall.with_features(enriched, t.edges, t.spans))


def test_ids_of_candidates_are_sent_or_joined(spark, sf, monkeypatch):
    t = Tables(spark, sf)
    found = search.lexical_with_fallback(t.index, t.queries, 5)
    rows_of = lambda: sorted(map(str, recall.with_features(recall.enriched(found, t.units, t.nodes, t.verification, t.peers), t.edges, t.spans).collect()))
    sent = rows_of()
    monkeypatch.setattr(recall, "SENT", 0)
    assert rows_of() == sent and sent


def test_what_is_farther_than_the_kth_stays_where_it_is(spark, tmp_path):
    rng = random.Random(4)
    vectors = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(400)], "vec_id long, embedding array<double>")
    store = vector_store.VectorStore.build(vectors, f"file://{tmp_path}/v", key="vec_id", dim=4, cells=5)
    probes = spark.createDataFrame([(1, [0.5] * 4, c["seq"], c["cell"], 0.2) for c in store.cells()], "query_id long, qv array<double>, seq string, cell int, kth double")
    near = store._solved(probes, 50, "query_id long, vec_id long, distance double", None, None).collect()
    every = store._solved(probes.drop("kth"), 50, "query_id long, vec_id long, distance double", None, None).collect()
    assert sorted(map(tuple, near)) == sorted(tuple(r) for r in every if r.distance <= 0.2) and 0 < len(near) < len(every)


def test_a_slot_is_written_once(spark):
    units = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("u"), "id").alias("unit_id"), F.lit("").alias("title"), F.lit("a b").alias("body"), F.lit("active").alias("state"), F.lit("private").alias("sensitivity"))
    index = search.rebuild(units)
    files = glob.glob(f"{index.root.removeprefix('file:').replace('///', '/')}/units/seq=*/slot=*/*.parquet")
    assert len(files) == index_store.SLOTS


def test_a_merge_moves_blocks_as_they_are(changed):
    index, units = changed
    after = index.compacted()
    assert len(after.segments) == 1 and not after.has_dead
    assert sorted(map(tuple, after.postings.drop("bucket").collect())) == sorted(map(tuple, index.postings.drop("bucket").collect()))
    parts = {len(set(r["unit_ids"])) for r in after.blocks().collect()}
    assert max(parts) <= 16 and len(parts) > 1
