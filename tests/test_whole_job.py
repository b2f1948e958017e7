"""Queries that must take all of their rows, against plain Python."""

import numpy as np

from mnemosea.operators import recall, search, vector_store
from mnemosea.plans import catalogue
from mnemosea.sources import bridge
from mnemosea.sources.bridge import AS_OF_MS, Tables


def test_every_shared_node_is_signed_and_verified(spark, sf):
    t = Tables(spark, sf)
    rows = t.nodes.filter("memory_space = 'shared'").join(t.verification.select("memory_id", "signature_status"), "memory_id", "left").collect()

    def state(r):
        if not r.has_signature:
            return "missing_signature"
        return "unknown_peer" if r.origin_peer_id == "src19" else "invalid_signature" if r.signature_status == "invalid_signature" else "valid"

    want = {r.memory_id: state(r) for r in rows}
    assert max(map(len, want)) > 3 and len(want) == len(rows)
    got = [tuple(r) for r in catalogue.QUERIES["verify_signatures"](spark, sf).collect()]
    assert sorted(got) == sorted(want.items())
    batches = {}
    for r in rows:
        bad, n = batches.get(r.namespace, (False, 0))
        batches[r.namespace] = (bad or want[r.memory_id] in ("unknown_peer", "invalid_signature"), n + 1)
    assert {r.batch_id: (r.quarantined, r.claims) for r in catalogue.QUERIES["batch_verify"](spark, sf).collect()} == batches


def test_traces_begin_at_every_decision(spark, sf):
    t = Tables(spark, sf)
    nodes = {r.memory_id: r.memory_type for r in t.nodes.select("memory_id", "memory_type").collect()}
    out = {}
    for e in t.edges.collect():
        if e.to_memory_id in nodes:
            out.setdefault(e.from_memory_id, []).append(e)
    want, seen = [], set()
    for root in (m for m, kind in nodes.items() if kind == "decision"):
        first = out.get(root, [])
        second = [e for m in {e.to_memory_id for e in first} - {root} for e in out.get(m, [])]
        want += [(root, 1, e.edge_id) for e in first] + [(root, 2, e.edge_id) for e in second]
        seen |= {root} | {e.to_memory_id for e in first + second}
    got = [(r.root_id, r.hop, r.edge_id) for r in catalogue.QUERIES["trace_hops"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(len(r) > 3 for r, _, _ in got)
    known = {a.artifact_id for a in t.artifacts.select("artifact_id").collect()}
    spans = sorted(s.span_id for s in t.spans.collect() if s.memory_id in seen and s.artifact_id in known)
    assert sorted(r.span_id for r in catalogue.QUERIES["trace_artifacts"](spark, sf).collect()) == spans


def nearest_by_hand(vectors, queries, k):
    """{(query, key): (distance, rank)}; vectors and queries map keys to lists."""
    keys = sorted(vectors)
    table = np.array([vectors[i] for i in keys], np.float64)
    out = {}
    for q, v in queries.items():
        d = np.round(np.sqrt(np.cumsum((table - np.array(v, np.float64)) ** 2, 1)[:, -1]), 6)
        for rank, (distance, key) in enumerate(sorted(zip(d.tolist(), keys, strict=True))[:k], 1):
            out[q, key] = (distance, rank)
    return out


def test_vector_search_takes_every_hundredth_vector_in_blocks(spark, sf, monkeypatch):
    vectors = {r.vec_id: r.embedding for r in Tables(spark, sf).vectors.collect()}
    want = nearest_by_hand(vectors, {i: v for i, v in vectors.items() if i % 100 == 0}, 10)
    assert any(q >= 10 for q, _ in want)
    for together in (vector_store.PACK_QUERIES, 1):
        monkeypatch.setattr(vector_store, "PACK_QUERIES", together)
        got = {(r.query_id, r.vec_id): (r.distance, r.semantic_rank) for r in catalogue.QUERIES["vector_topk"](spark, sf).collect()}
        assert got == want


def test_bm25_is_explained_for_every_query_and_unit(spark, sf):
    t = Tables(spark, sf)
    own = {r.unit_id for r in t.units.filter("memory_space in ('private', 'shared')").select("unit_id").collect()}
    want = sorted((r.query_id, r.unit_id) for r in catalogue.QUERIES["fts_match"](spark, sf).collect() if r.unit_id in own)
    got = sorted((r.query_id, r.unit_id) for r in catalogue.QUERIES["explain_bm25"](spark, sf).collect())
    assert got == want and any(q % 10 for q, _ in got) and any(len(u) > 2 for _, u in got)


def merged_by_hand(t, k):
    """{(query, unit): (semantic_rank, lexical_rank)} of the k nearest units of each query and its k best by BM25."""
    vectors = {r.unit_id: r.embedding for r in search.unit_vectors(t.units).collect()}
    near = nearest_by_hand(vectors, {r.query_id: r.qv for r in search.query_vectors(t.queries).collect()}, k)
    lexical = {(r.query_id, r.unit_id): r.lexical_rank for r in search.lexical_with_fallback(search.rebuild(t.units), t.queries, k).collect()}
    return {key: (near.get(key, (0, 0))[1], lexical.get(key, 0)) for key in near | lexical}


def test_merge_has_what_only_the_vector_side_finds(spark, sf):
    t = Tables(spark, sf)
    matched = {r.query_id for r in search.bm25(search.rebuild(t.units), t.queries).collect()}
    # The merge takes BM25 without its fallback.
    want = {key: (a, b if key[0] in matched else 0) for key, (a, b) in merged_by_hand(t, 50).items() if a or key[0] in matched}
    got = {(r.query_id, r.unit_id): (r.semantic_rank, r.lexical_rank) for r in catalogue.QUERIES["merge_candidates"](spark, sf).collect()}
    assert got == want and any(a and not b for a, b in got.values()) and any(b and not a for a, b in got.values())


def test_recall_with_the_vector_side(spark, sf):
    t = Tables(spark, sf)
    found = spark.createDataFrame([(*key, *ranks) for key, ranks in merged_by_hand(t, 100).items()], "query_id long, unit_id string, semantic_rank long, lexical_rank long")
    rows = recall.with_features(recall.enriched(found, t.units, t.nodes, t.verification, t.peers), t.edges, t.spans)
    scored = recall.scored(rows, t.queries, profile="default", as_of_ms=AS_OF_MS).select("query_id", "unit_id", "score", "authored_at_ms").collect()
    want = {}
    for q in {r.query_id for r in scored}:
        own = sorted((r for r in scored if r.query_id == q), key=lambda r: (-r.score, -r.authored_at_ms, r.unit_id))
        want |= {(q, r.unit_id): (r.score, rank) for rank, r in enumerate(own[:10], 1)}
    got = {(r.query_id, r.unit_id): (r.score, r.rank) for r in catalogue.QUERIES["recall_topk"](spark, sf).collect()}
    assert got == want
    assert got.keys() != {(r.query_id, r.unit_id) for r in catalogue.QUERIES["recall_lexical"](spark, sf).collect()}


def test_index_status_counts_stored_vectors_before_there_are_postings(spark, sf):
    own = f"{sf}/."  # a folder of which this session has no index yet
    t = Tables(spark, own)
    [status] = catalogue.QUERIES["index_status"](spark, own).collect()
    assert not [k for k in bridge._INDEXES if k[1] == own]
    want = {r.unit_id: r.embedding for r in search.unit_vectors(t.units).collect()}
    assert status.embeddings == len(want) > 0
    store = t.embeddings
    index = t.index
    assert index.vector_store.root == store.root and index.vector_store.parts == store.parts and [s.vectors for s in index.segments] == [len(want)]
    assert {r.unit_id: r.embedding for r in index.vectors.collect()} == want
    plain = search.rebuild(t.units)
    assert index.statistics() == plain.statistics() and index.blocks().count() == plain.blocks().count()
