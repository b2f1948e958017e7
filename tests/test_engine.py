"""The public face over the smallest tables."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from mnemosea.engine import Config, Engine, EngineError, decode_strictly, envelope, load_eval_dataset, register_functions, schema_hash
from mnemosea.functions import vectors
from mnemosea.operators import search
from mnemosea.sources.bridge import AS_OF_MS, Tables


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine.over(Tables(spark, sf))


def request(spark, memory_id, space, subject, body):
    return spark.createDataFrame([(memory_id, space, "team/dev", "", subject, body, "", "", "", 1, True, "", "active")], "memory_id string, memory_space string, namespace string, memory_type string, subject string, body string, origin_peer_id string, scope string, author_agent_id string, authored_at_ms long, has_signature boolean, source_uri string, lifecycle_state string")


def ask(spark, words):
    return spark.createDataFrame([(1, words)], "query_id long, query string")


def test_what_is_stored_is_recalled_in_its_lane(spark, engine):
    after = engine.store(request(spark, "mem-1", "shared", "quokka plan", "body")).store(request(spark, "mem-2", "private", "quokka note", "body"))
    got = after.recall(ask(spark, "quokka"), as_of_ms=AS_OF_MS, semantic=False).collect()
    assert {r.unit_id for r in got} == {"mem-1", "mem-2"} and {r.unit_kind for r in got} == {"fact"}
    assert {r.unit_id for r in after.recall(ask(spark, "quokka"), as_of_ms=AS_OF_MS, shared=True, semantic=False).collect()} == {"mem-1"}
    near = {r.unit_id: r for r in after.recall(ask(spark, "quokka"), as_of_ms=AS_OF_MS, limit=1000).collect()}
    assert {"mem-1", "mem-2"} <= set(near) and len(near) > 100 and near["mem-1"].lexical_rank > 0
    assert after.signals.filter("memory_id = 'mem-1'").collect()[0].signal_type == "store" and after.queue.filter("unit_id = 'mem-2' and processed_at_ms = 0").count() == 1
    assert after.verification.filter("memory_id = 'mem-1'").first().signature_status == "valid"
    # Storing again replaces the text, in the index too.
    again = after.store(request(spark, "mem-1", "shared", "wombat plan", "body"))
    assert {r.unit_id for r in again.recall(ask(spark, "quokka"), as_of_ms=AS_OF_MS, semantic=False).collect()} == {"mem-2"}
    assert {r.unit_id for r in again.recall(ask(spark, "wombat"), as_of_ms=AS_OF_MS, semantic=False).collect()} == {"mem-1"}


def test_a_store_with_relations_and_artifacts(spark, engine):
    kind = "edge_id string, from_memory_id string, to_memory_id string, relation_type string, weight double, authored_at_ms long"
    nodes = request(spark, "r-1", "shared", "a", "b").unionByName(request(spark, "r-2", "private", "a", "b"))
    said = spark.createDataFrame([("r-1", "https://x/y", "y", "team/dev", 0, 4, "", 1), ("r-1", "https://x/y", "y", "team/dev", 5, 9, "q", 1)], "memory_id string, uri string, title string, namespace string, start_offset long, end_offset long, quote_hash string, authored_at_ms long")
    shared = engine.nodes.filter("memory_space = 'shared'").first().memory_id
    after = engine.store(nodes, spark.createDataFrame([("e", "r-1", shared, "supports", 0.0, 1)], kind), said)
    assert after.edges.filter("edge_id = 'e'").first().weight == 1.0 and after.spans.filter("memory_id = 'r-1'").count() == 2 and after.artifacts.filter("uri = 'https://x/y'").count() == 1
    for bad, code in ((("e", "r-1", "r-1", "supports", 1.0, 1), "INVALID_ARGUMENT"), (("e", "r-1", shared, "likes", 1.0, 1), "INVALID_ARGUMENT"), (("e", "r-1", "r-2", "supports", 1.0, 1), "NOT_FOUND")):
        with pytest.raises(EngineError) as e:
            engine.store(nodes, spark.createDataFrame([bad], kind))
        assert e.value.code == code


def test_promotions_take_their_chunks_kind_and_infer_edges(spark, engine):
    m = [("f", 1, "user", "decision: use wombats", 10), ("f", 2, "user", "the reason is speed, see https://x/y and https://x/y", 20), ("f", 3, "user", "TODO tidy up", 30)]
    schema = "session_id string, seq long, role string, content string, authored_at_ms long, namespace string, project_key string, branch_name string"
    after = engine.ingest(spark.createDataFrame([(*r, "team/dev", "p", "main") for r in m], schema))
    link = lambda k, chunk: spark.createDataFrame([(k, 0, chunk)], "memory_id string, ordinal int, chunk_id string")
    after = after.promote(link("d", "f:v2:1")).promote(link("why", "f:v2:2"))
    types = {r.memory_id: r.memory_type for r in after.nodes.filter("memory_id in ('d', 'why')").collect()}
    assert types == {"d": "decision", "why": "rationale"}
    inferred = after.edges.filter("from_memory_id = 'why'").collect()
    assert [(r.to_memory_id, r.relation_type) for r in inferred] == [("d", "supports")]
    assert after.spans.filter("memory_id = 'why'").count() == 2 and after.nodes.filter("memory_id = 'why'").first().source_uri == "https://x/y"
    hops, _, sources = after.trace("why")
    assert hops.count() == 1 and sources.count() == 2
    # Approval promotes.
    task = after.candidates.filter("chunk_id = 'f:v2:3'").first().candidate_id
    done = after.review(spark.createDataFrame([(task, "approve", "Tidy")], "candidate_id string, decision string, new_subject string"))
    node = done.nodes.filter(F.col("memory_id") == f"mem_{task}").first()
    assert (node.memory_type, node.subject, node.memory_space) == ("task_candidate", "Tidy", "private")


def test_a_session_that_grows(spark, engine):
    schema = "session_id string, seq long, role string, content string, authored_at_ms long, namespace string, project_key string, branch_name string"
    rows = lambda *m: spark.createDataFrame([("g", *r, "team/dev", "p", "main") for r in m], schema)
    after = engine.ingest(rows((1, "user", "decision: first", 1))).ingest(rows((2, "assistant", "more of it", 2), (3, "user", "second one", 3)))
    chunks = {r.chunk_seq: r.text for r in after.chunks.filter("session_id = 'g'").collect()}
    assert chunks == {1: "user: decision: first", 2: "user: second one"}  # what exists stays as it is
    assert after.queue.filter("unit_id like 'g:%' and processed_at_ms = 0").count() == 2
    with pytest.raises(EngineError) as e:
        after.ingest(rows((1, "user", "another", 1)))
    assert "reused with different content" in str(e.value)
    with pytest.raises(EngineError):
        after.ingest(rows((9, " ", "x", 1)))


def test_recall_of_the_newest_chunk_version_only(spark, engine):
    schema = "session_id string, seq long, role string, content string, authored_at_ms long, namespace string, project_key string, branch_name string"
    after = engine.ingest(spark.createDataFrame([("v", 1, "user", "platypus", 1, "team/dev", "p", "main")], schema))
    old = after.chunks.filter("chunk_id = 'v:v2:1'").withColumn("chunk_id", F.lit("v:v1:1"))
    both = after._with(chunks=after.chunks.unionByName(old), units=after.units.unionByName(after.units.filter("unit_id = 'v:v2:1'").withColumn("unit_id", F.lit("v:v1:1")))).rebuild_index()
    assert {r.unit_id for r in both.recall(ask(spark, "platypus"), as_of_ms=AS_OF_MS, transcript=True, semantic=False).collect()} == {"v:v2:1"}


def test_a_failing_provider_and_the_catalogue(spark, engine):
    def fails(queries):
        raise RuntimeError("no network")

    how = {"as_of_ms": AS_OF_MS}
    for provider in (fails, lambda q: q.select("query_id", F.array(F.lit(1.0)).alias("qv"))):
        rows, warnings = replace(engine, embed_queries=provider).recall_with_warnings(ask(spark, "the reason"), **how)
        assert warnings == ["embedding provider unavailable; semantic ranking skipped"] and rows.count() > 0
    rows, warnings = replace(engine, embed_queries=search.query_vectors).recall_with_warnings(ask(spark, "the reason"), **how)
    assert warnings == [] and rows.filter("semantic_rank > 0").count() > 0
    assert engine.probe()["dimension"] == 8 and engine.probe()["text_index"]


def test_a_service_that_fails_for_some_batches(spark, engine, tmp_path):
    """Queries whose batch fails to the end go by text, with a warning; the others keep their vectors, and a batch that works the second time does."""
    calls = str(tmp_path / "calls")

    def embed(texts):
        with open(calls, "a") as f:
            f.write(f"{texts}\n")
        if any("reason" in t for t in texts):
            raise OSError("down")
        if any("later" in t for t in texts) and open(calls).read().count("later") < 2:
            raise OSError("not yet")
        return [None if "null" in t else [1.0] if "short" in t else [0.1 * (len(t) % 7), *[0.3] * 7] for t in texts]

    rows = [(1, "the reason"), (2, "a note later"), (3, "null one"), (4, "short one"), (5, "plain one")]
    queries = spark.createDataFrame(rows, "query_id long, query string").coalesce(1)
    service = vectors.Provider(embed, batch=1, retries=2, pause=0.01)
    made = {r.query_id: (r.qv, r.error) for r in service.vectors(queries, 8).collect()}
    assert [made[k][0] is not None for k in range(1, 6)] == [False, True, False, False, True] and made[1][1] == "OSError: down" and "8" in made[4][1]
    assert open(calls).read().count("reason") == 3 and open(calls).read().count("later") == 2
    found, warnings = replace(engine, embed_queries=service).recall_with_warnings(queries, as_of_ms=AS_OF_MS, limit=100)
    assert warnings == ["embedding provider unavailable; semantic ranking skipped"]
    near = {}
    for r in found.collect():
        near.setdefault(r.query_id, []).append(r.semantic_rank)
    assert {k for k, v in near.items() if any(v)} == {2, 5} and near[1]
    assert replace(engine, embed_queries=service).recall_with_warnings(queries.filter("query_id = 5"), as_of_ms=AS_OF_MS)[1] == []


def test_batches_are_judged_and_the_scrubber_cleans_up(spark, engine):
    batch = engine.extract("team/1", 0)
    good = schema_hash(engine._shared())
    allowed, blocked = (engine.peers.filter(F.col("trust_state") == s).first().peer_id for s in ("allow", "block"))
    assert engine.apply(batch, peer_id=allowed, batch_schema=good, now_ms=5).changes.count() == engine.changes.distinct().count()
    for peer, schema, claims in ((blocked, good, None), (allowed, "other", None), (allowed, good, spark.createDataFrame([("m1", "invalid_signature")], "memory_id string, signature_status string"))):
        refused = engine.apply(batch, peer_id=peer, batch_schema=schema, claims=claims, now_ms=5)
        assert refused.quarantine.count() == 1 and refused.changes is engine.changes
    later = refused.scrub(8 * 24 * 3_600_000)
    assert later.quarantine.count() == 0 and later.suspensions.filter("resolved_at_ms = 0").count() > 0
    ticked = engine.index_tick(77)
    assert ticked.queue.filter("processed_at_ms = 77").count() > 0 and ticked.queue.count() == engine.queue.count()


def cells(spark, rows):
    schema = "tbl string, pk string, cid string, val string, kind string, col_version long, db_version long, site_id string, cl long, namespace string, changed_at_ms long"
    return spark.createDataFrame([("memory_nodes", pk, cid, val, "text", cv, dv, "far", cl, "team/1", 9) for pk, cid, val, cv, dv, cl in rows], schema)


def test_a_memory_applied_from_a_peer_is_recalled(spark, engine):
    peer = engine.peers.filter("trust_state = 'allow'").first().peer_id
    good = schema_hash(engine._shared())
    batch = cells(spark, [("far-1", "subject", "capybara census", 1, 900001, 1), ("far-1", "body", "counted at dawn", 1, 900001, 1), ("far-1", "memory_type", "decision", 1, 900001, 1), ("far-1", "namespace", "team/1", 1, 900002, 1), ("far-2", "subject", "other", 1, 900003, 1)])
    after = engine.apply(batch, peer_id=peer, batch_schema=good, now_ms=5)
    ask_it = lambda e: {r.unit_id for r in e.recall(ask(spark, "capybara"), as_of_ms=AS_OF_MS, semantic=False).collect()}
    assert ask_it(engine) == set() and ask_it(after) == {"far-1"}
    node = after.nodes.filter("memory_id = 'far-1'").first()
    assert (node.subject, node.body, node.memory_type, node.memory_space) == ("capybara census", "counted at dawn", "decision", "shared")
    assert [(r.peer_id, r.namespace, r.applied_version) for r in after.cursors.collect()] == [(peer, "team/1", 900003)]
    assert after.queue.filter("unit_id like 'far-%' and processed_at_ms = 0").count() == 2
    # The same batch again changes nothing; a later cell changes the text, a deletion takes it away, and a new life begins anew.
    again = after.apply(batch, peer_id=peer, batch_schema=good, now_ms=6)
    assert again.changes.count() == after.changes.count() and again.nodes.count() == after.nodes.count() and ask_it(again) == {"far-1"}
    renamed = again.apply(cells(spark, [("far-1", "subject", "tapir census", 2, 900010, 1)]), peer_id=peer, batch_schema=good, now_ms=7)
    assert ask_it(renamed) == set() and renamed.nodes.filter("memory_id = 'far-1'").first().body == "counted at dawn"
    gone = renamed.apply(cells(spark, [("far-1", "", None, 3, 900011, 2)]), peer_id=peer, batch_schema=good, now_ms=8)
    assert gone.nodes.filter("memory_id = 'far-1'").count() == 0 == gone.units.filter("unit_id = 'far-1'").count()
    back = gone.apply(cells(spark, [("far-1", "subject", "capybara again", 1, 900012, 3)]), peer_id=peer, batch_schema=good, now_ms=9)
    assert ask_it(back) == {"far-1"} and back.cursors.first().applied_version == 900012


def test_publish_redacts_and_refuses_shared_memories(spark, engine):
    after = engine.store(request(spark, "mem-3", "private", "token: abc123", "password=hunter2 file://x")).publish(["mem-3"])
    row = after.nodes.filter("memory_id = 'pub_mem-3'").first()
    assert row.subject == "token=[REDACTED]" and "hunter2" not in row.body and row.memory_space == "shared"
    with pytest.raises(EngineError) as e:
        after.publish(["pub_mem-3"])
    assert e.value.code == "PRIVATE_ONLY" and e.value.status == 400


def test_trace_explain_context_and_upkeep(spark, engine):
    root = engine.edges.join(engine.nodes.select(F.col("memory_id").alias("from_memory_id")), "from_memory_id", "left_semi").join(engine.nodes.select(F.col("memory_id").alias("to_memory_id")), "to_memory_id", "left_semi").first().from_memory_id
    hops, artifacts, sources = engine.trace(root, depth=2)
    assert hops.count() > 0 and artifacts.columns and sources.count() == 0
    with pytest.raises(EngineError) as e:
        engine.trace("nobody")
    assert e.value.status == 404
    assert engine.explain("the").filter("matched").count() > 0
    sections, found = engine.context(ask(spark, "the reason"), as_of_ms=AS_OF_MS)
    assert sections.select("section").distinct().count() >= 3 and found.count() <= 5
    assert engine.diagnose().count() >= 4


def test_promote_review_supersede_signal_ingest_and_apply(spark, engine):
    chunk = engine.chunks.filter("chunk_kind = 'decision'").first()
    links = spark.createDataFrame([("pm", 0, chunk.chunk_id)], "memory_id string, ordinal int, chunk_id string")
    assert engine.promote(links).nodes.filter("memory_id = 'pm'").first().body == chunk.text
    c = engine.candidates.orderBy("candidate_id").first().candidate_id
    decisions = spark.createDataFrame([(c, "approve", "x")], "candidate_id string, decision string, new_subject string")
    after = engine.review(decisions)
    assert after.list_candidates(status="approved").first().subject == "x"
    with pytest.raises(EngineError) as e:
        after.review(decisions)
    assert e.value.code == "CANDIDATE_NOT_PENDING"
    pairs = spark.createDataFrame([("m1", "m2")], "old_id string, new_id string")
    assert engine.supersede(pairs).nodes.filter("memory_id = 'm1'").first().lifecycle_state == "superseded"
    signals = spark.createDataFrame([("g", "m1", "pin", 1.0, 1), ("h", "m1", "store", 1.0, 1), ("i", "m1", "deny", 0.0, 1)], "signal_id string, memory_id string, signal_type string, value double, authored_at_ms long")
    assert engine.signal(signals).signals.count() == engine.signals.count() + 1
    m = spark.createDataFrame([("new", 1, "user", "decision: go", 5, "n", "p", "b")], "session_id string, seq long, role string, content string, authored_at_ms long, namespace string, project_key string, branch_name string")
    again = engine.ingest(m).ingest(m)
    assert again.chunks.filter("session_id = 'new'").count() == 1 and again.list_candidates(namespace="n").count() == 1 and again.messages.filter("session_id = 'new'").count() == 1
    batch = engine.extract("team/1", 0)
    assert engine.apply(batch).apply(batch).changes.count() == engine.changes.distinct().count()


def test_config_json_envelope_and_hash(engine):
    assert Config.from_mapping({"namespaces": ["a"]}).namespaces == ("a",)
    read = Config.from_yaml("# a peer\npeer_id: 'peer/x'\nnamespaces:\n  - team/a\n  - team/b\nsync_batch: 64  # few\n")
    assert (read.peer_id, read.namespaces, read.sync_batch) == ("peer/x", ("team/a", "team/b"), 64)
    with pytest.raises(EngineError):
        Config.from_yaml("  nested: no")
    for bad in ({"nope": 1}, {"embedding_dimension": 0}, {"tokenizer": "x"}):
        with pytest.raises(EngineError):
            Config.from_mapping(bad)
    assert decode_strictly('{"query": "x"}', {"query"}) == {"query": "x"}
    for bad in ("{", "[]", '{"other": 1}'):
        with pytest.raises(EngineError):
            decode_strictly(bad, {"query"})
    assert envelope(1, warnings=["b", "a", "b", " "])["warnings"] == ["a", "b"] and not envelope(error=EngineError("NOT_FOUND", "x"))["ok"]
    assert schema_hash(engine.tables) == schema_hash(dict(reversed(engine.tables.items())))


def test_eval_sets_and_sql_functions(spark, tmp_path):
    body = {"documents": [{"id": "d", "body": "x"}], "queries": [{"query": "q", "expected_ids": ["d", "e"]}]}
    (tmp_path / "e.json").write_text(json.dumps(body))
    documents, queries, expected = load_eval_dataset(spark, str(tmp_path / "e.json"))
    assert documents.first().id == "d" and queries.first().query == "q" and expected.count() == 2
    register_functions(spark)
    assert tuple(spark.sql("select hash_bucket('a', 7), is_secret('my Token'), round(newton_sqrt(16.0D), 6)").first()) == (12638187200555641996 % 7, True, 4.0)
