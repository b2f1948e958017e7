"""Small literal cases of the operators' semantics."""

import itertools
import math
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemosea.functions import ranking, text, vectors
from mnemosea.operators import graph, ingest, lifecycle, maintain, recall, search, signing, sync
from mnemosea.plans import catalogue
from mnemosea.streaming import workers

MESSAGE = "session_id string, seq long, role string, content string, authored_at_ms long, namespace string, project_key string, branch_name string"


def messages(spark, *rows):
    return spark.createDataFrame([(*r, "team/dev", "p", "main") for r in rows], MESSAGE)


def one(df):
    return [tuple(r) for r in df.collect()]


def test_a_user_message_takes_in_what_follows(spark):
    m = messages(spark, ("s", 1, "assistant", "hi", 10), ("s", 2, "user", "a", 20), ("s", 3, "assistant", "b", 19), ("s", 4, "user", "c", 30))
    rows = {r.chunk_seq: r for r in ingest.chunks(m).collect()}
    assert [rows[k].text for k in (1, 2, 3)] == ["assistant: hi", "user: a\nassistant: b", "user: c"]
    assert (rows[2].start_seq, rows[2].end_seq, rows[2].authored_at_ms, rows[2].chunk_id) == (2, 3, 20, "s:v2:2")


def test_secret_and_kind(spark):
    m = messages(spark, ("s", 1, "user", "api_key is abc", 1), ("t", 1, "user", "方針を決めたい", 1))
    rows = {r.session_id: r for r in ingest.chunks(m).collect()}
    assert rows["s"].sensitivity == "secret" and rows["t"].chunk_kind == "decision"


def test_artifact_spans_are_in_bytes_and_lines(spark):
    m = messages(spark, ("s", 1, "user", "見て /Users/test/main.go\nhttps://example.com/spec と /Users/test/main.go", 1))
    rows = ingest.artifact_spans(ingest.chunks(m)).orderBy("ordinal").collect()
    assert [r.uri for r in rows] == ["/Users/test/main.go", "https://example.com/spec", "/Users/test/main.go"]
    whole = "user: 見て /Users/test/main.go\nhttps://example.com/spec と /Users/test/main.go".encode()
    assert all(whole[r.start_offset : r.end_offset].decode() == r.uri for r in rows)
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 1), (2, 2), (2, 2)] and rows[0].title == "main.go"


def test_message_conflicts_are_found(spark):
    a = messages(spark, ("s", 1, "user", "x", 1), ("s", 2, "user", "y", 1))
    b = messages(spark, ("s", 1, "user", "x", 1), ("s", 2, "user", "z", 1))
    assert [r.seq for r in ingest.message_conflicts(a, b).collect()] == [2]


def test_redaction(spark):
    said = "日本token: abc password=hunter2 source=/Users/test/app/config.yaml file://secret.txt bearer aB.c http://x"
    df = spark.createDataFrame([(said, "/Users/x")], "t string, u string")
    got = df.select(text.redact(F.col("t")), text.redact(F.col("t"), "strict"), text.redact_uri(F.col("u"))).first()
    assert got[0] == "日本token=[REDACTED] password=[REDACTED] source=[REDACTED_PATH] file://[REDACTED_PATH] Bearer [REDACTED] http://x"
    assert got[1].endswith(" x") and got[2] == ""
    with pytest.raises(ValueError):
        text.redact(F.col("t"), "other")


def test_candidate_subject(spark):
    df = spark.createDataFrame([("  decision: adopt it \nmore",), ("plain",), ("",), ("x:",), ("é" * 90,)], "t string")
    assert [r[0] for r in df.select(text.candidate_subject(F.lit("kind"), F.col("t"))).collect()] == ["adopt it", "plain", "kind", "x:", "é" * 80]


def test_hash_buckets_of_any_dimension(spark):
    def want(t, dim):
        h = vectors.FNV_OFFSET
        for b in t.encode():
            h = ((h ^ b) * vectors.FNV_PRIME) & (2**64 - 1)
        return h % dim

    words = ["", "a", "hello", "日本", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for dim in (1, 8, 64, 7, 100):
        assert [r[0] for r in df.select(vectors.hash_bucket(F.col("t"), dim)).collect()] == [want(w, dim) for w in words]


def test_embeddings_equal_plain_python(spark):
    def bucket(t, dim):
        h = vectors.FNV_OFFSET
        for b in t.encode():
            h = ((h ^ b) * vectors.FNV_PRIME) & (2**64 - 1)
        return h % dim

    def want(words, dim):
        if words is None:
            return None
        out = [0.0] * dim
        for w in words:
            out[bucket(w, dim)] += 1.0 + (0.25 if len(w.encode()) >= 6 else 0) + (0.15 if any(c.isdecimal() for c in w) else 0)
        for a, b in zip(words, words[1:], strict=False):
            out[bucket(a + " " + b, dim)] += 0.5
        total = root = sum(x * x for x in out)
        for _ in range(12 if total else 0):
            root = (root + total / root) * 0.5
        return [round(x / root if total else x, 9) for x in out]

    lists = [["alpha", "beta7", "日本語", "x" * 300, "alpha", "٣٤"], [], None, ["one"], ["a", "b"] * 500, ["é"], [""]]
    df = spark.createDataFrame([(w,) for w in lists], "w array<string>").coalesce(1)
    for dim in (8, 7, 100):
        assert [r[0] and [round(x, 9) for x in r[0]] for r in df.select(vectors.local_embedding(F.col("w"), dim)).collect()] == [want(w, dim) for w in lists]


def test_the_norm_of_documents_without_characters_is_that_of_the_sql(spark, tmp_path):
    lengths = [(1, 0), (2, 1), (3, None), (4, 100_000), (5, 0), (6, 4_000_000_000)]
    spark.createDataFrame(lengths, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    own = lambda found: sorted((i, "nan" if x is not None and math.isnan(x) else x) for i, x in found)
    got = own((r.doc_id, r.ratio) for r in catalogue.QUERIES["embed_norm"](spark, str(tmp_path)).collect())
    assert got == own(con.sql(catalogue.SQL["embed_norm"]).fetchall()) and [i for i, x in got if x == "nan"] == [1, 5]


def test_empty_text_embeds_to_zero(spark):
    df = spark.createDataFrame([("",), ("the of",)], "t string")
    assert [list(r[0]) for r in df.select(vectors.local_embedding(text.tokens(F.col("t")))).collect()] == [[0.0] * 8] * 2


def stored(spark, docs):
    return search.rebuild(spark.createDataFrame([(*d, "active", "normal") for d in docs], "unit_id string, title string, body string, state string, sensitivity string"))


def test_bm25_equals_the_text_index(spark):
    docs = [("u1", "alpha beta", "gamma gamma delta"), ("u2", "beta", "alpha alpha alpha epsilon"), ("u3", "", "zeta eta theta"), ("u4", "gamma", ""), ("u5", "café", "naïve")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, title, body)")
    con.executemany("insert into f values (?, ?, ?)", docs)
    index = stored(spark, docs)
    for q in ("alpha", "gamma OR delta", "cafe OR zeta OR beta"):
        want = {i: s for i, s in con.execute("select id, bm25(f) from f where f match ?", (q,))}
        queries = spark.createDataFrame([(1, q.replace(" OR ", " "))], "query_id long, query string")
        got = {r.unit_id: r.bm25 for r in search.bm25(index, queries).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_symbols_in_a_query_do_no_harm_and_unmatched_queries_fall_back(spark):
    index = stored(spark, [("u1", "c", "cpp code"), ("u2", "", "interesting")])
    queries = spark.createDataFrame([(1, "c++ cpp"), (2, "terest")], "query_id long, query string")
    got = {(r.query_id, r.unit_id) for r in search.lexical_with_fallback(index, queries, 10).collect()}
    assert got == {(1, "u1"), (2, "u2")}


def test_trigram_terms_need_three_characters(spark):
    index = spark.createDataFrame([("u1", "", "日本語の文"), ("u2", "", "other")], "unit_id string, title string, body string")
    assert one(search.trigram_matches(index, "日本")) == []
    assert one(search.trigram_matches(index, "日本語")) == [("u1", 1)]


def scored_row(spark, **change):
    row = {"memory_space": "shared", "signature_status": "valid", "has_signature": True, "trust_weight": 1.0, "semantic_rank": 0, "lexical_rank": 1, "edge_count": 0, "support_weight": 0.0, "contradict_weight": 0.0, "span_count": 0, "quote_count": 0, "authored_at_ms": 1, "query": "q", "subject": "s", "body": "b"} | change
    return spark.createDataFrame([tuple(row.values())], "memory_space string, signature_status string, has_signature boolean, trust_weight double, semantic_rank long, lexical_rank long, edge_count long, support_weight double, contradict_weight double, span_count long, quote_count long, authored_at_ms long, query string, subject string, body string")


def test_trust_order_high_low_missing(spark):
    score = lambda **c: scored_row(spark, **c).select(ranking.total_score(ranking.DEFAULT, 10)).first()[0]
    high, low, missing = score(trust_weight=0.9), score(trust_weight=0.2), score(trust_weight=1.0, signature_status="missing_signature")
    assert high > low > missing
    assert score(span_count=1, quote_count=1) > score() and score(edge_count=1, support_weight=1.0) > score(edge_count=1, support_weight=1.0, contradict_weight=1.0) > score() == score(edge_count=1, contradict_weight=1.0)


def test_the_ja_profile_puts_the_exact_match_first(spark):
    ja = ranking.profile(" JA-default ")
    a = scored_row(spark, semantic_rank=1, lexical_rank=3, query="壁打ち品質").select(ranking.total_score(ja, 10)).first()[0]
    b = scored_row(spark, semantic_rank=2, lexical_rank=1, query="壁打ち品質", subject="壁打ち品質の話").select(ranking.total_score(ja, 10)).first()[0]
    assert b > a


def test_spaces_default_to_private_and_shared():
    assert recall.allowed_spaces() == ["private", "shared"] and recall.allowed_spaces(transcript=True) == ["transcript"]


def test_only_the_newest_chunk_version_stays(spark):
    versions = spark.createDataFrame([("s:v1:1", "s", 1), ("s:v2:1", "s", 2), ("t:v1:1", "t", 1)], "chunk_id string, session_id string, chunk_strategy_version int")
    units = spark.createDataFrame([("s:v1:1",), ("s:v2:1",), ("t:v1:1",), ("m1",)], "unit_id string")
    assert {r.unit_id for r in recall.latest_chunks(units, versions).collect()} == {"s:v2:1", "t:v1:1", "m1"}


EDGE = "edge_id string, from_memory_id string, to_memory_id string, relation_type string, weight double"


def test_trace_emits_hops_to_visited_nodes_but_does_not_go_on_from_them(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "memory_id string")
    edges = spark.createDataFrame([("1", "a", "b", "supports", 1.0), ("2", "b", "a", "contradicts", 1.0), ("3", "b", "c", "supports", 1.0), ("4", "a", "gone", "about", 1.0), ("5", "a", "a", "about", 1.0)], EDGE)
    roots = spark.createDataFrame([("a",)], "root_id string")
    got = {(r.hop, r.edge_id) for r in graph.trace(edges, nodes, roots, depth=3).collect()}
    assert got == {(1, "1"), (1, "5"), (2, "2"), (2, "3")}
    assert {r.edge_id for r in graph.trace(edges, nodes, roots, depth=0).collect()} == {"1", "5"}


def test_self_loops_count_twice_and_orphans_are_named(spark):
    nodes = spark.createDataFrame([("a",)], "memory_id string")
    edges = spark.createDataFrame([("1", "a", "a", "denies", 0.5), ("2", "x", "y", "about", 1.0), ("3", "a", "y", "about", 1.0)], EDGE)
    stats = {r.memory_id: (r.edge_count, r.support_weight, r.contradict_weight) for r in graph.stats(edges).collect()}
    assert stats["a"] == (3, 1.0, 1.0)
    assert {(r.edge_id, r.detail) for r in graph.orphan_edges(edges, nodes).collect()} == {("2", "missing_from missing_to"), ("3", "missing_to")}


def test_suspensions_are_kept_renewed_and_resolved(spark):
    stored = spark.createDataFrame([("memory_edge", "old", "d", 5, 5, 0), ("memory_edge", "both", "d", 5, 5, 0)], "entity_type string, entity_id string, detail string, first_seen_at_ms long, last_seen_at_ms long, resolved_at_ms long")
    current = spark.createDataFrame([("memory_edge", "both", "m", "e"), ("memory_edge", "new", "m", "e")], "entity_type string, entity_id string, memory_id string, detail string")
    got = {r.entity_id: (r.first_seen_at_ms, r.last_seen_at_ms, r.resolved_at_ms) for r in graph.merge_suspensions(stored, current, 9).collect()}
    assert got == {"old": (5, 5, 9), "both": (5, 9, 0), "new": (9, 9, 0)}


CHANGE = "tbl string, pk string, cid string, val string, kind string, col_version long, site_id string, cl long"


def test_the_merge_is_commutative_associative_and_idempotent(spark):
    rows = [
        ("n", "a", "x", "9", "integer", 1, "s1", 1), ("n", "a", "x", "10", "integer", 1, "s1", 1), ("n", "a", "x", "9.5", "real", 1, "s9", 1),  # numbers by size
        ("n", "a", "y", "zz", "text", 1, "s1", 1), ("n", "a", "y", "99", "integer", 1, "s9", 1), ("n", "a", "y", None, "null", 1, "s9", 1),  # text above numbers above null
        ("n", "a", "z", "zz", "text", 1, "s9", 1), ("n", "a", "z", "AA==", "blob", 1, "s1", 1),  # blobs above text
        ("n", "a", "v", "old", "text", 2, "s1", 1), ("n", "a", "v", "new", "text", 3, "s1", 1), ("n", "a", "t", "b", "text", 1, "s1", 1), ("n", "a", "t", "b", "text", 1, "s2", 1),
        ("n", "b", "x", "past", "text", 9, "s1", 1), ("n", "b", "x", "gone", "text", 9, "s1", 2), ("n", "b", "x", "again", "text", 1, "s2", 3),  # made again: begins anew
        ("n", "c", "x", "1", "integer", 5, "s1", 1), ("n", "c", "", None, "null", 6, "s2", 2),  # deleted
    ]
    empty = spark.createDataFrame([], CHANGE)
    frames = [spark.createDataFrame(rows[k::5], CHANGE) for k in range(5)]
    want = None
    for order in itertools.islice(itertools.permutations(range(5)), 0, 120, 29):
        table = empty
        for k in [*order, order[0]]:
            table = spark.createDataFrame(workers.crdt_step(table, frames[k]).collect(), CHANGE)
        got = sorted(one(table), key=repr)
        want = want or got
        assert got == want
    cells = {(r[1], r[2]): (r[3], r[4], r[6]) for r in want}
    assert cells["a", "x"] == ("10", "integer", "s1") and cells["a", "y"] == ("zz", "text", "s1") and cells["a", "z"] == ("AA==", "blob", "s1")
    assert cells["a", "v"] == ("new", "text", "s1") and cells["a", "t"] == ("b", "text", "s2") and cells["b", "x"] == ("again", "text", "s2")
    assert {r.pk for r in sync.live_rows(spark.createDataFrame(rows, CHANGE)).collect()} == {"a", "b"}


def test_handshake_reasons_come_in_order(spark):
    peers = spark.createDataFrame([("p", 1.0, "allow"), ("q", 1.0, "block")], "peer_id string, trust_weight double, trust_state string")
    rows = [(1, "q", "s", "m", "1", "1", ["n"]), (2, "p", "x", "x", "1", "1", ["n"]), (3, "p", "s", "x", "1", "1", []), (4, "p", "s", "m", "1", "2", []), (5, "p", "s", "m", "1", "1", []), (6, "p", "s", "m", "1", "1", ["n"]), (7, "z", "s", "m", "1", "1", ["n"])]
    df = spark.createDataFrame(rows, "request_id long, peer_id string, schema_hash string, manifest_hash string, protocol string, min_protocol string, namespaces array<string>")
    got = {r.request_id: (r.reason, r.schema_fenced) for r in sync.handshakes(df, peers, schema_hash="s", manifest_hash="m", protocol="1", oldest="1").collect()}
    assert [got[k][0].split(" ")[0] for k in range(1, 8)] == ["peer", "schema", "crr", "protocol", "at", "", "peer"] and got[2][1] and not got[4][1]


def test_value_kinds(spark):
    df = spark.createDataFrame([(None,), (b"",), (b"a",), (b"\xff\xfe",)], "v binary")
    assert [r[0] for r in df.select(sync.value_kind(F.col("v"))).collect()] == ["null", "text", "text", "blob"]


def test_candidates_are_reviewed_once(spark):
    c = spark.createDataFrame([("c1", "s", "pending"), ("c2", "s", "approved")], "candidate_id string, subject string, status string")
    d = spark.createDataFrame([("c1", "approve", ""), ("c2", "reject", "")], "candidate_id string, decision string, new_subject string")
    assert sorted(one(lifecycle.review(c, d))) == [("c1", "s", "approved", False), ("c2", "s", "approved", True)]


def test_ed25519_vectors():
    # Of RFC 8032: seed, public key, message, signature.
    vectors_ = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ]
    for seed, key, message, signature in (map(bytes.fromhex, v) for v in vectors_):
        assert signing.public_key(seed) == key and signing.sign(seed, message) == signature and signing.verify(key, message, signature)
        assert not signing.verify(key, message + b"x", signature) and not signing.verify(b"", message, signature) and not signing.verify(key, message, b"")


def test_signatures_are_verified_together_as_alone(monkeypatch):
    seeds = [bytes([k]) * 32 for k in range(3)]
    rows = []
    for k in range(60):
        seed, message = seeds[min(2, k // 28)], b"message %d" % k  # keys that come often, and one that does not
        key, signature = signing.public_key(seed), signing.sign(seed, message)
        if k % 5 == 1:
            signature = signature[:-1] + bytes([signature[-1] ^ 1])
        if k % 7 == 2:
            message += b"!"
        if k % 11 == 3:
            signature = signature[:32] + (int.from_bytes(signature[32:], "little") + signing._L).to_bytes(32, "little")  # s is not reduced
        if k % 13 == 4:
            key = (2).to_bytes(32, "little") if k % 2 else (signing._P + 1).to_bytes(32, "little")  # no point, or not in its one form
        if k == 40:
            signature = (signing._P + 3).to_bytes(32, "little") + signature[32:]
        rows.append((key, message, signature))
    want = [k % 5 != 1 and k % 7 != 2 and k % 11 != 3 and k % 13 != 4 and k != 40 for k in range(60)]
    adds = [0]
    for name in ("_add", "_double"):
        f = getattr(signing, name)
        monkeypatch.setattr(signing, name, lambda *a, f=f: (adds.__setitem__(0, adds[0] + 1), f(*a))[1])
    for windows in ({8: 300, 4: 6}, {8: 2}, {4: 2}, {}):
        monkeypatch.setattr(signing, "WINDOWS", windows)
        assert signing.verify_together(*map(list, zip(*rows, strict=True))) == want
    assert signing.verify_together([], [], []) == []


def test_a_frequent_key_takes_a_fifth_of_the_additions(monkeypatch):
    """Additions a signature, with the building of the key's table shared by the claims of a batch."""
    seed = bytes(32)
    n, steps = 2000, [0]
    key = signing.public_key(seed)
    signing._base_windows()
    signing._key_windows.cache_clear()
    for name in ("_add", "_double"):
        f = getattr(signing, name)
        monkeypatch.setattr(signing, name, lambda *a, f=f: (steps.__setitem__(0, steps[0] + 1), f(*a))[1])
    signature = signing.sign(seed, b"claim")
    assert all(signing.verify_together([key] * n, [b"claim"] * n, [signature] * n))
    together = steps[0] / n + 64  # one for each window of two scalars of 256 bits
    steps[0] = 0
    signing._times(int.from_bytes(signature[32:], "little"), signing._BASE)
    signing._times(int.from_bytes(signature[:32], "little") % signing._L, signing._unpacked_key(key))
    assert 5 * together < steps[0] + 1


def test_signature_states_and_batches(spark):
    seed = bytes(32)
    key, good = signing.public_key(seed), signing.sign(seed, b"claim")
    rows = [("v", "claim", good, key, 1), ("i", "other", good, key, 2), ("m", "claim", b"", key, 1), ("u", "claim", good, b"", 3), ("n", None, good, key, 4)]
    df = spark.createDataFrame(rows, "memory_id string, claim string, signature binary, public_key binary, batch_id long")
    assert {r[0]: r[1] for r in signing.signature_state(df).collect()} == {"v": "valid", "i": "invalid_signature", "m": "missing_signature", "u": "unknown_peer", "n": "invalid_signature"}
    assert {r[0]: r[1] for r in signing.batch_verdicts(df).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_a_memory_in_a_good_and_a_bad_batch(spark):
    seed = bytes(32)
    key, good = signing.public_key(seed), signing.sign(seed, b"claim")
    rows = [("v", "claim", good, key, "good"), ("v", "changed", good, key, "bad"), ("w", "claim", good, key, "good")]
    df = spark.createDataFrame(rows, "memory_id string, claim string, signature binary, public_key binary, batch_id string")
    assert sorted(tuple(r) for r in signing.batch_verdicts(df).collect()) == [("bad", True, 1), ("good", False, 2)]


def test_canonical_claim_escapes_markup(spark):
    fields = {n: F.lit("a<b>&") if n == "subject" else F.lit(0) if n.endswith("_ms") or n == "payload_version" else F.lit("x") for n in signing.CLAIM_FIELDS}
    got = spark.range(1).select(signing.canonical_claim(fields)).first()[0]
    assert got.startswith('{"memory_id":"x","memory_type":"x","namespace":"x","subject":"a\\u003cb\\u003e\\u0026"') and got.endswith('"payload_version":0}')


def test_metrics_and_status(spark):
    results = spark.createDataFrame([(1, "a", 2), (2, "b", 7)], "query_id long, unit_id string, rank long")
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, unit_id string")
    assert one(maintain.retrieval_metrics(results, expected)) == [(0.333333, 0.214286, 3)]
    states = spark.createDataFrame([("p", "", False), ("q", "x", False)], "peer_id string, last_error string, schema_fenced boolean")
    assert sync.status(states).first()["state"] == "degraded"


def test_a_unit_that_becomes_secret_loses_its_vector(spark):
    units = spark.createDataFrame([("u", "t", "hello", "active", "secret")], "unit_id string, title string, body string, state string, sensitivity string")
    table = spark.createDataFrame([("u", [1.0]), ("w", [2.0])], "unit_id string, embedding array<double>")
    requests = spark.createDataFrame([("u", 0)], "unit_id string, processed_at_ms long")
    assert [r.unit_id for r in workers.index_step(table, requests, units).collect()] == ["w"]
