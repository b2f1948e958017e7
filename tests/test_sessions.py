"""Keyed session state against the batch dataflow."""

import random

import pytest
from pyspark.sql import functions as F

from mnemosea.operators import ingest
from mnemosea.streaming import sessions

SCHEMA = "session_id string, seq long, role string, content string, authored_at_ms long"


def test_cutting_equals_the_batch(spark):
    rng = random.Random(1)
    rows = [(f"s{s}", k, rng.choice(["user", "assistant", "tool"]), f"t {s} {k}", rng.randrange(100)) for s in range(12) for k in sorted(rng.sample(range(40), 15))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("namespace", "project_key", "branch_name")})
    want = {(r.session_id, r.chunk_seq): (r.start_seq, r.end_seq, r.authored_at_ms, r.text) for r in ingest.chunk_texts(df).collect()}
    got = {(s, n): c for s in {r[0] for r in rows} for n, c in enumerate(sessions.cut([r[1:] for r in rows if r[0] == s]), 1)}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_messages_in_any_order_and_twice(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"s{s}", k, rng.choice(["user", "assistant"]), f"decision: {s} {k}", 100 * s + k) for s in range(5) for k in range(12)]
    sent = [*rows, *rng.sample(rows, 25)]
    rng.shuffle(sent)
    for k in range(6):
        spark.createDataFrame(sent[k::6], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    got = {r.chunk_id: (r.chunk_kind, r.content_hash, r.start_seq, r.end_seq) for r in sessions.sessions_once(spark, source, f"file://{tmp_path}/run").collect()}
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("namespace", "project_key", "branch_name")})
    assert got == {r.chunk_id: (r.chunk_kind, r.content_hash, r.start_seq, r.end_seq) for r in ingest.chunks(df).collect()}
