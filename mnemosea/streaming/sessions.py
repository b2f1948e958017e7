"""Sessions as keyed state: chunks of transcripts whose messages come in any order, and more than once.

The state of a session is its messages by number, and the digest of each chunk as it was last told. What comes in is put in its
place, the session is cut anew, and only chunks that are new, changed or gone are handed on. A message that comes again changes
nothing. State is kept by session, so it is as large as the session is, and moves with its key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mnemosea.functions import text
from mnemosea.operators.ingest import CHUNK_VERSION
from mnemosea.streaming.workers import Versions, run_available

TOLD = "session_id string, chunk_seq int, start_seq long, end_seq long, authored_at_ms long, text string, gone boolean"


def cut(messages: list[tuple[int, str, str, int]]) -> list[tuple[int, int, int, str]]:
    """(first number, last number, latest time, text) of the chunks of a session's messages (number, role, content, time) in order: a
    user's message opens a chunk that takes in what follows, one before the first user is a chunk of its own."""
    out: list[list] = []
    user = False
    for seq, role, content, at in messages:
        user = user or role == "user"
        if role == "user" or not user:
            out.append([seq, seq, at, f"{role}: {content}"])
        else:
            out[-1][1:] = [seq, max(at, out[-1][2]), f"{out[-1][3]}\n{role}: {content}"]
    return [tuple(c) for c in out]


class OpenSession(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "seq long", "role string, content string, authored_at_ms long")
        self.told = handle.getMapState("told", "chunk_seq int", "digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = False
        for frame in rows:
            for m in frame.sort_values(["seq", "content"]).itertuples():
                if not self.messages.containsKey((int(m.seq),)):
                    self.messages.updateValue((int(m.seq),), (m.role, m.content, int(m.authored_at_ms)))
                    fresh = True
        if not fresh:
            return
        chunks = cut([(k[0], *v) for k, v in sorted(self.messages.iterator())])
        told = {k[0]: v[0] for k, v in self.told.iterator()}
        out = []
        for n, (first, last, at, said) in enumerate(chunks, 1):
            digest = hashlib.sha256(f"{first} {last} {at} {said}".encode()).hexdigest()
            if told.pop(n, None) != digest:
                self.told.updateValue((n,), (digest,))
                out.append((key[0], n, first, last, at, said, False))
        for n in told:
            self.told.removeKey((n,))
            out.append((key[0], n, 0, 0, 0, "", True))
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in TOLD.split(", ")])

    def close(self) -> None:
        pass


def told_chunks(messages: DataFrame) -> DataFrame:
    """The stream of chunks that are new, changed or gone, from a stream of messages (session_id, seq, role, content, authored_at_ms)."""
    rows = messages.select("session_id", F.col("seq").cast("long").alias("seq"), "role", "content", "authored_at_ms")
    return rows.groupBy("session_id").transformWithStateInPandas(OpenSession(), TOLD, "Update", "None")


def sessions_once(spark: SparkSession, source: DataFrame, root: str) -> DataFrame:
    """The chunks after a stream of messages ran over what is there: chunk_id, chunk_kind, content_hash, start_seq, end_seq."""
    table = Versions(spark, f"{root}/chunks", "chunk_id string, session_id string, chunk_seq int, start_seq long, end_seq long, authored_at_ms long, text string, gone boolean", "session_id")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        chunk_id = F.concat("session_id", F.lit(f":v{CHUNK_VERSION}:"), F.col("chunk_seq").cast("string"))
        told = told_chunks(source).withColumn("chunk_id", chunk_id)
        last = run_available(told, lambda number, rows: table.step(number, rows, _replaced), f"{root}/checkpoint")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    rows = table.read(last)
    return rows.select("chunk_id", text.chunk_kind(F.col("text")).alias("chunk_kind"), F.sha2("text", 256).alias("content_hash"), "start_seq", "end_seq")


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    rest = old.join(new.select("chunk_id"), "chunk_id", "left_anti")
    return rest.unionByName(new.filter("not gone").select(*rest.columns))
