"""Ingest: transcripts to chunks, units, artifact spans and promotion candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemosea.functions import text
from mnemosea.functions.text import first_non_empty

CHUNK_VERSION = 2


#: A session's record: its fields, and its messages in a list.
SESSION = "session_id string, namespace string, project_key string, branch_name string, sensitivity string, retention_class string, messages array<struct<seq: long, role: string, content: string, authored_at_ms: long>>"


def write_sessions(messages: DataFrame, path: str) -> None:
    """Sessions as JSON lines, a record each."""
    fields = [f.split(" ")[0] for f in SESSION.split(", messages")[0].split(", ")]
    own = [F.max(c).alias(c) if c in messages.columns else F.lit(None).cast("string").alias(c) for c in fields if c != "session_id"]
    said = F.array_sort(F.collect_list(F.struct("seq", "role", "content", "authored_at_ms"))).alias("messages")
    messages.groupBy("session_id").agg(*own, said).write.json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The messages of the session records in a folder of JSON files, with defaults for what is empty."""
    rows = spark.read.schema(SESSION).json(path).withColumn("m", F.explode("messages")).drop("messages").select("*", "m.*").drop("m")
    return rows.withColumns({c: first_non_empty(F.trim(c), F.lit(v)) for c, v in SESSION_DEFAULTS.items()})


#: Fixed values.
SESSION_DEFAULTS = {"sensitivity": "private", "retention_class": "default"}


def validated(messages: DataFrame) -> DataFrame:
    """Messages with their trimmed ids and the reason for which an ingest refuses them, or none."""
    rows = messages.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("session_id", "role", "namespace")})
    reason = F.when(F.col("session_id") == "", "session_id is required").when(F.col("namespace") == "", "namespace is required").when(F.col("role") == "", "role is required").when(F.col("seq").isNull(), "seq is required").otherwise("")
    return rows.withColumn("reason", reason)


def segments(messages: DataFrame) -> DataFrame:
    """``messages`` with chunk_seq: a user's message opens a chunk that takes in what follows; a
    message before the first user is a chunk of its own. One window over each session."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    user = (F.col("role") == "user").cast("int")
    opens = F.when((F.col("role") == "user") | (F.sum(user).over(w) == 0), 1).otherwise(0)
    return messages.withColumn("opens", opens).withColumn("chunk_seq", F.sum("opens").over(w)).drop("opens")


def chunk_texts(messages: DataFrame) -> DataFrame:
    """One row per chunk with its text and its range of messages."""
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "role", "content").alias("line"))))
    return (
        segments(messages)
        .groupBy("session_id", "chunk_seq")
        .agg(
            F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.max("authored_at_ms").alias("authored_at_ms"),
            F.first("namespace").alias("namespace"), F.first("project_key").alias("project_key"), F.first("branch_name").alias("branch_name"), lines.alias("lines"),
        )
        .withColumn("text", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
        .drop("lines")
    )


def chunks(messages: DataFrame, *, version: int = CHUNK_VERSION) -> DataFrame:
    c = chunk_texts(messages)
    return c.select(
        F.concat("session_id", F.lit(f":v{version}:"), F.col("chunk_seq").cast("string")).alias("chunk_id"), "session_id", "chunk_seq", "start_seq", "end_seq", "authored_at_ms", "namespace", "project_key", "branch_name", "text",
        text.chunk_kind(F.col("text")).alias("chunk_kind"), text.sensitivity(F.lit("private"), F.col("text")).alias("sensitivity"), F.sha2("text", 256).alias("content_hash"),
    )


def units(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.select(
        F.col("chunk_id").alias("unit_id"), F.lit("transcript_chunk").alias("source_type"), F.col("chunk_id").alias("source_id"), F.lit("transcript").alias("memory_space"), "namespace",
        F.col("chunk_kind").alias("unit_kind"), F.lit("").alias("title"), F.col("text").alias("body"), "sensitivity", F.lit("active").alias("state"), F.lit("").alias("source_uri"), "project_key", "branch_name", "authored_at_ms",
    )


def artifact_spans(chunk_rows: DataFrame) -> DataFrame:
    """Every URI or path in the chunks with byte offsets, lines, title and ids. The fold finds each
    match from where the one before it ended."""
    found = F.regexp_extract_all("text", F.lit(text.ARTIFACT), F.lit(1))
    empty = F.expr("named_struct('next', 1, 'out', cast(array() as array<struct<uri: string, at: int>>))")

    def step(state, uri):
        at = F.locate_from(uri, state["next"]) if hasattr(F, "locate_from") else F.call_function("locate", uri, F.col("text"), state["next"])
        return F.struct((at + F.length(uri)).alias("next"), F.concat(state["out"], F.array(F.struct(uri.alias("uri"), at.alias("at")))).alias("out"))

    rows = chunk_rows.filter(F.col("text").rlike(text.ARTIFACT)).select("chunk_id", "text", "authored_at_ms", F.posexplode(F.aggregate(found, empty, step)["out"]).alias("ordinal", "m"))
    uri, at = F.col("m.uri"), F.col("m.at")
    before, through = F.substring("text", F.lit(1), at - 1), F.substring("text", F.lit(1), at - 1 + F.length(uri))
    line = lambda part: (F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select(
        "chunk_id", F.col("ordinal").cast("long").alias("ordinal"), uri.alias("uri"), F.concat(F.lit("artifact_"), F.sha2(uri, 256)).alias("artifact_id"), text.base_name(uri).alias("title"),
        F.octet_length(before).cast("long").alias("start_offset"), F.octet_length(through).cast("long").alias("end_offset"), line(before).alias("start_line"), line(through).alias("end_line"), F.sha2(uri, 256).alias("quote_hash"), "authored_at_ms",
    )


def candidates(chunk_rows: DataFrame) -> DataFrame:
    """Promotion candidates of the chunks of promotable kinds."""
    return chunk_rows.filter(F.col("chunk_kind").isin(*text.PROMOTABLE)).select(
        F.concat(F.lit("cand_"), F.sha2("chunk_id", 256)).alias("candidate_id"), "chunk_id", F.col("chunk_kind").alias("candidate_type"), text.candidate_subject(F.col("chunk_kind"), F.col("text")).alias("subject"),
        F.col("text").alias("body"), "namespace", "project_key", "branch_name", "sensitivity", F.lit("pending").alias("status"), "authored_at_ms",
    )


def message_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sequence numbers that come again with another content: such a session is refused."""
    old = stored.select("session_id", "seq", F.sha2("content", 256).alias("stored_hash"))
    new = incoming.select("session_id", "seq", F.sha2("content", 256).alias("incoming_hash"))
    return old.join(new, ["session_id", "seq"]).filter("stored_hash <> incoming_hash")


def merged_messages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Messages after an upsert by (session_id, seq): one that comes again with the same content takes the incoming role and time, one with another content
    stays as it is (message_conflicts() tells of it), and new ones are added. Incoming messages are one for each number."""
    key, rest = ["session_id", "seq"], ["role", "content", "authored_at_ms"]
    both = stored.select(*key, F.struct(*rest).alias("old")).join(incoming.select(*key, F.struct(*rest).alias("new")), key, "full")
    takes = F.col("old").isNull() | F.coalesce(F.sha2(F.col("old.content"), 256) == F.sha2(F.col("new.content"), 256), F.lit(False))
    return both.select(*key, F.when(takes, F.col("new")).otherwise(F.col("old")).alias("m")).select(*key, "m.*")
