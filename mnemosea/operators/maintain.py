"""Index and integrity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 10


def index_diagnostics(queue: DataFrame, now_ms: int) -> DataFrame:
    pending = F.col("processed_at_ms") == 0
    oldest = F.min(F.when(pending, F.col("enqueued_at_ms")))
    return queue.agg(
        F.sum(F.when(pending, 1).otherwise(0)).alias("pending"), F.sum(F.when(pending, 0).otherwise(1)).alias("processed"), F.coalesce(F.lit(now_ms) - oldest, F.lit(0)).alias("oldest_age_ms"),
    )


def next_items(queue: DataFrame, limit: int = 128) -> DataFrame:
    """The open requests that a tick takes, oldest first."""
    return queue.filter("processed_at_ms = 0").orderBy("enqueued_at_ms", "unit_id").limit(limit)


def sampled_counts(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Count and the first ids of each group. Ids are kept as the smallest ones of each task, never all."""
    from pyspark.sql import Window

    first = Window.partitionBy(group).orderBy(key)
    samples = rows.select(group, key).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SAMPLES)
    samples = samples.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("sample_ids"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(samples, group)


def signature_status(nodes: DataFrame, peers: DataFrame, verification: DataFrame) -> DataFrame:
    """Status of each shared node's signature: missing, of an unknown peer, invalid or valid."""
    shared = nodes.filter("memory_space = 'shared'").select("memory_id", "origin_peer_id", "has_signature")
    known = peers.select(F.col("peer_id").alias("origin_peer_id"), F.lit(True).alias("known"))
    rows = shared.join(known, "origin_peer_id", "left").join(verification, "memory_id", "left")
    status = F.when(~F.col("has_signature"), "missing_signature").when(F.col("known").isNull(), "unknown_peer").when(F.col("signature_status") == "invalid_signature", "invalid_signature").otherwise("valid")
    return rows.select("memory_id", status.alias("status"))


def retrieval_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """recall_at_5 and mrr_at_10 of ranked results (query_id, unit_id, rank) against (query_id, unit_id)."""
    hits = expected.join(results, ["query_id", "unit_id"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    return hits.agg(F.round(F.avg(F.when(F.col("best") <= 5, 1.0).otherwise(0.0)), 6).alias("recall_at_5"), F.round(F.avg(F.when(F.col("best") <= 10, 1.0 / F.col("best")).otherwise(0.0)), 6).alias("mrr_at_10"), F.count(F.lit(1)).alias("queries"))
