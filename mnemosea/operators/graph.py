"""Graph and provenance: statistics, orphans, suspensions, traces, promotion edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosea.functions import ranking, text


def stats(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """memory_id, edge_count, support_weight, contradict_weight over edges in both directions; a
    self-loop counts twice."""
    ends = edges.select(F.explode(F.array("from_memory_id", "to_memory_id")).alias("memory_id"), "relation_type", "weight")
    if wanted is not None:
        ends = ends.join(wanted, "memory_id", "left_semi")
    against = F.col("relation_type").isin(*ranking.CONTRADICTIONS)
    return ends.groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.round(F.sum(F.when(against, 0.0).otherwise(F.col("weight"))), 6).alias("support_weight"),
        F.round(F.sum(F.when(against, F.col("weight")).otherwise(0.0)), 6).alias("contradict_weight"),
    )


def artifact_stats(spans: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    if wanted is not None:
        spans = spans.join(wanted, "memory_id", "left_semi")
    return spans.groupBy("memory_id").agg(F.count(F.lit(1)).alias("span_count"), F.sum(F.when(F.col("quote_hash") != "", 1).otherwise(0)).alias("quote_count"))


def signal_summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("memory_id", "signal_type").agg(F.count(F.lit(1)).alias("signals"), F.round(F.sum("value"), 4).alias("total_value"), F.max("authored_at_ms").alias("latest_at_ms"))


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is missing, with which."""
    ids = nodes.select("memory_id")
    rows = edges.join(ids.select(F.col("memory_id").alias("src")), F.col("from_memory_id") == F.col("src"), "left").join(ids.select(F.col("memory_id").alias("dst")), F.col("to_memory_id") == F.col("dst"), "left")
    detail = F.trim(F.concat(F.when(F.col("src").isNull(), "missing_from ").otherwise(""), F.when(F.col("dst").isNull(), "missing_to").otherwise("")))
    return rows.filter("src is null or dst is null").select("edge_id", F.col("from_memory_id").alias("memory_id"), detail.alias("detail"))


def orphan_signals(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    return signals.join(nodes.select("memory_id"), "memory_id", "left_anti").select("signal_id", "memory_id", F.lit("missing_memory").alias("detail"))


def suspensions(edges: DataFrame, signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is suspended now."""
    e = orphan_edges(edges, nodes).select(F.lit("memory_edge").alias("entity_type"), F.col("edge_id").alias("entity_id"), "memory_id", "detail")
    s = orphan_signals(signals, nodes).select(F.lit("memory_signal").alias("entity_type"), F.col("signal_id").alias("entity_id"), "memory_id", "detail")
    return e.unionByName(s)


def merge_suspensions(stored: DataFrame, current: DataFrame, now_ms: int) -> DataFrame:
    """Stored suspensions brought up to date: current ones are active with their first sighting kept,
    active ones that are no orphans any more are resolved."""
    now = F.lit(now_ms).cast("long")
    old = stored.select("entity_type", "entity_id", F.col("detail").alias("old_detail"), "first_seen_at_ms", "last_seen_at_ms", "resolved_at_ms")
    rows = current.select("entity_type", "entity_id", "detail").join(old, ["entity_type", "entity_id"], "full")
    is_now = F.col("detail").isNotNull()
    return rows.select(
        "entity_type", "entity_id", F.coalesce("detail", "old_detail").alias("detail"), F.coalesce("first_seen_at_ms", now).alias("first_seen_at_ms"),
        F.when(is_now, now).otherwise(F.col("last_seen_at_ms")).alias("last_seen_at_ms"),
        F.when(is_now, F.lit(0).cast("long")).when(F.col("resolved_at_ms") == 0, now).otherwise(F.col("resolved_at_ms")).alias("resolved_at_ms"),
    )


def active_edges(edges: DataFrame, suspended: DataFrame) -> DataFrame:
    gone = suspended.filter("entity_type = 'memory_edge'").select(F.col("entity_id").alias("edge_id"))
    return edges.join(gone, "edge_id", "left_anti")


def trace(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """Hops (root_id, hop, edge_id, from, to, relation, contradiction) of a bounded walk along outgoing edges.

    Every edge of the frontier is a hop, also back to visited nodes; only new nodes
    carry the walk on. Edges to missing nodes are skipped. The plan grows with the depth, and
    no step brings rows to the driver.
    """
    known = nodes.select(F.col("memory_id").alias("to_memory_id"))
    steps = edges.join(known, "to_memory_id", "left_semi").select("edge_id", "from_memory_id", "to_memory_id", "relation_type", "weight")
    frontier = roots.select("root_id", F.col("root_id").alias("from_memory_id"))
    visited, hops = frontier, None
    for level in range(1, max(1, depth) + 1):
        level_hops = frontier.join(steps, "from_memory_id").withColumn("hop", F.lit(level).cast("long"))
        hops = level_hops if hops is None else hops.unionByName(level_hops)
        new = level_hops.select("root_id", F.col("to_memory_id").alias("from_memory_id")).distinct()
        frontier = new.join(visited, ["root_id", "from_memory_id"], "left_anti")
        visited = visited.unionByName(frontier)
    return hops.select("root_id", "hop", "edge_id", "from_memory_id", "to_memory_id", "relation_type", F.round("weight", 6).alias("weight"), F.col("relation_type").isin(*ranking.CONTRADICTIONS).alias("contradiction"))


#: Folders of a store of edges, by the node that an edge leaves.
EDGE_BUCKETS = 64
_EDGE = "edge_id string, from_memory_id string, to_memory_id string, relation_type string, weight double, bucket int"


def edge_bucket(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(EDGE_BUCKETS)).cast("int")


@dataclass(frozen=True)
class EdgeStore:
    """Edges in folders by the node that they leave, so a walk reads only those of its frontier. A node with very many edges is many
    files of its folder and loads no single task, as the frontier is sent to where the edges are read."""

    spark: SparkSession
    folder: str

    @classmethod
    def write(cls, edges: DataFrame, nodes: DataFrame, folder: str) -> EdgeStore:
        """Stores the edges whose target is a node."""
        known = edges.join(nodes.select(F.col("memory_id").alias("to_memory_id")), "to_memory_id", "left_semi")
        rows = known.select("edge_id", "from_memory_id", "to_memory_id", "relation_type", "weight", edge_bucket(F.col("from_memory_id")).alias("bucket"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "from_memory_id").write.partitionBy("bucket").parquet(folder)
        return cls(edges.sparkSession, folder)

    def edges(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(_EDGE).parquet(self.folder).filter(F.col("bucket").isin(buckets)).drop("bucket")

    def walk(self, roots: DataFrame, depth: int, folder: str) -> DataFrame:
        """trace() of the stored edges: each level's hops and next frontier are written, so no plan is deeper than a level, and the walk ends where
        nothing new is reached."""
        spark = self.spark
        frontier = roots.select("root_id", F.col("root_id").alias("from_memory_id")).distinct()
        hop, at = "root_id string, edge_id string, from_memory_id string, to_memory_id string, relation_type string, weight double, hop long", "root_id string, from_memory_id string"
        seen: list[str] = []
        for level in range(1, max(1, depth) + 1):
            frontier.write.parquet(f"{folder}/frontier/level={level}")
            frontier = spark.read.schema(at).parquet(f"{folder}/frontier/level={level}")
            buckets = [r["b"] for r in frontier.select(edge_bucket(F.col("from_memory_id")).alias("b")).distinct().collect()]  # EDGE_BUCKETS at most
            if not buckets:
                break
            seen.append(f"{folder}/frontier/level={level}")
            self.edges(buckets).join(frontier, "from_memory_id").select("root_id", "edge_id", "from_memory_id", "to_memory_id", "relation_type", "weight").write.parquet(f"{folder}/hops/hop={level}")
            if level < depth:
                reached = spark.read.schema(hop.replace(", hop long", "")).parquet(f"{folder}/hops/hop={level}").select("root_id", F.col("to_memory_id").alias("from_memory_id")).distinct()
                frontier = reached.join(spark.read.schema(at).parquet(*seen), ["root_id", "from_memory_id"], "left_anti")
        hops = spark.read.schema(hop).parquet(f"{folder}/hops") if seen else spark.createDataFrame([], hop)
        return hops.select("root_id", "hop", "edge_id", "from_memory_id", "to_memory_id", "relation_type", F.round("weight", 6).alias("weight"), F.col("relation_type").isin(*ranking.CONTRADICTIONS).alias("contradiction"))


def traced_artifacts(memory_ids: DataFrame, spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Spans of the given memories with their artifacts; a span without one is left out."""
    refs = artifacts.select("artifact_id", "uri", "title", "namespace").dropDuplicates(["artifact_id"])
    return spans.join(memory_ids, "memory_id", "left_semi").join(refs, "artifact_id").select("memory_id", "span_id", "artifact_id", "uri", "title", "namespace", "start_offset", "end_offset", "quote_hash")


def transcript_sources(promotions: DataFrame, chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks that a memory was promoted from, with their artifact URIs nested in order."""
    nested = spans.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_offset", "uri"))), lambda x: x["uri"]), " ").alias("artifact_uris"), F.count(F.lit(1)).alias("artifacts"))
    rows = promotions.join(chunks, "chunk_id").join(nested, "chunk_id", "left")
    return rows.select("memory_id", "chunk_id", "session_id", "chunk_kind", "start_seq", "end_seq", "authored_at_ms", F.coalesce("artifact_uris", F.lit("")).alias("artifact_uris"), F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


def promotion_edges(promotions: DataFrame, chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges from each promoted memory to the decisions promoted from the same session, where its chunks
    suggest a relation and the edge does not exist yet."""
    rows = promotions.join(chunks.select("chunk_id", "session_id", "chunk_kind", "text"), "chunk_id")
    reasoning = F.bool_or(F.col("chunk_kind").isin("rationale", "debug_trace", "task_candidate"))
    against = F.bool_or(text.relation_of_promotion(F.col("text"), F.lit(False)) == "contradicts")
    said = rows.groupBy("memory_id").agg(F.coalesce(against, F.lit(False)).alias("against"), reasoning.alias("reasoning"))
    said = said.withColumn("relation_type", F.when(F.col("against"), "contradicts").when(F.col("reasoning"), "supports")).filter("relation_type is not null").select(F.col("memory_id").alias("from_memory_id"), "relation_type")
    sessions = rows.select(F.col("memory_id").alias("from_memory_id"), "session_id").distinct()
    decisions = rows.filter("memory_type = 'decision'").select(F.col("memory_id").alias("to_memory_id"), "session_id").distinct()
    pairs = sessions.join(decisions, "session_id").filter("from_memory_id <> to_memory_id").select("from_memory_id", "to_memory_id").distinct()
    edges = pairs.join(said, "from_memory_id")
    return edges.join(existing.select("from_memory_id", "to_memory_id", "relation_type"), ["from_memory_id", "to_memory_id", "relation_type"], "left_anti").withColumn("weight", F.lit(1.0))
