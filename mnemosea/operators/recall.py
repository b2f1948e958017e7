"""Recall: candidates, enrichment, features, score and the best k for each query, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemosea.functions import ranking
from mnemosea.operators import graph, search
from mnemosea.sources.shared import kept

CANDIDATES = 50
#: Ids of candidates that are sent to every task; more are joined by a shuffle.
SENT = 500_000


def allowed_spaces(private: bool = False, shared: bool = False, transcript: bool = False) -> list[str]:
    """Without a flag, private and shared; otherwise exactly the flagged ones."""
    if not (private or shared or transcript):
        return ["private", "shared"]
    return [s for s, on in (("private", private), ("shared", shared), ("transcript", transcript)) if on]


def filter_units(units: DataFrame, *, spaces=(), namespaces=(), source_types=(), kinds=()) -> DataFrame:
    """Only lists that are not empty filter."""
    for column, values in (("memory_space", spaces), ("namespace", namespaces), ("source_type", source_types), ("unit_kind", kinds)):
        if values:
            units = units.filter(F.col(column).isin(*values))
    return units


def latest_chunks(units: DataFrame, versions: DataFrame) -> DataFrame:
    """``units`` without those of chunks that a newer version of their session replaces."""
    return units.join(replaced_chunks(versions), "unit_id", "left_anti")


def merged(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Candidates of both kinds; a rank of 0 says that one side does not have the unit."""
    both = semantic.select("query_id", "unit_id", "semantic_rank").join(lexical.select("query_id", "unit_id", "lexical_rank"), ["query_id", "unit_id"], "full")
    return both.select("query_id", "unit_id", F.coalesce("semantic_rank", F.lit(0)).cast("long").alias("semantic_rank"), F.coalesce("lexical_rank", F.lit(0)).cast("long").alias("lexical_rank"))


def replaced_chunks(versions: DataFrame) -> DataFrame:
    """(unit_id) of the chunks that a newer version of their session replaces."""
    newest = versions.groupBy("session_id").agg(F.max("chunk_strategy_version").alias("newest"))
    return versions.join(newest, "session_id").filter("chunk_strategy_version < newest").select(F.col("chunk_id").alias("unit_id"))


def wanted(rows: DataFrame) -> DataFrame:
    """The distinct unit_id of ``rows``, which are sent to where texts and edges are read unless they are very many."""
    ids = rows.select("unit_id").distinct()
    return F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids


def enriched(candidates: DataFrame, units: DataFrame, nodes: DataFrame, verification: DataFrame, peers: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Candidates with what their units, nodes, signatures and peers say. Trust counts for shared
    memory only; invalid signatures, inactive units and replaced chunks go."""
    if versions is not None:
        candidates = candidates.join(replaced_chunks(versions), "unit_id", "left_anti")
    n = nodes.select(F.col("memory_id").alias("unit_id"), "origin_peer_id", F.col("has_signature").alias("signed"))
    v = verification.select(F.col("memory_id").alias("unit_id"), F.col("signature_status").alias("found_status"))
    p = peers.select(F.col("peer_id").alias("origin_peer_id"), F.col("trust_weight").alias("peer_weight"))
    ids = wanted(candidates)
    u, n, v = (r.join(ids, "unit_id", "left_semi") for r in (units.filter("state = 'active'"), n, v))
    rows = candidates.join(u, "unit_id").join(n, "unit_id", "left").join(v, "unit_id", "left").join(p, "origin_peer_id", "left")
    shared = F.col("memory_space") == "shared"
    rows = rows.withColumn("signature_status", F.coalesce("found_status", F.lit(""))).filter("signature_status <> 'invalid_signature'")
    return rows.select(
        *candidates.columns, "memory_space", "namespace", "unit_kind", F.col("title").alias("subject"), "body", "source_uri", "state", "authored_at_ms", "signature_status",
        F.coalesce(shared & F.col("signed"), F.lit(False)).alias("has_signature"),
        F.when(shared, F.coalesce("peer_weight", F.lit(1.0))).otherwise(1.0).alias("trust_weight"),
        F.when(shared, F.coalesce("origin_peer_id", F.lit(""))).otherwise("").alias("origin_peer_id"),
    )


def with_features(rows: DataFrame, edges: DataFrame, spans: DataFrame) -> DataFrame:
    """Graph and artifact figures of the candidates; edges and spans of others are dropped first."""
    rows = kept(rows)  # three times read, and as many as the candidates
    ids = wanted(rows).withColumnRenamed("unit_id", "memory_id")
    g = graph.stats(edges, ids).withColumnRenamed("memory_id", "unit_id")
    a = graph.artifact_stats(spans, ids).withColumnRenamed("memory_id", "unit_id")
    zero = {"edge_count": 0, "support_weight": 0.0, "contradict_weight": 0.0, "span_count": 0, "quote_count": 0}
    return rows.join(g, "unit_id", "left").join(a, "unit_id", "left").fillna(zero)


def scored(rows: DataFrame, queries: DataFrame, *, profile: str, as_of_ms: int) -> DataFrame:
    return rows.join(queries, "query_id").withColumn("score", F.round(ranking.total_score(ranking.profile(profile), as_of_ms), 6))


def best(rows: DataFrame, k, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("authored_at_ms").desc(), F.col("unit_id"))
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def semantic_candidates(index, queries: DataFrame, allowed: DataFrame | None, cap: int, *, prefilter: bool, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, unit_id, semantic_rank) of the nearest vectors. ``allowed`` filters what was found, or with
    ``prefilter`` what is looked at."""
    asked = search.query_vectors(queries, index.dim) if asked is None else asked
    near = index.nearest(asked, cap, allowed if prefilter else None)
    if allowed is None or prefilter:
        return near
    near = near.join(allowed.select("unit_id"), "unit_id", "left_semi").drop("semantic_rank")
    return search.ranked(near, [F.col("distance"), F.col("unit_id")], cap, "semantic_rank")


def recall(t, queries: DataFrame, *, limit: int = 10, profile: str = "default", as_of_ms: int, spaces=(), namespaces=(), kinds=(), semantic: bool = True, project: str = "", branch: str = "", prefilter: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """The best units for each row of ``queries`` (query_id, query); ``t`` has the model's tables and its index.

    Candidates come from the text index and from the nearest vectors; with ``semantic`` unset from the text index only.
    Project and branch bind the vector side only. Vector candidates are taken first and filtered after,
    unless ``prefilter`` is set. ``asked`` (query_id, qv) has the queries' vectors, if not local ones.
    """
    units = t.units
    listed = spaces or namespaces or kinds
    allowed = filter_units(units, spaces=spaces, namespaces=namespaces, kinds=kinds)
    cap = max(CANDIDATES, 10 * limit)
    found = search.lexical_with_fallback(t.index, queries, cap, allowed if listed else None)
    if semantic:
        may = allowed
        if project:
            may = may.filter(F.col("project_key") == project)
        if branch:
            may = may.filter(F.col("branch_name") == branch)
        found = merged(semantic_candidates(t.index, queries, may if listed or project or branch else None, cap, prefilter=prefilter, asked=asked), found)
    else:
        found = found.withColumn("semantic_rank", F.lit(0).cast("long")).select("query_id", "unit_id", "semantic_rank", "lexical_rank")
    # Two times the cap for each query at most; of few queries it is so small that it is held.
    found = search.held(found) if search.is_few(queries) else kept(found)
    rows = with_features(enriched(found, units, t.nodes, t.verification, t.peers, t.chunk_versions), t.edges, t.spans)
    return best(scored(rows, queries, profile=profile, as_of_ms=as_of_ms), limit)


def legacy(t, queries: DataFrame, *, limit: int = 10, as_of_ms: int) -> DataFrame:
    """Recall of memories by text only, with the default weights; ties go by bucket, trust, age, lane and id."""
    memories = filter_units(t.units, spaces=("private", "shared"))
    found = kept(search.lexical(t.index, queries, max(CANDIDATES, 10 * limit), memories)).withColumn("semantic_rank", F.lit(0).cast("long")).select("query_id", "unit_id", "semantic_rank", "lexical_rank")
    rows = scored(with_features(enriched(found, t.units, t.nodes, t.verification, t.peers), t.edges, t.spans), queries, profile="default", as_of_ms=as_of_ms)
    bucket = ranking.bucket(F.col("memory_space"), F.col("signature_status"), F.col("has_signature"))
    by = [F.col("score").desc(), bucket, F.col("trust_weight").desc(), F.col("authored_at_ms").desc(), F.col("memory_space"), F.col("unit_id")]
    return search.ranked(rows, by, limit, "rank")
