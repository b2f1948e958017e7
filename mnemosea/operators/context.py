"""Context bundles and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemosea.functions import ranking, text
from mnemosea.operators import graph, recall, search
from mnemosea.sources.shared import kept

#: Section: spaces, kinds.
SECTIONS = {
    "active_private_decisions": (("private",), ("decision", "rationale", "design_rationale")),
    "shared_constraints": (("shared",), ("decision", "rationale", "fact")),
    "recent_discussions": (("transcript",), ()),
    "open_tasks": (("private", "shared"), ("task_candidate",)),
    "rejected_options": (("private", "shared", "transcript"), ()),
}
REJECTED = ("rejected_option", "rejected", "却下", "superseded")


def sections(t, queries: DataFrame, *, limit: int = 5, as_of_ms: int, rejected_words: tuple[str, ...] = REJECTED, profile: str = "default", semantic: bool = True) -> DataFrame:
    """(query_id, section, unit_id, score, rank, source_uri): a recall for each section with its lanes and kinds. For
    rejected options four times as many are recalled, and those that say so stay.

    All sections go through one plan: the index is searched once, and ranks are counted within (query, section).
    """
    keys = ("query_id", "section")
    wide = F.col("section") == "rejected_options"
    cap = F.when(wide, max(recall.CANDIDATES, 40 * limit)).otherwise(max(recall.CANDIDATES, 10 * limit))
    units = t.units
    index = t.index
    names = list(SECTIONS)
    most = {i: max(recall.CANDIDATES, (40 if n == "rejected_options" else 10) * limit) for i, n in enumerate(names)}
    fits = [F.when(F.col("memory_space").isin(*spaces) & (F.col("unit_kind").isin(*kinds) if kinds else F.lit(True)), F.lit(i)) for i, (spaces, kinds) in enumerate(SECTIONS.values())]
    placed = kept(units.select("unit_id", F.explode(F.array_compact(F.array(*fits))).alias("mark")))
    section = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("mark") + 1).alias("section")
    matched = search.scores(index, queries, placed, most).select("query_id", section, "unit_id", "bm25")
    lexical = kept(search.ranked(matched, [F.col("bm25"), F.col("unit_id")], cap, "lexical_rank", keys))
    placed = placed.select("unit_id", section)
    pairs = queries.select("query_id", "query", F.explode(F.array(*[F.lit(n) for n in SECTIONS])).alias("section"))
    unmatched = pairs.join(lexical.select(*keys).distinct(), list(keys), "left_anti")
    columns = [*keys, "unit_id", "lexical_rank"]
    found = lexical.select(*columns)
    if unmatched.head(1):
        other = search.containment_scores(index.texts, unmatched.select("query_id", "query").distinct()).join(placed, "unit_id").join(unmatched.select(*keys), list(keys), "left_semi")
        found = found.unionByName(search.ranked(other, [F.col("matches").desc(), F.col("unit_id")], cap, "lexical_rank", keys).select(*columns))
    if semantic:
        # The nearest vectors are taken before a section's lanes and kinds filter them, as many as its cap says.
        near = index.nearest(search.query_vectors(queries, index.dim), max(recall.CANDIDATES, 40 * limit)).join(placed, "unit_id").filter(F.col("semantic_rank") <= cap)
        near = search.ranked(near.drop("semantic_rank"), [F.col("distance"), F.col("unit_id")], cap, "semantic_rank", keys)
        found = found.join(near.select(*keys, "unit_id", "semantic_rank"), [*keys, "unit_id"], "full")
        found = found.select(*keys, "unit_id", F.coalesce("lexical_rank", F.lit(0)).cast("long").alias("lexical_rank"), F.coalesce("semantic_rank", F.lit(0)).cast("long").alias("semantic_rank"))
    else:
        found = found.withColumn("semantic_rank", F.lit(0).cast("long"))
    found = kept(found)
    rows = recall.with_features(recall.enriched(found, units, t.nodes, t.verification, t.peers, t.chunk_versions), t.edges, t.spans)
    rows = recall.best(recall.scored(rows, queries, profile=profile, as_of_ms=as_of_ms), F.when(wide, 4 * limit).otherwise(limit), keys)
    said = text.any_of(F.lower(F.concat_ws("\n", "unit_kind", "subject", "body", "state")), rejected_words)
    rows = rows.filter(~wide | said).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")).cast("long")).filter(F.col("rank") <= limit)
    return rows.select(*keys, "unit_id", "score", "rank", "source_uri")


def artifacts(section_rows: DataFrame, spans: DataFrame, refs: DataFrame, *, limit: int = 5) -> DataFrame:
    """(query_id, uri, title, place): sources of the bundle's units first, then what their spans quote; each URI once."""
    section_rows = kept(section_rows)  # ``limit`` rows for each query and section
    own = section_rows.filter("source_uri <> ''").select("query_id", F.col("source_uri").alias("uri"), F.lit("").alias("title"), F.lit(0).alias("way"))
    named = refs.select("artifact_id", "uri", "title").distinct()
    quoted = section_rows.select("query_id", F.col("unit_id").alias("memory_id")).distinct().join(spans.select("memory_id", "artifact_id"), "memory_id").join(named, "artifact_id").select("query_id", "uri", "title", F.lit(1).alias("way"))
    first = own.unionByName(quoted).groupBy("query_id", "uri").agg(F.min_by("title", "way").alias("title"))
    w = Window.partitionBy("query_id").orderBy("title", "uri")
    return first.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= limit)


def explained(nodes: DataFrame, verification: DataFrame, peers: DataFrame) -> DataFrame:
    rows = nodes.join(verification, "memory_id", "left").join(peers.select(F.col("peer_id").alias("origin_peer_id"), "trust_weight"), "origin_peer_id", "left")
    status = F.coalesce("signature_status", F.lit(""))
    return rows.select(
        "memory_id", "memory_space", status.alias("signature_status"), F.coalesce("trust_weight", F.lit(1.0)).alias("trust_weight"), (status != "invalid_signature").alias("recall_eligible"),
        ranking.bucket(F.col("memory_space"), status, F.col("has_signature")).alias("bucket"),
    )


def explained_with_signals(nodes: DataFrame, verification: DataFrame, peers: DataFrame, signals: DataFrame, lexical: DataFrame) -> DataFrame:
    per_type = graph.signal_summary(signals)
    total = per_type.groupBy("memory_id").agg(F.sum("signals").alias("signals"), F.round(F.sum("total_value"), 4).alias("total_value"))
    found = lexical.select(F.col("unit_id").alias("memory_id"), "bm25")
    rows = explained(nodes, verification, peers).join(total, "memory_id", "left").join(found, "memory_id", "left")
    return rows.withColumn("matched", F.col("bm25").isNotNull()).fillna({"signals": 0, "total_value": 0.0, "bm25": 0.0})
