"""The parts of the recall score, as column expressions, and the ranking profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    semantic: float
    lexical: float
    graph: float
    artifact: float
    recency: float
    source: float
    exact: float
    transcript: float


#: Fixed values.
DEFAULT = Profile(semantic=0.60, lexical=0.40, graph=40.0, artifact=40.0, recency=5.0, source=20.0, exact=0.0, transcript=25.0)
JA = Profile(semantic=0.80, lexical=0.50, graph=42.0, artifact=40.0, recency=5.0, source=24.0, exact=30.0, transcript=40.0)
CONTRADICTIONS = ("contradicts", "contradiction", "denies")


def profile(name: str) -> Profile:
    return JA if name.strip().lower() in ("ja", "ja-default") else DEFAULT


def bucket(space: Column, status: Column, has_signature: Column) -> Column:
    """0 private or valid, 1 unsigned, transcript or unsure, 2 unknown peer."""
    return (
        F.when(space == "private", 0)
        .when(status == "valid", 0)
        .when(status == "missing_signature", 1)
        .when(status == "unknown_peer", 2)
        .otherwise(1)
    )


def graph_score(edges: Column, support: Column, contradict: Column) -> Column:
    raw = F.lit(0.15) * edges + F.lit(0.20) * support - F.lit(0.25) * contradict
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def artifact_score(spans: Column, quotes: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.25) * spans + F.lit(0.15) * quotes)


def recency_score(authored: Column, as_of_ms: int) -> Column:
    age = (F.lit(float(as_of_ms)) - authored) / F.lit(3_600_000.0)
    return F.when((authored <= 0) | F.lit(as_of_ms <= 0), 0.0).when(authored > as_of_ms, 1.0).otherwise(F.lit(1.0) / (F.lit(1.0) + age / F.lit(24.0)))


def exact_score(query: Column, subject: Column, body: Column) -> Column:
    q = F.trim(F.lower(query))
    return F.when(q == "", 0.0).when(F.contains(F.lower(subject), q), 1.0).when(F.contains(F.lower(body), q), 0.75).otherwise(0.0)


def source_score(semantic_rank: Column, lexical_rank: Column, p: Profile) -> Column:
    part = lambda rank, w: F.when(rank > 0, F.lit(w) / rank).otherwise(0.0)
    return part(semantic_rank, p.semantic) + part(lexical_rank, p.lexical)


def total_score(p: Profile, as_of_ms: int) -> Column:
    """From the columns that an enriched candidate has."""
    c = F.col
    return (
        (F.lit(3) - bucket(c("memory_space"), c("signature_status"), c("has_signature"))) * F.lit(1000.0)
        + c("trust_weight") * F.lit(100.0)
        + source_score(c("semantic_rank"), c("lexical_rank"), p) * F.lit(p.source)
        + graph_score(c("edge_count"), c("support_weight"), c("contradict_weight")) * F.lit(p.graph)
        + artifact_score(c("span_count"), c("quote_count")) * F.lit(p.artifact)
        + recency_score(c("authored_at_ms"), as_of_ms) * F.lit(p.recency)
        + exact_score(c("query"), c("subject"), c("body")) * F.lit(p.exact)
        + F.when(c("memory_space") == "transcript", p.transcript).otherwise(0.0)
    )
