"""Write flows as dataflows: store, supersede, signal, promote, publish, review, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosea.functions import text
from mnemosea.functions.text import first_non_empty

# Fixed values.
STORE_RELATIONS = ("supports", "contradicts", "derived_from", "about", "caused_by", "references")
SIGNAL_TYPES = ("reinforce", "deprecate", "confirm", "deny", "pin", "bookmark")
PROMOTED_SUBJECT = "promoted transcript memory"
MEMORY_TYPES = ("decision", "rationale", "fact", "task_candidate", "debug_trace", "note")
STORE_DEFAULTS = {"scope": "team", "memory_type": "fact", "author_agent_id": "agent/default", "origin_peer_id": "peer/local"}


def normalise_store(requests: DataFrame) -> DataFrame:
    """Trimmed requests with defaults for what is empty."""
    return requests.withColumns({c: first_non_empty(F.trim(c), F.lit(v)) for c, v in STORE_DEFAULTS.items()})


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both sides' rows, the one with the highest ``order`` for each key."""
    both = stored.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` and those incoming rows whose key is new; of rows with one new key the smallest."""
    new = incoming.join(stored.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return stored.unionByName(new.select(*stored.columns))


def merge_candidates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Candidates after an ingest: pending ones take the new text, decided ones stay."""
    new = incoming.select("candidate_id", F.col("subject").alias("new_subject"), F.lit("pending").alias("new_status"))
    rows = stored.select("candidate_id", "subject", "status").join(new, "candidate_id", "full")
    takes = F.col("new_subject").isNotNull() & (F.coalesce("status", F.lit("pending")) == "pending")
    return rows.select("candidate_id", F.when(takes, F.col("new_subject")).otherwise(F.col("subject")).alias("subject"), F.coalesce("status", "new_status").alias("status"))


def list_candidates(candidates: DataFrame, *, namespace: str = "", status: str = "", project: str = "", branch: str = "", limit: int = 50) -> DataFrame:
    for column, value in (("namespace", namespace), ("status", status), ("project_key", project), ("branch_name", branch)):
        if value:
            candidates = candidates.filter(F.col(column) == value)
    return candidates.orderBy(F.col("authored_at_ms").desc(), F.col("candidate_id")).limit(limit if limit > 0 else 50)


def review(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after review. ``decisions`` (candidate_id, decision, new_subject) act on pending ones only;
    an empty new subject keeps the old one."""
    rows = candidates.join(decisions, "candidate_id", "left")
    acts = (F.col("status") == "pending") & F.col("decision").isNotNull()
    approved = acts & (F.col("decision") == "approve")
    return rows.select(
        "candidate_id", F.when(approved, first_non_empty(F.col("new_subject"), F.col("subject"))).otherwise(F.col("subject")).alias("subject"),
        F.when(approved, "approved").when(acts, "rejected").otherwise(F.col("status")).alias("status"), (F.col("decision").isNotNull() & ~acts).alias("refused"),
    )


def valid_relations(relations: DataFrame) -> DataFrame:
    """Relations with the reason for which a store refuses them, or none; weight 0 means 1."""
    r = F.trim("relation_type")
    reason = (
        F.when(F.trim("to_memory_id") == "", "target is required")
        .when(~r.isin(*STORE_RELATIONS), "unsupported relation type")
        .when(F.col("weight") < 0, "weight must not be negative")
        .when(F.col("from_memory_id") == F.col("to_memory_id"), "relation to itself")
        .otherwise("")
    )
    return relations.select("edge_id", reason.alias("reason"), F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight")).alias("weight"))


def valid_spans(spans: DataFrame) -> DataFrame:
    """Artifact spans (span_id, artifact_id, uri, start_offset, end_offset, start_line, end_line) with the reason for which a store refuses them, or
    none. An end of 0 is no end."""
    places = ("start_offset", "end_offset", "start_line", "end_line")
    given = {c: F.coalesce(c, F.lit(0)) for c in places}
    ordered = lambda what: (given[f"end_{what}"] > 0) & (given[f"end_{what}"] < given[f"start_{what}"])
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = (
        F.when(empty("artifact_id") & empty("uri"), "uri is required")
        .when(F.least(*given.values()) < 0, "offsets and lines must not be negative")
        .when(ordered("offset"), "end_offset must not be before start_offset")
        .when(ordered("line"), "end_line must not be before start_line")
        .otherwise("")
    )
    return spans.select("span_id", reason.alias("reason"))


def valid_signals(requests: DataFrame) -> DataFrame:
    """Signal requests (signal_id, memory_space, memory_id, signal_type, value) with the reason for which they are refused, or none."""
    bare = lambda c: F.trim(F.coalesce(c, F.lit("")))
    reason = (
        F.when(~bare("memory_space").isin("shared", "private"), "memory_space must be shared or private")
        .when(bare("memory_id") == "", "memory_id is required")
        .when(~bare("signal_type").isin(*SIGNAL_TYPES), "unsupported signal type")
        .when(~(F.coalesce("value", F.lit(0.0)) > 0), "value must be greater than 0")
        .otherwise("")
    )
    return requests.select("signal_id", reason.alias("reason"))


def relation_targets(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose target is in the lane of their source."""
    lane = nodes.select("memory_id", "memory_space")
    source = lane.select(F.col("memory_id").alias("from_memory_id"), F.col("memory_space").alias("lane"))
    return relations.join(source, "from_memory_id").join(lane.select(F.col("memory_id").alias("to_memory_id"), F.col("memory_space").alias("lane")), ["to_memory_id", "lane"], "left_semi")


def signal_rows(requests: DataFrame) -> DataFrame:
    """Signals that may be appended: a known type and a positive value."""
    return requests.filter(F.col("signal_type").isin(*SIGNAL_TYPES) & (F.col("value") > 0))


def supersede(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (old_id, new_id): shared nodes with the old ones superseded, and the new edges."""
    shared = nodes.filter("memory_space = 'shared'")
    known = pairs.join(shared.select(F.col("memory_id").alias("old_id")), "old_id", "left_semi")
    old = known.select(F.col("old_id").alias("memory_id")).distinct().withColumn("gone", F.lit(True))
    after = shared.join(old, "memory_id", "left").withColumn("lifecycle_state", F.when(F.col("gone"), "superseded").otherwise(F.col("lifecycle_state"))).drop("gone")
    edges = known.select(F.col("new_id").alias("from_memory_id"), F.col("old_id").alias("to_memory_id"), F.lit("supersedes").alias("relation_type"), F.lit(1.0).alias("weight"))
    return after, edges


def promoted(links: DataFrame, chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """One private memory for each promotion: ``links`` (memory_id, ordinal, chunk_id). Bodies join in the
    requested order; the first artifact URI becomes the source."""
    first = spans.groupBy("chunk_id").agg(F.min_by("uri", F.struct("start_offset", "uri")).alias("uri"))
    rows = links.join(chunks.select("chunk_id", "namespace", "text", "authored_at_ms"), "chunk_id").join(first, "chunk_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text", F.coalesce("uri", F.lit("")).alias("uri"), "namespace")))
    made = rows.groupBy("memory_id").agg(parts.alias("p"), F.max("authored_at_ms").alias("authored_at_ms"))
    uris = F.filter(F.transform("p", lambda x: x["uri"]), lambda u: u != "")
    return made.select(
        "memory_id", F.lit("private").alias("memory_space"), F.element_at("p", 1)["namespace"].alias("namespace"), F.lit("note").alias("memory_type"), F.lit(PROMOTED_SUBJECT).alias("subject"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("body"), F.coalesce(F.try_element_at(uris, F.lit(1)), F.lit("")).alias("source_uri"), "authored_at_ms",
    )


def promoted_types(links: DataFrame, chunks: DataFrame, memory_type: str = "") -> DataFrame:
    """(memory_id, memory_type): the given type, or the kind of a memory's first chunk, or note."""
    first = links.join(chunks.select("chunk_id", "chunk_kind"), "chunk_id").groupBy("memory_id").agg(F.min_by("chunk_kind", F.struct("ordinal", "chunk_id")).alias("kind"))
    own = F.when(F.col("kind").isin(*MEMORY_TYPES), F.col("kind")).otherwise("note")
    return first.select("memory_id", (F.lit(memory_type) if memory_type else own).alias("memory_type"))


def promoted_spans(links: DataFrame, spans: DataFrame) -> DataFrame:
    """What the chunks of promoted memories quote, each span (artifact, quote, place) once for a memory."""
    rows = links.select("memory_id", "chunk_id").join(spans, "chunk_id")
    once = rows.groupBy("memory_id", "artifact_id", "quote_hash", "start_offset", "end_offset").agg(F.min("authored_at_ms").alias("authored_at_ms"))
    return once.withColumn("span_id", F.sha2(F.concat_ws("|", "memory_id", "artifact_id", "quote_hash", "start_offset", "end_offset"), 256))


def artifact_rows(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and spans of stored artifacts (memory_id, uri, title, namespace, start_offset, end_offset, quote_hash, authored_at_ms)."""
    rows = artifacts.withColumn("artifact_id", F.concat(F.lit("artifact_"), F.sha2("uri", 256)))
    span = rows.withColumn("span_id", F.sha2(F.concat_ws("|", "memory_id", "artifact_id", "quote_hash", "start_offset", "end_offset"), 256))
    return rows.select("artifact_id", "uri", "namespace", "title").dropDuplicates(["artifact_id"]), span.select("span_id", "artifact_id", "memory_id", "start_offset", "end_offset", "quote_hash", "authored_at_ms")


def published(private: DataFrame, policy: str = "default") -> DataFrame:
    """Shared copies of private memories, redacted."""
    return private.select(
        F.concat(F.lit("pub_"), F.col("memory_id")).alias("memory_id"), F.col("memory_id").alias("private_memory_id"), F.lit("shared").alias("memory_space"), "namespace", "memory_type",
        text.redact(F.col("subject"), policy).alias("subject"), text.redact(F.col("body"), policy).alias("body"), text.redact_uri(F.col("source_uri"), policy).alias("source_uri"), "authored_at_ms",
    )


def stored(requests: DataFrame) -> dict[str, DataFrame]:
    """What a store writes: nodes, verification, the initial signal, the unit and the index request."""
    r = normalise_store(requests)
    unit = r.select(
        F.col("memory_id").alias("unit_id"), F.concat("memory_space", F.lit("_memory")).alias("source_type"), "memory_space", "namespace", F.col("memory_type").alias("unit_kind"), F.col("subject").alias("title"), "body",
        F.sha2(F.concat_ws("\n", "subject", "body"), 256).alias("body_hash"), F.lit("private").alias("sensitivity"), F.lit("active").alias("state"),
    )
    return {
        "nodes": r,
        "verification": r.filter("memory_space = 'shared'").select("memory_id", F.lit("valid").alias("signature_status")),
        "signals": r.select("memory_id", F.lit("store").alias("signal_type"), F.lit(1.0).alias("value"), "authored_at_ms"),
        "units": unit,
        "queue": unit.select("unit_id", F.lit(0).cast("long").alias("processed_at_ms")),
    }


#: Change-log rows are numbered within spans of this many milliseconds.
LOG_SPAN_MS = 3_600_000


def change_log(rows: DataFrame, table: str, pk: str, namespace: Column, base_version: int = 0) -> DataFrame:
    """Change-log rows of an inserted batch. Versions follow the order of (authored_at_ms, pk). Rows are
    numbered within each hour, and hours from their counts, so no task sorts the batch."""
    rows = rows.withColumn("span", F.floor(F.col("authored_at_ms") / LOG_SPAN_MS))
    spans = rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"))  # a row for each hour
    before = F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(spans.select("span", before.alias("before")), "span")
    within = F.row_number().over(Window.partitionBy("span").orderBy("authored_at_ms", pk))
    version = (F.col("before") + within + base_version).cast("long")
    return numbered.select(version.alias("db_version"), F.lit(table).alias("table_name"), F.col(pk).alias("pk_hint"), namespace.alias("namespace"), F.col("authored_at_ms").alias("changed_at_ms"))


#: Characters of a key by which updates and deletes, which all have one time, are numbered in parts.
KEY_PREFIX = 4


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, table: str, *, now_ms: int, at: str = "authored_at_ms") -> DataFrame:
    """What turned the table ``before`` into ``after``: table_name, pk_hint, op, changed_at_ms and the row (as it is by now, or as it was if it was
    deleted). An insert has the time of its row, an update and a delete have ``now_ms``. Columns are compared with null equal to null."""
    rest = [c for c in after.columns if c != key]
    old, new = (t.select(key, F.struct(*rest).alias(name)) for t, name in ((before, "was"), (after, "now")))
    both = old.join(new, key, "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    op = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").otherwise("update")
    row = F.coalesce("now", "was")
    changed = F.when(F.col("was").isNull(), row[at]).otherwise(F.lit(now_ms)).cast("long")
    return both.select(F.lit(table).alias("table_name"), F.col(key).alias("pk_hint"), op.alias("op"), changed.alias("changed_at_ms"), row.alias("row"))


def numbered_log(changes: DataFrame, base_version: int = 0) -> DataFrame:
    """``changes`` (table_name, pk_hint, op, changed_at_ms, ...) with db_version: inserts first, in the order of their time, table and key; then
    updates and deletes in the order of table and key. Inserts are numbered within each hour, the others within each table and
    beginning of a key, and these parts from their counts, so no task sorts the log."""
    late = F.col("op") != "insert"
    parts = {"late": late.cast("int"), "span": F.when(late, 0).otherwise(F.floor(F.col("changed_at_ms") / LOG_SPAN_MS)).cast("long"), "kind": F.when(late, F.col("table_name")).otherwise(""), "start": F.when(late, F.substring("pk_hint", 1, KEY_PREFIX)).otherwise("")}
    rows = changes.withColumns(parts)
    sizes = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))  # a row for each hour, and for each table and beginning of a key
    before = F.coalesce(F.sum("n").over(Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.withColumn("before", before).drop("n"), list(parts))
    within = F.row_number().over(Window.partitionBy(*parts).orderBy("changed_at_ms", "table_name", "pk_hint"))
    return placed.withColumn("db_version", (F.col("before") + within + base_version).cast("long")).drop(*parts, "before")


def change_capture(before: dict[str, DataFrame], after: dict[str, DataFrame], *, now_ms: int, base_version: int = 0) -> DataFrame:
    """The change log (db_version, table_name, pk_hint, op, namespace, memory_id, changed_at_ms) of what turned the tables ``before`` into
    ``after``: nodes, edges, signals, artifacts and spans. An edge belongs to the namespace of its first end that is a node, a signal to
    that of its memory, a span to that of its memory or else of its artifact; nodes are looked up as they are by now."""
    names = {"nodes": ("memory_nodes", "memory_id"), "edges": ("memory_edges", "edge_id"), "signals": ("memory_signals", "signal_id"), "artifacts": ("artifact_refs", "artifact_id"), "spans": ("artifact_spans", "span_id")}
    space = after["nodes"].select(F.col("memory_id").alias("of"), F.col("namespace").alias("ns"))
    own = lambda c, name: space.withColumnsRenamed({"of": c, "ns": name})
    out = None
    for table, (name, key) in names.items():
        if table not in after:
            continue
        timed = lambda t: t if "authored_at_ms" in t.columns else t.withColumn("authored_at_ms", F.lit(now_ms).cast("long"))
        made = snapshot_changes(timed(before[table]), timed(after[table]), key, name, now_ms=now_ms)
        if table == "nodes":
            made = made.withColumns({"memory_id": F.col("pk_hint"), "namespace": F.col("row.namespace")})
        elif table == "edges":
            made = made.withColumns({"a": F.col("row.from_memory_id"), "b": F.col("row.to_memory_id")}).join(own("a", "ns_a"), "a", "left").join(own("b", "ns_b"), "b", "left")
            made = made.withColumns({"memory_id": F.coalesce("a", "b", F.lit("")), "namespace": F.coalesce("ns_a", "ns_b", F.lit(""))})
        elif table == "signals":
            made = made.withColumn("memory_id", F.col("row.memory_id")).join(own("memory_id", "ns"), "memory_id", "left").withColumn("namespace", F.coalesce("ns", F.lit("")))
        elif table == "artifacts":
            made = made.withColumns({"memory_id": F.lit(""), "namespace": F.coalesce("row.namespace", F.lit(""))})
        else:
            refs = after["artifacts"].groupBy("artifact_id").agg(F.min("namespace").alias("ref_ns"))
            made = made.withColumns({"memory_id": F.coalesce("row.memory_id", F.lit("")), "artifact_id": F.col("row.artifact_id")}).join(own("memory_id", "ns"), "memory_id", "left").join(refs, "artifact_id", "left")
            made = made.withColumn("namespace", F.coalesce("ns", "ref_ns", F.lit("")))
        made = made.select("table_name", "pk_hint", "op", "namespace", "memory_id", "changed_at_ms")
        out = made if out is None else out.unionByName(made)
    return numbered_log(out, base_version)
