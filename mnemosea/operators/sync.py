"""Replication: extract, convergent merge, cursors, handshakes, quarantine, status.

The merge is last writer by (column version, typed value, site) for each cell of the row's present life, and
largest causal length for each row. It is commutative, associative and idempotent, so
batches may arrive in any order and more than once. Sent and applied cursors are
kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
EXTRACT_VERSIONS, ENQUEUED = 256, 32
NOT_ALLOWED = "peer is not allowlisted"
OTHER_SCHEMA, OTHER_MANIFEST, OTHER_PROTOCOL = "schema hash mismatch", "crr manifest hash mismatch", "protocol mismatch"
NO_NAMESPACE = "at least one namespace is required"


CELL_COLUMNS = ("tbl", "pk", "cid", "val", "kind", "col_version", "site_id", "cl")


def value_order(val: Column, kind: Column) -> Column:
    """Values as the replicated store orders them: null, numbers by size, text, blobs."""
    number = kind.isin("integer", "real")
    place = F.when(val.isNull() | (kind == "null"), 0).when(number, 1).when(kind == "blob", 3).otherwise(2)
    return F.struct(place.alias("place"), F.when(number, F.try_to_number(val, F.lit("S999999999999999999D9999")).cast("double")).alias("number"), val.alias("text"))


def merged_changes(changes: DataFrame) -> DataFrame:
    """The winning change of each cell, with all columns of CELL_COLUMNS. Only changes of the row's present life count:
    a row that was deleted and made again begins anew, and its causal length says how often."""
    life = changes.groupBy("tbl", "pk").agg(F.max("cl").alias("life"))
    # The last word on a row's life stays even if it has no cell of its own; cells of an earlier life go.
    order = F.struct("col_version", value_order(F.col("val"), F.col("kind")).alias("o"), "site_id", "val", "kind", "cl")
    own = changes.join(life, ["tbl", "pk"])
    cells = own.groupBy("tbl", "pk", "cid").agg(F.max(F.when(F.floor((F.col("cl") + 1) / 2) == F.floor((F.col("life") + 1) / 2), order)).alias("w"), F.max("life").alias("cl"))
    return cells.filter("w is not null").select("tbl", "pk", "cid", F.col("w.val").alias("val"), F.col("w.kind").alias("kind"), F.col("w.col_version").alias("col_version"), F.col("w.site_id").alias("site_id"), "cl")


def merged_cells(changes: DataFrame) -> DataFrame:
    """The winning value of each cell."""
    return merged_changes(changes).select("tbl", "pk", "cid", "val", "col_version", "site_id")


def live_rows(changes: DataFrame) -> DataFrame:
    """(tbl, pk, cl) of rows that are not deleted: odd causal lengths live."""
    return changes.groupBy("tbl", "pk").agg(F.max("cl").alias("cl")).filter("cl % 2 = 1")


def merged_rows(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Live rows with one column for each cell id."""
    cells = merged_cells(changes).join(live_rows(changes), ["tbl", "pk"], "left_semi")
    return cells.groupBy("tbl", "pk").agg(*[F.max(F.when(F.col("cid") == c, F.col("val"))).alias(c) for c in columns])


def extract(changes: DataFrame, namespace: str, cursor: int, limit: int = EXTRACT_VERSIONS) -> DataFrame:
    """All cell changes of the next ``limit`` versions after the cursor that touch the namespace."""
    versions = changes.filter((F.col("namespace") == namespace) & (F.col("db_version") > cursor)).select("db_version").distinct().orderBy("db_version").limit(limit)
    return changes.join(F.broadcast(versions), "db_version", "left_semi")


def cursors(changes: DataFrame, peer: Column) -> DataFrame:
    return changes.groupBy(peer.alias("peer_id"), "namespace").agg(F.max("db_version").alias("applied_version"), F.max("changed_at_ms").alias("updated_at_ms"))


def namespaces_in_common(ours: Column, theirs: Column) -> Column:
    return F.array_sort(F.array_intersect(ours, theirs))


def allowed_peers(requests: DataFrame, peers: DataFrame) -> DataFrame:
    """Requests with allowed; a peer without a policy is not."""
    return requests.join(peers.select("peer_id", "trust_state"), "peer_id", "left").withColumn("allowed", F.coalesce(F.col("trust_state") == "allow", F.lit(False))).drop("trust_state")


def handshakes(requests: DataFrame, peers: DataFrame, *, schema_hash: str, manifest_hash: str, protocol: str, oldest: str) -> DataFrame:
    """The first reason to refuse each request, or none, and whether it fences the peer."""
    rows = allowed_peers(requests, peers)
    reason = (
        F.when(~F.col("allowed"), NOT_ALLOWED)
        .when(F.col("schema_hash") != schema_hash, OTHER_SCHEMA)
        .when(F.col("manifest_hash") != manifest_hash, OTHER_MANIFEST)
        .when((F.col("min_protocol") > protocol) | (F.lit(oldest) > F.col("protocol")), OTHER_PROTOCOL)
        .when(F.size("namespaces") == 0, NO_NAMESPACE)
        .otherwise("")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("request_id", "peer_id", "reason", F.col("reason").isin(OTHER_SCHEMA, OTHER_MANIFEST).alias("schema_fenced"))


def quarantined(batches: DataFrame) -> DataFrame:
    """Refused batches (batch_id, peer_id, namespace, reason, created_at_ms, payload): the payload as JSON, and whether the reason fences."""
    return batches.select("batch_id", "peer_id", "namespace", "reason", F.to_json("payload").alias("payload_json"), F.contains("reason", F.lit("schema")).alias("schema_fenced"), "created_at_ms")


def expired(quarantine: DataFrame, now_ms: int, ttl_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """What is left of the quarantine after its time to live."""
    return quarantine.filter(F.col("created_at_ms") >= now_ms - ttl_ms)


def status(states: DataFrame) -> DataFrame:
    """One row: schema_fenced if any peer is, degraded if any has an error, else healthy."""
    fenced, failed = F.bool_or("schema_fenced"), F.bool_or(F.col("last_error") != "")
    return states.agg(F.when(F.coalesce(fenced, F.lit(False)), "schema_fenced").when(F.coalesce(failed, F.lit(False)), "degraded").otherwise("healthy").alias("state"), F.count(F.lit(1)).alias("peers"))


def enqueued(log: DataFrame, limit: int = ENQUEUED) -> DataFrame:
    """The memories that a batch changed last, as index requests."""
    return log.groupBy("pk").agg(F.max("db_version").alias("last")).orderBy(F.col("last").desc(), "pk").limit(limit)


def reassembled_claims(changes: DataFrame, columns: list[str]) -> DataFrame:
    """For each memory the last value of each column in order of arrival."""
    last = changes.groupBy("pk", "cid").agg(F.max_by("val", "db_version").alias("val"))
    return last.groupBy("pk").agg(*[F.coalesce(F.max(F.when(F.col("cid") == c, F.col("val"))), F.lit("")).alias(c) for c in columns])


def value_kind(value: Column) -> Column:
    """The tag of a typed value: null, text or blob, as bytes that are no UTF-8 are blobs."""
    as_text = F.call_function("try_validate_utf8", value.cast("string"))
    return F.when(value.isNull(), "null").when(as_text.isNotNull(), "text").otherwise("blob")


def synced_policies(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Policies after the configuration is applied: its peers are allowed, known trust weights stay."""
    rows = stored.select("peer_id", "trust_weight", "trust_state").join(configured.select("peer_id", F.lit(True).alias("listed")), "peer_id", "full")
    return rows.select("peer_id", F.coalesce("trust_weight", F.lit(1.0)).alias("trust_weight"), F.when(F.coalesce("listed", F.lit(False)), "allow").otherwise(F.col("trust_state")).alias("trust_state"))


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def primary_key_text(packed: Column) -> Column:
    """The text in a packed primary key: from its first letter or digit on. A length byte that is a letter itself would spoil
    the id, so changes carry their key as text; this reads keys of other stores."""
    return F.regexp_extract(F.decode(packed, "ISO-8859-1"), "[0-9A-Za-z].*", 0)


def latest_keys(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """Claims with the latest verification key (peer_id, key_id, updated_at_ms) of their origin, or an empty one."""
    newest = latest_by(keys, ["peer_id"], [F.col("updated_at_ms").desc(), F.col("key_id").desc()])
    rows = claims.join(newest.select(F.col("peer_id").alias("origin_peer_id"), "key_id"), "origin_peer_id", "left")
    return rows.withColumn("key_id", F.coalesce("key_id", F.lit("")))


def claims_over_stored(changes: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """For each changed memory the last value of each column in order of arrival, or else the stored one, or else an empty text."""
    last = changes.groupBy("pk", "cid").agg(F.max_by("val", "db_version").alias("val"))
    said = last.groupBy("pk").agg(*[F.max(F.when(F.col("cid") == c, F.col("val"))).alias(f"new_{c}") for c in columns])
    rows = said.join(nodes.select(F.col("memory_id").alias("pk"), *columns), "pk", "left")
    return rows.select("pk", *[F.coalesce(f"new_{c}", c, F.lit("")).alias(c) for c in columns])


def cycle(held: DataFrame, links: DataFrame) -> DataFrame:
    """The cells of each replica after one cycle. ``held`` has the changes by ``replica``; ``links`` (replica, peer, namespaces)
    says who takes what from whom, after the handshakes. All replicas are served by one join and one merge."""
    few = F.broadcast(links)  # a row for each pair of peers
    taken = held.withColumnRenamed("replica", "peer").join(few, "peer").filter(F.array_contains("namespaces", F.col("namespace")))
    every = held.unionByName(taken.select(*held.columns))
    # The merge takes the replica as a part of the table's name.
    named = every.withColumn("tbl", F.struct("replica", "tbl"))
    return merged_changes(named).select("tbl.replica", "tbl.tbl", "pk", "cid", "val", "col_version", "site_id")


def applied(stored: DataFrame, incoming: DataFrame, batches: DataFrame, claims: DataFrame, peers: DataFrame, verification: DataFrame, *, schema_hash: str, now_ms: int) -> dict[str, DataFrame]:
    """The tables after batches of changes were received.

    ``incoming`` are changes by batch_id, ``batches`` (batch_id, peer_id, schema_hash) what they say of themselves, ``claims``
    (batch_id, memory_id, signature_status) the verdicts on their signatures. A batch of a peer that is not allowed, of another schema, or with
    a wrong or unknown signature goes to the quarantine as a whole; missing signatures are accepted and noted. Of the others, changes are
    merged (a replay changes nothing), verdicts upserted, cursors moved, and the memories that changed last enqueued.
    """
    bad = claims.filter(F.col("signature_status").isin("invalid_signature", "unknown_peer")).groupBy("batch_id").agg(F.min("signature_status").alias("bad"))
    judged = allowed_peers(batches, peers).join(bad, "batch_id", "left")
    reason = F.when(~F.col("allowed"), NOT_ALLOWED).when(F.col("schema_hash") != schema_hash, OTHER_SCHEMA).otherwise(F.coalesce("bad", F.lit("")))
    judged = judged.select("batch_id", "peer_id", reason.alias("reason"))
    good = incoming.join(judged.filter("reason = ''").drop("reason"), "batch_id")
    changes = merged_changes(stored.select(*CELL_COLUMNS).unionByName(good.select(*CELL_COLUMNS)))
    refused = judged.filter("reason <> ''").join(incoming.groupBy("batch_id").agg(F.min("namespace").alias("namespace"), F.count(F.lit(1)).alias("n")), "batch_id")
    refused = refused.select("batch_id", "peer_id", "namespace", "reason", F.lit(now_ms).cast("long").alias("created_at_ms"), F.struct("batch_id", F.col("n").alias("changes")).alias("payload"))
    moved = good.groupBy("peer_id", "namespace").agg(F.max("db_version").alias("applied_version"), F.max("changed_at_ms").alias("updated_at_ms"))
    arrived = good.select("batch_id", F.col("pk").alias("memory_id"), "db_version").join(claims, ["batch_id", "memory_id"])
    verdicts = arrived.groupBy("memory_id").agg(F.max_by("signature_status", F.struct("db_version", "signature_status")).alias("new_status"))
    known = verification.join(verdicts, "memory_id", "full").select("memory_id", F.coalesce("new_status", "signature_status").alias("signature_status"))
    return {"changes": changes, "quarantine": quarantined(refused), "cursors": moved, "verification": known, "queue": enqueued(good)}


#: Columns of a node that are replicated as cells.
NODE_COLUMNS = ("memory_type", "namespace", "subject", "body", "source_uri", "origin_peer_id")


def touched_rows(stored: DataFrame, incoming: DataFrame, columns: tuple[str, ...], table: str = "memory_nodes") -> tuple[DataFrame, DataFrame]:
    """The rows of a replicated table that a batch touches, merged anew from all their stored and incoming cells: what lives, with a column for each
    cell, and the keys (pk) of what was deleted. What the batch does not touch is not read beyond its key."""
    touched = incoming.filter(F.col("tbl") == table).select("pk").distinct()
    own = stored.filter(F.col("tbl") == table).join(touched, "pk", "left_semi").select(*CELL_COLUMNS).unionByName(incoming.filter(F.col("tbl") == table).select(*CELL_COLUMNS))
    live = live_rows(own).select("pk")
    cells = merged_cells(own).join(live, "pk", "left_semi")
    rows = cells.groupBy("pk").agg(*[F.max(F.when(F.col("cid") == c, F.col("val"))).alias(c) for c in columns])
    # A row that lives without a cell of these columns is a row too.
    return live.join(rows, "pk", "left"), touched.join(live, "pk", "left_anti")


def replicated_nodes(stored: DataFrame, incoming: DataFrame, nodes: DataFrame, *, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(nodes that the batch makes or changes, keys of those that it deletes): cells win over what the node had, and what neither says is empty."""
    rows, gone = touched_rows(stored, incoming, NODE_COLUMNS)
    old = nodes.select(F.col("memory_id").alias("pk"), *[F.col(c).alias(f"old_{c}") for c in NODE_COLUMNS], "authored_at_ms", "has_signature", F.col("memory_space").alias("lane"))
    rows = rows.join(old, "pk", "left")
    made = rows.select(
        F.col("pk").alias("memory_id"), F.coalesce("lane", F.lit("shared")).alias("memory_space"), *[F.coalesce(c, f"old_{c}", F.lit("")).alias(c) for c in NODE_COLUMNS],
        F.coalesce("authored_at_ms", F.lit(now_ms)).cast("long").alias("authored_at_ms"), F.coalesce("has_signature", F.lit(True)).alias("has_signature"), F.lit("active").alias("lifecycle_state"),
    )
    return made, gone.select(F.col("pk").alias("memory_id"))


def units_of(nodes: DataFrame) -> DataFrame:
    """The retrieval units of nodes."""
    return nodes.select(
        F.col("memory_id").alias("unit_id"), F.concat("memory_space", F.lit("_memory")).alias("source_type"), F.col("memory_id").alias("source_id"), "memory_space", "namespace", F.col("memory_type").alias("unit_kind"),
        F.col("subject").alias("title"), "body", F.lit("private").alias("sensitivity"), F.lit("active").alias("state"), "source_uri", F.lit("").alias("project_key"), F.lit("").alias("branch_name"), "authored_at_ms",
    )


def converge(held: DataFrame, links: DataFrame, *, versions: int = EXTRACT_VERSIONS, written, most_rounds: int = 1000) -> tuple[DataFrame, int]:
    """All replicas after cycles until none has anything for another, and the number of cycles.

    ``held`` has changes by ``replica`` and ``version``, the place in that replica's own log, from 1 on. ``links`` (replica, peer, namespaces, reason)
    says who takes what from whom; links that the handshake refused, with a reason, carry nothing. In a cycle each link takes the next
    ``versions`` versions behind its cursor, which then stands there; what a replica does not have yet is put at the end of its own log, from
    which others take it later. ``written`` writes a table and reads it again, so a cycle's plan begins at the one before.
    """
    identity = ["tbl", "pk", "cid", "val", "kind", "col_version", "site_id", "cl", "db_version", "namespace"]
    open_ = written(links.filter("reason = ''").select("replica", "peer", "namespaces"))  # a row for each pair of peers
    cursors = open_.select("replica", "peer", F.lit(0).cast("long").alias("applied"))
    held = written(held.select("replica", "version", *identity))
    for rounds in range(most_rounds):
        ends = held.groupBy(F.col("replica").alias("peer")).agg(F.max("version").alias("end"))
        waiting = written(open_.join(cursors, ["replica", "peer"]).join(ends, "peer").filter("end > applied").withColumn("to", F.least("end", F.col("applied") + versions)))
        if not waiting.head(1):
            return held, rounds
        taken = held.withColumnRenamed("replica", "peer").join(F.broadcast(waiting), "peer").filter("version > applied and version <= to").filter(F.array_contains("namespaces", F.col("namespace")))
        fresh = taken.groupBy("replica", *identity).agg(F.min(F.struct("peer", "version")).alias("first")).join(held.select("replica", *identity), ["replica", *identity], "left_anti")
        # A replica takes ``versions`` versions of each peer at most in a cycle.
        place = F.row_number().over(Window.partitionBy("replica").orderBy("first", *identity))
        last = held.groupBy("replica").agg(F.max("version").alias("last"))
        added = fresh.withColumn("place", place).join(last, "replica", "left").select("replica", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long").alias("version"), *identity)
        held = written(held.unionByName(added))
        cursors = written(cursors.join(waiting.select("replica", "peer", "to"), ["replica", "peer"], "left").select("replica", "peer", F.coalesce("to", "applied").alias("applied")))
    raise RuntimeError(f"replicas still differ after {most_rounds} cycles")
