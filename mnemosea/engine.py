"""The engine's public face: one method for each request of the memory service.

State is a set of tables (DataFrames) and a stored index. A write returns a new engine whose changed
tables are written to the shared folder and whose index has a new segment with the changed units; segments merge and each table
is one scan, so the plan of a later request does not grow with the number of writes. A changed table is written as a whole. Nothing is collected except where a
method returns an envelope or has to refuse a request.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosea.functions import text, vectors
from mnemosea.operators import context, graph, ingest, lifecycle, maintain, recall, search, sync
from mnemosea.sources.shared import shared_folder
from mnemosea.streaming import workers

# Error codes and their HTTP status.
STATUS = {"INVALID_ARGUMENT": 400, "NOT_FOUND": 404, "PRIVATE_ONLY": 400, "CANDIDATE_NOT_PENDING": 409, "METHOD_NOT_ALLOWED": 405, "INTERNAL_ERROR": 500}


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.status = code, STATUS[code]


@dataclass(frozen=True)
class Config:
    """Settings with their defaults; ``from_mapping`` refuses unknown names and bad values."""

    peer_id: str = "peer/local"
    ranking_profile: str = "default"
    tokenizer: str = "unicode61"
    embedding_dimension: int = 8
    namespaces: tuple[str, ...] = ()
    sync_interval_ms: int = 3000
    sync_batch: int = 256
    index_tick_ms: int = 500
    index_batch: int = 128
    quarantine_ttl_ms: int = 7 * 24 * 3_600_000

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        """Settings from a YAML mapping of scalars and lists."""
        return cls.from_mapping(read_yaml(text))

    @classmethod
    def from_mapping(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise EngineError("INVALID_ARGUMENT", f"unknown settings: {', '.join(unknown)}")
        made = cls(**{k: tuple(v) if k == "namespaces" else v for k, v in values.items()})
        if not made.peer_id.strip() or made.tokenizer not in ("unicode61", "trigram") or not 1 <= made.embedding_dimension <= 4096 or min(made.sync_interval_ms, made.sync_batch, made.index_tick_ms, made.index_batch) <= 0:
            raise EngineError("INVALID_ARGUMENT", "a setting is out of range")
        return made


def read_yaml(text: str) -> dict:
    """The part of YAML that settings need: one mapping of scalars, and of lists in either style."""
    out: dict = {}
    key = ""
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        if line.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] or []), _scalar(line.strip()[2:])]
        elif line[0] not in " \t" and ":" in line:
            key, value = (x.strip() for x in line.split(":", 1))
            listed = value.startswith("[") and value.endswith("]")
            out[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if listed else _scalar(value) if value else None
        else:
            raise EngineError("INVALID_ARGUMENT", f"line {number} is no setting")
    return {k: v for k, v in out.items() if v is not None}


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    return int(text) if text.lstrip("-").isdigit() else {"true": True, "false": False, "null": None, "~": None}.get(text.lower(), text)


def decode_strictly(body: str, allowed: set[str]) -> dict:
    """A request's JSON object; unknown fields are refused."""
    try:
        value = json.loads(body)
    except ValueError as e:
        raise EngineError("INVALID_ARGUMENT", f"invalid JSON: {e}") from e
    if not isinstance(value, dict) or set(value) - allowed:
        raise EngineError("INVALID_ARGUMENT", "unknown fields in the request")
    return value


def envelope(data=None, *, error: EngineError | None = None, warnings: list[str] | None = None, request_id: str = "") -> dict:
    failed = {"code": error.code, "message": str(error)} if error else None
    return {"ok": error is None, "data": data, "error": failed, "warnings": sorted(set(w.strip() for w in warnings or [] if w.strip())), "request_id": request_id}


def schema_hash(tables: dict[str, DataFrame]) -> str:
    """A digest of all tables' columns and types, in order of names. Whether a column happens to hold nulls is no part of it."""
    return hashlib.sha256("".join(f"{n}({tables[n].schema.simpleString()})" for n in sorted(tables)).encode()).hexdigest()


def load_eval_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries and expected ids of a labelled retrieval set in JSON."""
    raw = spark.read.option("multiLine", True).json(path)
    queries = raw.select(F.posexplode("queries").alias("query_id", "q")).select(F.col("query_id").cast("long").alias("query_id"), F.col("q.query").alias("query"), F.col("q.expected_ids").alias("ids"))
    return raw.select(F.explode("documents").alias("d")).select("d.*"), queries.select("query_id", "query"), queries.select("query_id", F.explode("ids").alias("unit_id"))


@dataclass(frozen=True)
class Engine:
    """``tables`` has nodes, units, verification, peers, edges, signals, artifacts, spans, messages, chunks, candidates,
    promotions, publications, changes, cursors, quarantine, queue and suspensions; see mnemosea.sources.bridge for their columns."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    config: Config = field(default_factory=Config)
    index: search.Index | None = None
    #: Embeds queries: a service, or a dataflow from (query_id, query) to (query_id, qv); where it fails, recall goes by text and says so.
    embed_queries: vectors.Provider | Callable[[DataFrame], DataFrame] | None = None

    def __getattr__(self, name: str) -> DataFrame:
        tables = object.__getattribute__(self, "tables")
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    @classmethod
    def over(cls, views, config: Config | None = None) -> Engine:
        """An engine over the bridge's views."""
        names = ("nodes", "units", "verification", "peers", "edges", "signals", "artifacts", "spans", "messages", "chunks", "changes", "queue")
        tables = {n: getattr(views, n) for n in names}
        tables["candidates"] = ingest.candidates(tables["chunks"])
        empty = {
            "promotions": "memory_id string, chunk_id string, memory_type string", "publications": "memory_id string, private_memory_id string, policy string",
            "quarantine": "batch_id string, peer_id string, namespace string, reason string, payload_json string, schema_fenced boolean, created_at_ms long",
            "cursors": "peer_id string, namespace string, applied_version long, updated_at_ms long",
            "suspensions": "entity_type string, entity_id string, detail string, first_seen_at_ms long, last_seen_at_ms long, resolved_at_ms long",
        }
        tables |= {n: views.spark.createDataFrame([], schema) for n, schema in empty.items()}
        engine = cls(views.spark, tables, config or Config())
        own = engine.config.tokenizer != search.Index.tokenizer or engine.config.embedding_dimension != search.Index.dim
        return engine.rebuild_index() if own else replace(engine, index=views.index)

    @property
    def chunk_versions(self) -> DataFrame:
        """Chunks with the version of their strategy, which their id has."""
        return self.tables["chunks"].select("session_id", "chunk_id", "chunk_seq", F.regexp_extract("chunk_id", ":v([0-9]+):[0-9]+$", 1).cast("int").alias("chunk_strategy_version"))

    def _with(self, **changed: DataFrame) -> Engine:
        """The engine with some tables replaced, which are written, so later plans begin at them."""
        written = {}
        for name, rows in changed.items():
            path = f"{shared_folder(self.spark)}/engine-{name}-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            written[name] = self.spark.read.schema(rows.schema).parquet(path)
        return replace(self, tables=self.tables | written)

    def stored(self) -> Engine:
        """The engine with all of its tables written, as a service keeps them: requests read them and derive nothing again."""
        return self._with(**self.tables)

    def _added(self, **new: DataFrame) -> Engine:
        """The engine with rows added to some tables; columns that the new rows lack are null."""
        old = self.tables
        return self._with(**{n: old[n].unionByName(rows, allowMissingColumns=True).select(*old[n].columns) for n, rows in new.items()})

    def _indexed(self, changed: DataFrame, gone: DataFrame | None = None) -> Engine:
        """The engine with the changed units in its index, and without those that are gone (unit_id)."""
        if self.index is None:
            return self
        return replace(self, index=search.update(self.index, changed, self.tables["units"], gone=gone))

    def rebuild_index(self) -> Engine:
        return replace(self, index=search.rebuild(self.tables["units"], dim=self.config.embedding_dimension, tokenizer=self.config.tokenizer))

    def probe(self) -> dict:
        """What the engine's catalogue holds."""
        dim = self.index.vectors.select(F.size("embedding").alias("n")).head(1) if self.index else []
        return {"tables": sorted(self.tables), "text_index": self.index is not None, "vectors": bool(dim), "dimension": dim[0]["n"] if dim else 0, "tokenizer": self.config.tokenizer}

    # Reads.

    def recall(self, queries: DataFrame, *, as_of_ms: int, limit: int = 10, private: bool = False, shared: bool = False, transcript: bool = False, **filters) -> DataFrame:
        return recall.recall(self, queries, limit=limit if limit > 0 else 10, profile=self.config.ranking_profile, as_of_ms=as_of_ms, spaces=recall.allowed_spaces(private, shared, transcript), **filters)

    def recall_with_warnings(self, queries: DataFrame, **how) -> tuple[DataFrame, list[str]]:
        """recall(), with a warning if the provider of query vectors fails: for the queries that it fails for, recall goes by text only."""
        failed = ["embedding provider unavailable; semantic ranking skipped"]
        dim = self.config.embedding_dimension
        if self.embed_queries is None:
            return self.recall(queries, **how), []
        if isinstance(self.embed_queries, vectors.Provider):
            # Written, so that the service is asked once.
            path = f"{shared_folder(self.spark)}/asked-{uuid.uuid4().hex}"
            made = self.embed_queries.vectors(queries, dim)
            made.write.parquet(path)
            made = self.spark.read.schema(made.schema).parquet(path)
            return self.recall(queries, asked=made.filter("error is null").drop("error"), **how), failed if made.filter("error is not null").head(1) else []
        try:
            return self.recall(queries, asked=vectors.checked(self.embed_queries, queries, dim), **how), []
        except vectors.ProviderError:
            return self.recall(queries, semantic=False, **how), failed

    def context(self, queries: DataFrame, *, as_of_ms: int, limit: int = 5) -> tuple[DataFrame, DataFrame]:
        """Sections and artifacts."""
        found = context.sections(self, queries, limit=limit if limit > 0 else 5, as_of_ms=as_of_ms, profile=self.config.ranking_profile)
        return found, context.artifacts(found, self.tables["spans"], self.tables["artifacts"], limit=limit)

    def explain(self, query: str) -> DataFrame:
        if not query.strip():
            raise EngineError("INVALID_ARGUMENT", "query is required")
        one = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        t = self.tables
        return context.explained_with_signals(t["nodes"], t["verification"], t["peers"], t["signals"], search.bm25(self.index, one))

    def trace(self, memory_id: str, *, depth: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Hops, artifacts and transcript sources of a decision."""
        t = self.tables
        roots = t["nodes"].filter(F.col("memory_id") == memory_id).select(F.col("memory_id").alias("root_id"))
        if not roots.head(1):
            raise EngineError("NOT_FOUND", f"memory {memory_id} not found")
        live = graph.active_edges(t["edges"], graph.suspensions(t["edges"], t["signals"], t["nodes"]))
        if depth > 2:
            folder = f"{shared_folder(self.spark)}/trace-{uuid.uuid4().hex}"
            hops = graph.EdgeStore.write(live, t["nodes"], f"{folder}/edges").walk(roots, depth, folder)
        else:
            hops = graph.trace(live, t["nodes"], roots, depth)
        seen = roots.toDF("memory_id").unionByName(hops.select(F.col("to_memory_id").alias("memory_id"))).distinct()
        sources = graph.transcript_sources(t["promotions"].join(seen, "memory_id", "left_semi"), t["chunks"], ingest.artifact_spans(t["chunks"]))
        found = graph.traced_artifacts(seen, t["spans"], t["artifacts"])
        return hops.orderBy("hop", "edge_id"), found.orderBy("namespace", "span_id"), sources.orderBy(F.col("authored_at_ms").desc(), "chunk_id")

    def list_candidates(self, **filters) -> DataFrame:
        return lifecycle.list_candidates(self.tables["candidates"], **filters)

    # Writes: each gives the engine after it.

    def store(self, requests: DataFrame, relations: DataFrame | None = None, artifacts: DataFrame | None = None) -> Engine:
        """Memories with their signals, verification, units and index requests. ``relations`` (edge_id, from_memory_id, to_memory_id,
        relation_type, weight, authored_at_ms) must have known types and targets in the lane of their source; ``artifacts`` (memory_id, uri, title,
        namespace, start_offset, end_offset, quote_hash, authored_at_ms) become references and spans."""
        made = lifecycle.stored(requests)
        t = self.tables
        ids = made["nodes"].select("memory_id")
        new = {
            "nodes": t["nodes"].join(ids, "memory_id", "left_anti").unionByName(made["nodes"], allowMissingColumns=True).select(*t["nodes"].columns),
            "units": t["units"].join(made["units"].select("unit_id"), "unit_id", "left_anti").unionByName(made["units"], allowMissingColumns=True).select(*t["units"].columns),
            "verification": lifecycle.insert_ignore(t["verification"], made["verification"], ["memory_id"]),
            "signals": t["signals"].unionByName(made["signals"].withColumn("signal_id", F.concat(F.lit("store-"), "memory_id")), allowMissingColumns=True).select(*t["signals"].columns),
            "queue": t["queue"].unionByName(made["queue"].withColumn("enqueued_at_ms", F.lit(0).cast("long")), allowMissingColumns=True).select(*t["queue"].columns),
        }
        after = self._with(**new)
        if relations is not None:
            judged = relations.drop("weight").join(lifecycle.valid_relations(relations), "edge_id")
            if bad := judged.filter("reason <> ''").head(1):
                raise EngineError("INVALID_ARGUMENT", bad[0]["reason"])
            there = lifecycle.relation_targets(judged, after.tables["nodes"])
            if judged.join(there.select("edge_id"), "edge_id", "left_anti").head(1):
                raise EngineError("NOT_FOUND", "a relation's target is not in the lane of its source")
            after = after._added(edges=judged.drop("reason"))
        if artifacts is not None:
            refs, spans = lifecycle.artifact_rows(artifacts)
            after = after._with(artifacts=lifecycle.insert_ignore(after.tables["artifacts"], refs.select(*after.tables["artifacts"].columns), ["artifact_id"]))._added(spans=spans)
        return after._indexed(after.tables["units"].join(made["units"].select("unit_id"), "unit_id", "left_semi"))

    def supersede(self, pairs: DataFrame) -> Engine:
        after, edges = lifecycle.supersede(self.tables["nodes"], pairs)
        private = self.tables["nodes"].filter("memory_space <> 'shared'")
        return self._with(nodes=after.unionByName(private))._added(edges=edges.withColumn("edge_id", F.concat_ws("-", F.lit("supersedes"), "from_memory_id", "to_memory_id")))

    def signal(self, requests: DataFrame) -> Engine:
        return self._added(signals=lifecycle.signal_rows(requests))

    def promote(self, links: DataFrame, memory_type: str = "") -> Engine:
        """``links`` (memory_id, ordinal, chunk_id): private memories from chunks, with what their chunks quote and inferred edges.
        Without a type a memory takes the kind of its first chunk if that is a memory's type, or else is a note."""
        t = self.tables
        spans = ingest.artifact_spans(t["chunks"])
        made = lifecycle.promoted(links, t["chunks"], spans)
        kinds = lifecycle.promoted_types(links, t["chunks"], memory_type)
        made = made.drop("memory_type").join(kinds, "memory_id")
        said = links.select("memory_id", "chunk_id").join(kinds, "memory_id").select("memory_id", "chunk_id", "memory_type")
        promotions = t["promotions"].unionByName(said)
        edges = graph.promotion_edges(promotions, t["chunks"], t["edges"])
        after = self.store(made.withColumns({"scope": F.lit(""), "author_agent_id": F.lit(""), "origin_peer_id": F.lit(self.config.peer_id), "lifecycle_state": F.lit("active")}))
        quoted = lifecycle.promoted_spans(links, spans)
        return after._with(promotions=promotions)._added(edges=edges.withColumn("edge_id", F.concat_ws("-", F.lit("inferred"), "from_memory_id", "to_memory_id")), spans=quoted)

    def publish(self, memory_ids: list[str], policy: str = "default") -> Engine:
        """Shared, redacted copies of private memories, with links to them."""
        private = self.tables["nodes"].filter(F.col("memory_id").isin(*memory_ids))
        if private.filter("memory_space <> 'private'").head(1):
            raise EngineError("PRIVATE_ONLY", "only private memories are published")
        made = lifecycle.published(private, policy)
        links = made.select("memory_id", "private_memory_id", F.lit(policy).alias("policy"))
        made = made.withColumns({"scope": F.lit(""), "author_agent_id": F.lit(""), "origin_peer_id": F.lit(self.config.peer_id), "lifecycle_state": F.lit("active")})
        return self.store(made)._added(publications=links)

    def review(self, decisions: DataFrame) -> Engine:
        """Candidates after ``decisions``; a decided candidate in them is an error. Approved ones are promoted, as memories of their type."""
        old = self.tables["candidates"]
        done = lifecycle.review(old, decisions)
        if done.filter("refused").head(1):
            raise EngineError("CANDIDATE_NOT_PENDING", "a candidate is not pending")
        rest = [c for c in old.columns if c not in ("subject", "status")]
        after = self._with(candidates=old.select(*rest).join(done.drop("refused"), "candidate_id").select(*old.columns))
        approved = after.tables["candidates"].filter("status = 'approved'").join(decisions.select("candidate_id"), "candidate_id", "left_semi")
        if not approved.head(1):
            return after
        links = approved.select(F.concat(F.lit("mem_"), "candidate_id").alias("memory_id"), F.lit(0).alias("ordinal"), "chunk_id")
        named = approved.select(F.concat(F.lit("mem_"), "candidate_id").alias("memory_id"), F.col("subject").alias("given"))
        after = after.promote(links)
        with_subject = lambda rows, key, column: rows.join(named.withColumnRenamed("memory_id", key), key, "left").withColumn(column, F.coalesce("given", column)).drop("given").select(*rows.columns)
        return after._with(nodes=with_subject(after.tables["nodes"], "memory_id", "subject"), units=with_subject(after.tables["units"], "unit_id", "title"))

    def ingest(self, messages: DataFrame) -> Engine:
        """Messages of sessions, and the chunks, units and candidates of all that is stored of these sessions. A sequence number that comes
        again with another content is refused; chunks that exist already stay as they are."""
        t = self.tables
        if bad := ingest.validated(messages).filter("reason <> ''").head(1):
            raise EngineError("INVALID_ARGUMENT", bad[0]["reason"])
        if clash := ingest.message_conflicts(t["messages"], messages).head(1):
            raise EngineError("INVALID_ARGUMENT", f"seq {clash[0]['seq']} reused with different content")
        stored = lifecycle.insert_ignore(t["messages"], messages.select(*t["messages"].columns), ["session_id", "seq"])
        after = self._with(messages=stored)
        known = after.tables["messages"].join(messages.select("session_id").distinct(), "session_id", "left_semi")
        new = ingest.chunks(known).join(t["chunks"].select("chunk_id"), "chunk_id", "left_anti")
        units = ingest.units(new)
        waiting = units.select("unit_id", "memory_space", F.col("authored_at_ms").alias("enqueued_at_ms"), F.lit(0).cast("long").alias("processed_at_ms"))
        after = after._added(chunks=new, units=units, candidates=ingest.candidates(new), queue=waiting)
        return after._indexed(after.tables["units"].join(units.select("unit_id"), "unit_id", "left_semi"))

    # Replication and upkeep.

    def extract(self, namespace: str, cursor: int) -> DataFrame:
        return sync.extract(self.tables["changes"], namespace, cursor, self.config.sync_batch)

    def apply(self, batch: DataFrame, *, peer_id: str | None = None, batch_schema: str = "", claims: DataFrame | None = None, now_ms: int = 0) -> Engine:
        """Changes merged with the batch's; the merge does not mind order or repetition. With ``peer_id`` the batch is judged first:
        a peer that is not allowed, another schema or a bad signature in ``claims`` (memory_id, signature_status) sends it to the quarantine."""
        t = self.tables
        if peer_id is None:
            return self._applied(batch, now_ms)
        one = self.spark.createDataFrame([(f"{peer_id}-{now_ms}", peer_id, batch_schema)], "batch_id string, peer_id string, schema_hash string")
        said = claims if claims is not None else self.spark.createDataFrame([], "memory_id string, signature_status string")
        name = F.lit(f"{peer_id}-{now_ms}")
        made = sync.applied(t["changes"], batch.withColumn("batch_id", name), one, said.withColumn("batch_id", name), t["peers"], t["verification"], schema_hash=schema_hash(self._shared()), now_ms=now_ms)
        refused = made["quarantine"]
        if refused.head(1):
            return self._added(quarantine=refused)
        waiting = made["queue"].select(F.col("pk").alias("unit_id"), F.lit("shared").alias("memory_space"), F.lit(now_ms).cast("long").alias("enqueued_at_ms"), F.lit(0).cast("long").alias("processed_at_ms"))
        moved = t["cursors"].unionByName(made["cursors"].select(*t["cursors"].columns)).groupBy("peer_id", "namespace").agg(F.max("applied_version").alias("applied_version"), F.max("updated_at_ms").alias("updated_at_ms"))
        return self._applied(batch, now_ms, verification=made["verification"], cursors=moved)._added(queue=waiting)

    def _applied(self, batch: DataFrame, now_ms: int, **also: DataFrame) -> Engine:
        """The engine after a batch that nothing speaks against: the changes that it did not have yet are kept, the rows that they touch are merged
        anew and become nodes and units, which the index has from then on."""
        t = self.tables
        identity = ["tbl", "pk", "cid", "col_version", "site_id", "cl", "db_version"]
        fresh = batch.select(*t["changes"].columns).distinct().join(t["changes"].select(*identity), identity, "left_anti").select(*t["changes"].columns)
        made, gone = sync.replicated_nodes(t["changes"], batch, t["nodes"], now_ms=now_ms)
        touched = made.select("memory_id").unionByName(gone)
        units = sync.units_of(made)
        new = {
            "changes": t["changes"].unionByName(fresh),
            "nodes": t["nodes"].join(touched, "memory_id", "left_anti").unionByName(made, allowMissingColumns=True).select(*t["nodes"].columns),
            "units": t["units"].join(touched.withColumnRenamed("memory_id", "unit_id"), "unit_id", "left_anti").unionByName(units, allowMissingColumns=True).select(*t["units"].columns),
        }
        after = self._with(**new, **also)
        return after._indexed(after.tables["units"].join(units.select("unit_id"), "unit_id", "left_semi"), gone.withColumnRenamed("memory_id", "unit_id"))

    def _shared(self) -> dict[str, DataFrame]:
        """The tables that are replicated."""
        return {n: self.tables[n] for n in ("nodes", "edges", "signals", "artifacts", "spans")}

    def index_tick(self, now_ms: int, failing: DataFrame | None = None) -> Engine:
        """One tick of the index worker: the oldest open requests are completed and their units indexed."""
        taken = maintain.next_items(self.tables["queue"], self.config.index_batch).select("unit_id").distinct()
        if failing is not None:
            taken = taken.join(failing.select("unit_id"), "unit_id", "left_anti")
        none = self.spark.createDataFrame([], "unit_id string, embedding array<double>")
        queue, _ = workers.index_tick(self.tables["queue"], none, self.tables["units"], now_ms=now_ms, limit=self.config.index_batch, failing=failing)
        gone = taken.join(self.tables["units"].select("unit_id"), "unit_id", "left_anti")
        changed = self.tables["units"].join(taken, "unit_id", "left_semi")
        after = self._with(queue=queue)
        return replace(after, index=search.update(self.index, changed, self.tables["units"], gone=gone)) if self.index else after

    def scrub(self, now_ms: int) -> Engine:
        """One run of the scrubber: orphans suspended or resolved, and what is too old in the quarantine dropped."""
        t = self.tables
        found = graph.suspensions(t["edges"], t["signals"], t["nodes"])
        return self._with(suspensions=graph.merge_suspensions(t["suspensions"], found, now_ms).select(*t["suspensions"].columns), quarantine=sync.expired(t["quarantine"], now_ms, self.config.quarantine_ttl_ms))

    def diagnose(self) -> DataFrame:
        t = self.tables
        signatures = maintain.signature_status(t["nodes"], t["peers"], t["verification"]).select(F.col("status").alias("item"))
        orphans = graph.suspensions(t["edges"], t["signals"], t["nodes"]).select(F.col("entity_type").alias("item"))
        return signatures.unionByName(orphans).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def register_functions(spark: SparkSession) -> None:
    """The engine's text functions for SQL, as SQL functions where an expression will do."""
    @F.pandas_udf("int")
    def hash_bucket(tokens: pd.Series, dim: pd.Series) -> pd.Series:
        return pd.Series(vectors.fnv_hashes(pa.array(tokens)) % dim.to_numpy().astype("uint64")).astype("int32")

    spark.udf.register("hash_bucket", hash_bucket)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_secret(t STRING) RETURNS BOOLEAN RETURN t RLIKE '{text.SECRET}'")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION newton_sqrt(v DOUBLE) RETURNS DOUBLE RETURN aggregate(sequence(1, 12), v, (x, i) -> 0.5D * (x + v / x))")
