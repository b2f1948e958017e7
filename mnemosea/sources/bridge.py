"""The data model's tables, derived from the driver's parquet tables.

Every view is a plain DataFrame, so filters and column choices on it reach the parquet scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosea.operators import graph, ingest, search
from mnemosea.operators.lifecycle import STORE_RELATIONS as RELATIONS
from mnemosea.operators.vector_store import VectorStore
from mnemosea.sources.shared import shared_folder

#: The moment all recency is measured from, in epoch milliseconds.
AS_OF_MS = 1_736_000_000_000
EPOCH_MS = 1_704_067_200_000
SIGNALS = {"click": "reinforce", "view": "bookmark", "purchase": "confirm", "signup": "pin", "error": "deny"}


#: The stored indexes of this process's sessions, by application, folder and tokenizer: an index is built when first asked for.
_INDEXES: dict[tuple[str, str, str], search.Index] = {}
_EMBEDDED: dict[tuple[str, str], VectorStore] = {}
_VECTORS: dict[tuple[str, str], VectorStore] = {}
_EDGES: dict[tuple[str, str], graph.EdgeStore] = {}
#: Length of the driver's vectors.
WIDTH = 64


class Tables:
    """Lazily built views over one folder of parquet tables, whose files don't change."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def index(self) -> search.Index:
        return self.index_of("unicode61")

    def index_of(self, tokenizer: str) -> search.Index:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, tokenizer)
        if key not in _INDEXES:
            _INDEXES[key] = search.rebuild(self.units, tokenizer=tokenizer, embedded=self.embeddings if tokenizer == "unicode61" else None)
        return _INDEXES[key]

    @property
    def embeddings(self) -> VectorStore:
        """The vectors of the index, which are written before its postings, so that what asks for them alone doesn't wait for those."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _EMBEDDED:
            _EMBEDDED[key] = search.embeddings(self.units)
        return _EMBEDDED[key]

    @property
    def vector_store(self) -> VectorStore:
        """The driver's vectors in cells, by vec_id."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _VECTORS:
            _VECTORS[key] = VectorStore.build(self.vectors, f"{shared_folder(self.spark)}/vectors-{uuid.uuid4().hex}", key="vec_id", dim=WIDTH)
        return _VECTORS[key]

    @property
    def edge_store(self) -> graph.EdgeStore:
        """The edges by the node that they leave."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _EDGES:
            _EDGES[key] = graph.EdgeStore.write(self.edges, self.nodes, f"{shared_folder(self.spark)}/edges-{uuid.uuid4().hex}")
        return _EDGES[key]

    @property
    def messages(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        kind = (conv * 7 + turn) % 6
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        suffix = (
            F.when(kind == 0, text(" decision: adopt https://example.com/spec/", conv))
            .when(kind == 1, " the reason is a tradeoff")
            .when(kind == 2, " TODO next step")
            .when(kind == 3, text(" error in /tmp/log/", turn, ".txt"))
            .when(kind == 4, " api_key=abc")
            .otherwise("")
        )
        return self.raw("conversations").select(
            text("s", conv).alias("session_id"),
            turn.alias("seq"),
            "role",
            F.concat(F.col("text"), suffix).alias("content"),
            (F.lit(EPOCH_MS) + conv * 60000 + turn * 1000).alias("authored_at_ms"),
            text("team/", conv % 4).alias("namespace"),
            text("proj-", conv % 3).alias("project_key"),
            F.when(conv % 2 == 0, "main").otherwise("dev").alias("branch_name"),
        )

    @property
    def chunks(self) -> DataFrame:
        return ingest.chunks(self.messages)

    @property
    def chunk_versions(self) -> DataFrame:
        """All chunks as version 2, and for every fifth session an older version 1."""
        new = self.chunks.withColumn("chunk_strategy_version", F.lit(2))
        old = new.filter(F.substring("session_id", 2, 20).cast("long") % 5 == 0)
        old = old.withColumn("chunk_strategy_version", F.lit(1)).withColumn("chunk_id", F.replace("chunk_id", F.lit(":v2:"), F.lit(":v1:")))
        return new.unionByName(old)

    @property
    def nodes(self) -> DataFrame:
        d = F.col("doc_id")
        kinds = F.array(*[F.lit(k) for k in ("decision", "fact", "rationale", "task_candidate", "note")])
        return self.raw("documents").select(
            F.concat(F.lit("m"), d.cast("string")).alias("memory_id"),
            F.when(d % 3 == 0, "private").otherwise("shared").alias("memory_space"),
            F.concat(F.lit("team/"), "lang").alias("namespace"),
            F.element_at(kinds, (d % 5 + 1).cast("int")).alias("memory_type"),
            F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("subject"),
            F.col("text").alias("body"),
            F.col("source").alias("origin_peer_id"),
            (F.lit(EPOCH_MS) + d * 1000).alias("authored_at_ms"),
            (d % 11 != 0).alias("has_signature"),
            F.when(d % 4 == 0, F.concat(F.lit("docs/"), d.cast("string"), F.lit(".md"))).otherwise("").alias("source_uri"),
            F.lit("active").alias("lifecycle_state"),
        )

    @property
    def verification(self) -> DataFrame:
        status = F.when(F.col("toxic") == 1, "invalid_signature").when(F.col("quality") == 0, "missing_signature").otherwise("valid")
        return self.raw("labels").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("memory_id"), status.alias("signature_status"))

    @property
    def peers(self) -> DataFrame:
        n = F.regexp_extract("source", "([0-9]+)$", 1).cast("long")
        found = self.raw("documents").select("source").distinct().filter("source <> 'src19'")
        return found.select(F.col("source").alias("peer_id"), (F.lit(0.5) + (n % 11) / F.lit(20.0)).alias("trust_weight"), F.when(n % 7 == 6, "block").otherwise("allow").alias("trust_state"))

    def _documents(self) -> DataFrame:
        """One row: the number of documents."""
        return self.raw("documents").agg(F.count(F.lit(1)).alias("d"))

    @property
    def edges(self) -> DataFrame:
        line = self.raw("lineitem").filter("l_quantity <= 2").join(F.broadcast(self._documents()))
        text = lambda c: c.cast("string")
        return line.select(
            F.concat_ws("-", F.concat(F.lit("e"), text(F.col("l_orderkey"))), text(F.col("l_linenumber")), text(F.col("l_partkey")), text(F.col("l_suppkey"))).alias("edge_id"),
            F.concat(F.lit("m"), text(F.col("l_orderkey") % F.col("d"))).alias("from_memory_id"),
            F.concat(F.lit("m"), text((F.col("l_partkey") * 3) % (F.col("d") + 50))).alias("to_memory_id"),
            F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("relation_type"),
            (F.col("l_discount") * 10.0).alias("weight"),
            F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("authored_at_ms"),
        )

    @property
    def signals(self) -> DataFrame:
        kinds = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
        events = self.raw("events").join(F.broadcast(self._documents()))
        return events.select(
            F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("signal_id"),
            F.concat(F.lit("m"), (F.col("event_id") % (F.col("d") + 20)).cast("string")).alias("memory_id"),
            F.element_at(kinds, F.col("event_type")).alias("signal_type"),
            "value",
            F.unix_millis(F.col("ts").cast("timestamp")).alias("authored_at_ms"),
        )

    @property
    def artifacts(self) -> DataFrame:
        return self.raw("pages").select(
            F.sha2("url", 256).alias("artifact_id"),
            F.col("url").alias("uri"),
            F.concat(F.lit("team/"), (F.col("page_id") % 4).cast("string")).alias("namespace"),
            F.element_at(F.split("url", "/"), -1).alias("title"),
        )

    @property
    def spans(self) -> DataFrame:
        pages = self.raw("pages").select("page_id", "url").join(F.broadcast(self._documents()))
        return pages.select(
            F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("span_id"),
            F.sha2("url", 256).alias("artifact_id"),
            F.concat(F.lit("m"), ((F.col("page_id") * 3) % F.col("d")).cast("string")).alias("memory_id"),
            F.lit(0).cast("long").alias("start_offset"),
            F.length("url").cast("long").alias("end_offset"),
            F.when(F.col("page_id") % 2 == 0, "").otherwise(F.sha2("url", 256)).alias("quote_hash"),
            (F.lit(EPOCH_MS) + F.col("page_id")).alias("authored_at_ms"),
        )

    @property
    def changes(self) -> DataFrame:
        user, event = F.col("user_id"), F.col("event_id")
        return self.raw("events").select(
            F.lit("memory_nodes").alias("tbl"),
            F.concat(F.lit("m"), user.cast("string")).alias("pk"),
            F.col("event_type").alias("cid"),
            F.format_string("%.4f", "value").alias("val"),
            F.lit("real").alias("kind"),
            F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("col_version"),
            event.alias("db_version"),
            (event % 3).cast("string").alias("site_id"),
            F.when((user % 10 == 0) & (event % 97 == 0), 2).otherwise(1).cast("long").alias("cl"),
            F.concat(F.lit("team/"), (user % 4).cast("string")).alias("namespace"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("changed_at_ms"),
        )

    @property
    def units(self) -> DataFrame:
        """Retrieval units of all three lanes."""
        n = self.nodes
        memory = n.select(
            F.col("memory_id").alias("unit_id"), F.concat("memory_space", F.lit("_memory")).alias("source_type"), F.col("memory_id").alias("source_id"), "memory_space", "namespace",
            F.col("memory_type").alias("unit_kind"), F.col("subject").alias("title"), "body", F.lit("private").alias("sensitivity"), F.lit("active").alias("state"), "source_uri",
            F.lit("").alias("project_key"), F.lit("").alias("branch_name"), "authored_at_ms",
        )
        return memory.unionByName(ingest.units(self.chunks))

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", "embedding", "label")

    @property
    def queries(self) -> DataFrame:
        words = F.slice(F.split(F.regexp_replace("text", "\n", " "), " "), 1, 8)
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))

    @property
    def queue(self) -> DataFrame:
        """One index request per unit; one in four is still open."""
        u = self.units.select("unit_id", "memory_space", "authored_at_ms")
        done = F.length("unit_id") % 4 != 0
        return u.select("unit_id", "memory_space", F.col("authored_at_ms").alias("enqueued_at_ms"), F.when(done, F.col("authored_at_ms") + 500).otherwise(0).cast("long").alias("processed_at_ms"))
