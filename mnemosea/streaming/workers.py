"""Structured Streaming workers: index requests, change merges and session ingest.

Each reads a folder of files as they come and hands every micro-batch to a batch dataflow.
Results are versions of a table: a batch writes the next version from the last one, so a batch
that runs again after a failure gives the same table, and no path is read while it is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemosea.functions import text, vectors
from mnemosea.operators import ingest, maintain, sync
from mnemosea.sources.shared import shared_folder

#: Requests that a tick of the index worker takes.
TICK = 128


class Versions:
    """A table in buckets of its key. A batch writes the buckets that it touches, as a version of its own, and a manifest that
    says of which version each bucket is; so its cost grows with what it touches, a batch that runs again after a
    failure gives the same table, and no path is read while it is written."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str, schema, key: str):
        self.spark, self.root, self.schema, self.key = spark, root, schema, key

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.BUCKETS)).cast("int").alias("bucket")

    def manifest(self, number: int) -> dict[int, int]:
        """The version of each bucket after batch ``number``; a manifest has a row for each bucket at most."""
        return {} if number < 0 else {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/manifest/{number}").collect()}

    def read(self, number: int, buckets: set[int] | None = None) -> DataFrame:
        own = {b: v for b, v in self.manifest(number).items() if buckets is None or b in buckets}
        paths = [f"{self.root}/data/{v}/bucket={b}" for b, v in sorted(own.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def step(self, number: int, rows: DataFrame, change) -> None:
        """Write version ``number``: ``change`` makes the touched buckets' rows from what they were and ``rows``."""
        touched = {r["bucket"] for r in rows.select(self._bucket()).distinct().collect()}
        made = change(self.read(number - 1, touched), rows)
        made.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{number}")
        there = {r["bucket"] for r in made.select(self._bucket()).distinct().collect()}
        known = {b: v for b, v in self.manifest(number - 1).items() if b not in touched} | dict.fromkeys(sorted(there), number)
        self.spark.createDataFrame(sorted(known.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{number}")


def run_available(source: DataFrame, step, checkpoint: str) -> int:
    """Run a stream over what is there; ``step`` takes a batch's number and rows. Gives the last batch's number."""
    last = [-1]

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        step(number, rows)
        rows.unpersist()
        last[0] = number

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last[0]


def _staged(spark: SparkSession, rows: DataFrame, name: str, files: int, *by: str) -> tuple[DataFrame, str]:
    """``rows`` as a folder that a stream reads in several batches, and a folder for the worker."""
    root = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    rows.repartition(files, *by).write.parquet(f"{root}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(f"{root}/in"), root


def embedded(requests: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, embedding, indexed) of the requests: a missing or inactive unit loses its vector, and so does a secret one."""
    asked = requests.select("unit_id").distinct()
    rows = asked.join(units.select("unit_id", "title", "body", "state", "sensitivity"), "unit_id", "left")
    usable = (F.col("state") == "active") & (F.col("sensitivity") != "secret")
    vector = F.when(usable, vectors.local_embedding(text.tokens(F.concat_ws("\n", "title", "body"))))
    return rows.select("unit_id", vector.alias("embedding"))


def index_step(table: DataFrame, requests: DataFrame, units: DataFrame) -> DataFrame:
    new = embedded(requests.filter("processed_at_ms = 0"), units)
    return table.join(new.select("unit_id"), "unit_id", "left_anti").unionByName(new.filter("embedding is not null"))


def index_once(spark: SparkSession, queue: DataFrame, units: DataFrame) -> DataFrame:
    source, root = _staged(spark, queue, "index", 4)
    table = Versions(spark, f"{root}/table", "unit_id string, embedding array<double>", "unit_id")
    last = run_available(source, lambda number, rows: table.step(number, rows, lambda old, new: index_step(old, new, units)), f"{root}/checkpoint")
    return table.read(last).select("unit_id", F.size("embedding").alias("dim"))


def index_tick(queue: DataFrame, vectors_df: DataFrame, units: DataFrame, *, now_ms: int, limit: int = TICK, failing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One tick of the worker: the oldest ``limit`` open requests are taken, and the queue and the vectors after them given.

    All open requests of a unit that was taken are completed together, units without a usable text lose their vector. Units of
    ``failing`` (unit_id) could not be embedded: their requests stay open for the next tick, and their vectors as they were.
    """
    taken = maintain.next_items(queue, limit).select("unit_id").distinct()
    if failing is not None:
        taken = taken.join(failing.select("unit_id"), "unit_id", "left_anti")
    done = queue.join(taken.withColumn("taken", F.lit(True)), "unit_id", "left")
    closes = F.coalesce("taken", F.lit(False)) & (F.col("processed_at_ms") == 0)
    after = done.withColumn("processed_at_ms", F.when(closes, F.lit(now_ms)).otherwise(F.col("processed_at_ms")).cast("long")).select(*queue.columns)
    new = embedded(taken, units)
    return after, vectors_df.join(taken, "unit_id", "left_anti").unionByName(new.filter("embedding is not null"))


def crdt_step(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Cells merged with what is stored; the order of batches does not matter."""
    return sync.merged_changes(table.unionByName(batch.select(*table.columns)))


def merge_once(spark: SparkSession, changes: DataFrame) -> DataFrame:
    source, root = _staged(spark, changes.select(*sync.CELL_COLUMNS), "crdt", 4)
    table = Versions(spark, f"{root}/table", "tbl string, pk string, cid string, val string, kind string, col_version long, site_id string, cl long", "pk")
    return sync.merged_cells(table.read(run_available(source, lambda number, rows: table.step(number, rows, crdt_step), f"{root}/checkpoint")))


def ingest_step(table: DataFrame, messages: DataFrame) -> DataFrame:
    """The touched sessions' messages; a message that comes again is kept once, as it came first."""
    key = ["session_id", "seq"]
    w = Window.partitionBy(*key).orderBy("content")
    new = messages.join(table.select(*key), key, "left_anti").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return table.unionByName(new.select(*table.columns))


def ingest_once(spark: SparkSession, messages: DataFrame, files: int = 4, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Chunks of all sessions as they come. A chunk that exists stays as it is, even if later messages would make it longer."""
    source, root = _staged(spark, messages, "ingest", files, *by)
    stored = Versions(spark, f"{root}/messages", messages.schema, "session_id")
    made = Versions(spark, f"{root}/chunks", "chunk_id string, session_id string, chunk_kind string, content_hash string", "session_id")

    def step(number: int, rows: DataFrame) -> None:
        stored.step(number, rows, ingest_step)
        touched = rows.select("session_id").distinct()
        known = stored.read(number).join(touched, "session_id", "left_semi")
        new = ingest.chunks(known).select("chunk_id", "session_id", "chunk_kind", "content_hash")
        made.step(number, new, lambda old, own: old.unionByName(own.join(old.select("chunk_id"), "chunk_id", "left_anti").select(*old.columns)))

    return made.read(run_available(source, step, f"{root}/checkpoint")).drop("session_id")
