"""The stored index: segments that merge, postings in blocks with bounds, vectors in cells, and a manifest.

A change of units is written as a new segment, together with what it replaces: the dead of older segments, with the segment that
held them. Reading a table is one scan of all segments, less the dead. The manifest has a row for each segment, with its counts, so
statistics need no scan. After a change the last segments are merged while the last one holds half as much as the one before: sizes fall by half from one
to the next, so n changes leave no more than log2(n) + 1 segments beside the first, and what is written again is a share of that.

Postings of a term are cut in blocks by range. A range is a part of the units of like length, so the largest count of the term
and the least length in a block bound well what any unit of it can score, whatever the statistics are by then.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosea.functions import postings, text
from mnemosea.functions.vectors import DIMENSION
from mnemosea.operators import vector_store
from mnemosea.operators.vector_store import VectorStore
from mnemosea.sources.shared import kept, shared_folder

#: Tokens of the corpus for each bucket of postings, about, and the fewest and most buckets.
BUCKET_TOKENS, FEWEST, MOST = 20_000_000, 8, 4096
#: Tokens of a part of a bucket that is written by one task, about, and most of these parts.
SLICE_TOKENS, MOST_SLICES = 5_000_000, 16
#: Units of a range, at least, and most ranges of a segment, about.
RANGE_UNITS, MOST_RANGES = 256, 8192
#: Tokens of a range, at most, about: so much is counted at once.
RANGE_TOKENS = 2 << 20
#: Parts of the table of units, of which a change reads those that it touches.
SLOTS = 64
TOKENIZERS = ("unicode61", "trigram")
SCHEMAS = {
    "units": "unit_id string, doc_len long, slot int, seq string",
    "blocks": "term string, range long, n long, max_tf long, min_len long, unit_ids array<string>, tfs array<int>, lens array<int>, bucket int, seq string",
    "dead": "of string, unit_id string, doc_len long, range long, seq string",
}

#: What is written of a segment's blocks.
BLOCKS = SCHEMAS["blocks"].removesuffix(", seq string")


@dataclass(frozen=True)
class Segment:
    """One segment: its name, what was written in it and how much of that is dead by now, and in how many parts the units
    of each class of length are cut."""

    seq: str
    units: int
    tokens: int
    vectors: int
    parts: str
    dead_units: int = 0
    dead_tokens: int = 0

    @property
    def live(self) -> int:
        return self.units - self.dead_units


def indexed(units: DataFrame) -> DataFrame:
    """What the text index holds of each unit: its title, and its body unless it is secret or inactive."""
    shown = (F.col("state") == "active") & (F.col("sensitivity") != "secret")
    return units.select("unit_id", "title", F.when(shown, F.col("body")).otherwise("").alias("body"))


def indexable(units: DataFrame) -> DataFrame:
    return units.filter((F.col("state") == "active") & (F.col("sensitivity") != "secret"))


def unit_vectors(units: DataFrame, dim: int = DIMENSION) -> DataFrame:
    """(unit_id, embedding): local embeddings of the units that may be indexed."""
    return postings.embedded(indexable(units).select("unit_id", F.lower(F.concat_ws("\n", "title", "body")).alias("text")), dim)


def embeddings(units: DataFrame, dim: int = DIMENSION) -> VectorStore:
    """The stored vectors of all ``units`` without an index of their texts, which build() adds."""
    root = f"{shared_folder(units.sparkSession)}/index-{uuid.uuid4().hex}/vectors"
    part = vector_store.write_part(unit_vectors(units, dim), root, uuid.uuid4().hex[:12], key="unit_id", dim=dim)
    return VectorStore(units.sparkSession, root, (part,), "unit_id", "string", dim)


def documents(texts: DataFrame) -> DataFrame:
    """unit_id, tokens, doc_len."""
    t = F.concat(text.index_tokens(F.col("title")), text.index_tokens(F.col("body")))
    return texts.select("unit_id", t.alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))


def trigram_lengths(texts: DataFrame) -> DataFrame:
    """unit_id, doc_len: how many three characters in a row the title and the body have in lower case."""
    return trigram_texts(texts).select("unit_id", "doc_len")


def trigram_texts(texts: DataFrame) -> DataFrame:
    """unit_id, title and body in lower case, doc_len."""
    n = [F.greatest(F.coalesce(F.length(F.lower(c)), F.lit(0)) - 2, F.lit(0)) for c in ("title", "body")]
    low = [F.coalesce(F.lower(c), F.lit("")).alias(c) for c in ("title", "body")]
    return texts.select("unit_id", *low, (n[0] + n[1]).cast("long").alias("doc_len"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def slot_of(unit_id: Column) -> Column:
    return F.pmod(F.xxhash64(unit_id), F.lit(SLOTS)).cast("int")


def unit_hash(unit_id: Column) -> Column:
    """What deals the units of a class of length out to its ranges."""
    return F.xxhash64(F.lit(3), unit_id)


def length_class(doc_len: Column) -> Column:
    """Lengths within a fifth of each other, about, are one class."""
    return F.floor(F.log2(doc_len.cast("double") + 1.0) * 4.0).cast("long")


def range_of(doc_len: Column, unit_id: Column, parts: dict[int, int]) -> Column:
    own = F.create_map(*[F.lit(x) for pair in (parts or {0: 1}).items() for x in pair])
    return length_class(doc_len) * (1 << 32) + F.pmod(unit_hash(unit_id), F.coalesce(F.element_at(own, length_class(doc_len).cast("int")), F.lit(1)))


@dataclass(frozen=True)
class Index:
    """A stored index: its segments, oldest first, and the texts that it was made of."""

    spark: SparkSession
    root: str
    texts: DataFrame
    segments: tuple[Segment, ...]
    buckets: int
    dim: int = DIMENSION
    tokenizer: str = "unicode61"
    #: The folder of its manifest.
    manifest: str = ""

    @property
    def has_dead(self) -> bool:
        return any(s.dead_units for s in self.segments)

    def _scan(self, table: str) -> DataFrame:
        """One scan, however many segments there are; a segment's name, and the bucket or slot, are columns of their folders."""
        read = self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.root}/{table}")
        return read.parquet(*[f"{self.root}/{table}/seq={s.seq}" for s in self.segments])

    def dead(self) -> DataFrame:
        """(seq, unit_id, doc_len, range) of what a segment holds and later ones replaced."""
        return self._scan("dead").select(F.col("of").alias("seq"), "unit_id", "doc_len", "range")

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (seq, unit_id, ...) of the segments without the dead."""
        return rows.join(self.dead().select("seq", "unit_id"), ["seq", "unit_id"], "left_anti") if self.has_dead else rows

    def blocks(self) -> DataFrame:
        return self._scan("blocks")

    def opened(self, blocks: DataFrame, *also: str) -> DataFrame:
        """The live postings of some blocks."""
        rows = blocks.select("seq", "term", "bucket", *also, F.explode(F.arrays_zip("unit_ids", "tfs", "lens")).alias("p"))
        rows = rows.select("seq", F.col("p.unit_ids").alias("unit_id"), F.col("p.lens").cast("long").alias("doc_len"), "term", F.col("p.tfs").cast("long").alias("tf"), "bucket", *also)
        return self.live(rows)

    @property
    def postings(self) -> DataFrame:
        """unit_id, doc_len, term, tf, bucket."""
        return self.opened(self.blocks()).select("unit_id", "doc_len", "term", "tf", "bucket")

    def stored_units(self) -> DataFrame:
        """(seq, unit_id, doc_len) of the live units."""
        return self.live(self._scan("units").select("seq", "unit_id", "doc_len"))

    def own_range(self) -> Column:
        """The range of a stored unit (seq, unit_id, doc_len)."""
        return F.coalesce(*[F.when(F.col("seq") == s.seq, range_of(F.col("doc_len"), F.col("unit_id"), {int(k): v for k, v in json.loads(s.parts).items()})) for s in self.segments])

    @property
    def units(self) -> DataFrame:
        """unit_id, doc_len."""
        return self.stored_units().select("unit_id", "doc_len")

    @functools.cached_property
    def vector_store(self) -> VectorStore:
        return VectorStore(self.spark, f"{self.root}/vectors", tuple(vector_store.Part(s.seq, s.vectors) for s in self.segments), "unit_id", "string", self.dim)

    @property
    def vectors(self) -> DataFrame:
        return self.live(self.vector_store.rows()).select("unit_id", "embedding")

    def nearest(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, unit_id, distance, semantic_rank) of the k nearest live units of each of ``queries`` (query_id, qv)."""
        return self.vector_store.search(queries, k, allowed=allowed, gone=self.dead().select("seq", "unit_id") if self.has_dead else None)

    def statistics(self) -> tuple[int, float]:
        """Units, and their mean length: what the manifest says."""
        n = sum(s.live for s in self.segments)
        return n, sum(s.tokens - s.dead_tokens for s in self.segments) / n if n else 0.0

    # Writing.

    def _noted(self) -> Index:
        """The index with a manifest of its own."""
        rows = [(json.dumps(asdict(s)),) for s in self.segments]
        about = json.dumps({"buckets": self.buckets, "dim": self.dim, "tokenizer": self.tokenizer, "order": [s.seq for s in self.segments]})
        path = f"{self.root}/manifest/{uuid.uuid4().hex}"
        self.spark.createDataFrame([*rows, (about,)], "entry string").coalesce(1).write.parquet(path)
        return replace(self, manifest=path)

    @classmethod
    def open(cls, spark: SparkSession, manifest: str, texts: DataFrame) -> Index:
        """The index that a manifest describes."""
        entries = [json.loads(r["entry"]) for r in spark.read.schema("entry string").parquet(manifest).collect()]
        about = next(e for e in entries if "order" in e)
        segments = {e["seq"]: Segment(**e) for e in entries if "seq" in e}
        return cls(spark, manifest.rpartition("/manifest/")[0], texts, tuple(segments[s] for s in about["order"]), about["buckets"], about["dim"], about["tokenizer"], manifest)

    def _written(self, units: DataFrame, blocks: Callable[[dict[int, int], int, int], DataFrame], vectors_: DataFrame | vector_store.Part, dead: DataFrame) -> tuple[Index, Segment]:
        """A new segment's tables: ``units`` (unit_id, doc_len), ``blocks`` by parts of the classes of length, buckets and slices of these, vectors (or the part of them that is
        written already, whose name the segment takes), and the dead of other segments (of, unit_id, doc_len, range)."""
        seq = vectors_.seq if isinstance(vectors_, vector_store.Part) else uuid.uuid4().hex[:12]
        slot = slot_of(F.col("unit_id"))
        # Else each task would write a file for each slot.
        units.select("unit_id", "doc_len", slot.alias("slot")).hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{self.root}/units/seq={seq}")
        there = self.spark.read.schema("unit_id string, doc_len long").parquet(f"{self.root}/units/seq={seq}")
        found = there.groupBy(length_class(F.col("doc_len")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("tokens")).collect()  # a row for each class of length
        n, tokens = sum(r["n"] for r in found), sum(r["tokens"] or 0 for r in found)
        size = max(RANGE_UNITS, n // MOST_RANGES)
        # Powers of two, so that a merge takes whole ranges or halves them.
        parts = {int(r["k"]): 1 << (max(-(-r["n"] // size), -(-r["tokens"] // RANGE_TOKENS)) - 1).bit_length() for r in found}
        buckets = self.buckets or min(MOST, max(FEWEST, math.ceil(tokens / BUCKET_TOKENS)))
        # In the order of ranges the names of a range's units come again and again, which is what makes them small, whatever the number of units.
        slices = min(MOST_SLICES, max(1, -(-tokens // (buckets * SLICE_TOKENS))))
        blocks(parts, buckets, slices).sortWithinPartitions("bucket", "range", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/blocks/seq={seq}")
        part = vectors_ if isinstance(vectors_, vector_store.Part) else vector_store.write_part(vectors_, f"{self.root}/vectors", seq, key="unit_id", dim=self.dim)
        dead.select("of", "unit_id", "doc_len", "range").write.parquet(f"{self.root}/dead/seq={seq}")
        return replace(self, buckets=buckets), Segment(seq, n, tokens, part.n, json.dumps(parts))

    def _of_units(self, units: DataFrame) -> tuple[DataFrame, Callable[[dict[int, int], int, int], DataFrame], DataFrame]:
        texts = indexed(units)
        if self.tokenizer == "trigram":
            low = trigram_texts(texts)
            lengths, blocks = trigram_lengths(texts), postings.trigram_blocks
        else:
            low = texts.select("unit_id", F.concat_ws("\n", F.lower("title"), F.lower("body")).alias("text"))
            lengths, low, blocks = postings.with_lengths(low, keep=False), postings.with_lengths(low), postings.token_blocks

        def placed(parts: dict[int, int], buckets: int, slices: int) -> DataFrame:
            made = blocks(low.withColumn("range", range_of(F.col("doc_len"), F.col("unit_id"), parts)), buckets)
            # A bucket may become several files, so a frequent term loads no single task. Blocks are packed on their way there.
            return postings.unpacked(postings.by_bucket(made, buckets, slices), BLOCKS)

        return lengths, placed, unit_vectors(units, self.dim)

    @classmethod
    def build(cls, units: DataFrame, *, dim: int = DIMENSION, tokenizer: str = "unicode61", root: str | None = None, embedded: VectorStore | None = None) -> Index:
        """The index of all ``units``, as one segment; ``embedded`` is what embeddings() wrote of the same units, which one index may take over."""
        root = root or (embedded.root.removesuffix("/vectors") if embedded else f"{shared_folder(units.sparkSession)}/index-{uuid.uuid4().hex}")
        empty = cls(units.sparkSession, root, indexed(units), (), 0, embedded.dim if embedded else dim, tokenizer)
        lengths, placed, vectors_ = empty._of_units(units)
        made, first = empty._written(lengths, placed, embedded.parts[0] if embedded else vectors_, units.sparkSession.createDataFrame([], SCHEMAS["dead"]))
        return replace(made, segments=(first,))._noted()

    def updated(self, changed: DataFrame, texts: DataFrame, gone: DataFrame | None = None) -> Index:
        """The index after ``changed`` units were added or replaced and those of ``gone`` (unit_id) removed. What is written is as large as the
        change, and of older segments only the slots of units are read that hold what is replaced."""
        changed = kept(changed)  # read for its ids, lengths, blocks and vectors
        ids = changed.select("unit_id") if gone is None else changed.select("unit_id").unionByName(gone.select("unit_id"))
        ids = ids.distinct()
        slots = [r["slot"] for r in ids.select(slot_of(F.col("unit_id")).alias("slot")).distinct().collect()]  # SLOTS at most
        old = self.live(self._scan("units").filter(F.col("slot").isin(slots)).select("seq", "unit_id", "doc_len")).join(ids, "unit_id", "left_semi")
        made, new = self._written(*self._of_units(changed), old.select(F.col("seq").alias("of"), "unit_id", "doc_len", self.own_range().alias("range")))
        fallen = replace(made, segments=(new,)).dead().groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("tokens"))
        died = {r["seq"]: r for r in fallen.collect()}  # a row for each segment
        older = tuple(replace(s, dead_units=s.dead_units + died[s.seq]["n"], dead_tokens=s.dead_tokens + died[s.seq]["tokens"]) if s.seq in died else s for s in made.segments)
        after = replace(made, texts=texts, segments=(*older, new))
        while len(after.segments) > 1 and due(after.segments[-2].live, after.segments[-1].live):
            after = after._merged(2)
        return after._noted()

    def compacted(self) -> Index:
        """The index as one segment."""
        return self._merged(len(self.segments))._noted() if len(self.segments) > 1 else self

    def _merged(self, last: int) -> Index:
        """The index with its last segments as one, without their dead, who are all noted in these segments."""
        own = self.segments[-last:]
        part = replace(self, segments=own)
        dead = part.dead()
        kept_dead = dead.filter(~F.col("seq").isin([s.seq for s in own])).withColumnRenamed("seq", "of")
        gone = dead.filter(F.col("seq").isin([s.seq for s in own]))

        def placed(parts: dict[int, int], buckets: int, slices: int) -> DataFrame:
            of = lambda found, k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (found or {0: 1}).items() for x in pair]), k), F.lit(1))
            kind = F.shiftright("range", 32).cast("int")
            before = F.coalesce(*[F.when(F.col("seq") == s.seq, of({int(k): v for k, v in json.loads(s.parts).items()}, kind)) for s in own])
            hashes = F.when(of(parts, kind) > before, F.transform("unit_ids", unit_hash))
            blocks = part.blocks().select("seq", "bucket", "range", "term", "unit_ids", "tfs", "lens", of(parts, kind).alias("parts"), hashes.alias("hashes"))
            return postings.moved_blocks(blocks, gone.select("seq", range_of(F.col("doc_len"), F.col("unit_id"), parts).alias("range"), "unit_id"), buckets, slices, BLOCKS)

        made, new = self._written(part.units, placed, part.vectors, kept_dead)
        return replace(made, segments=(*self.segments[:-last], new))


def due(before: int, last: int) -> bool:
    """Whether the last segment is to be merged with the one before."""
    return 2 * last >= before
