"""Token ids in training order, in shards of fixed stride.

Texts are encoded, an end token is added, and the ids are cut into sequences of
``stride`` ids, the last one filled up with end tokens. The N sequences are numbered, and a
keyed Feistel network permutes the numbers: it works on the smallest domain of an even
number of bits that holds N, and results from N on walk on through the network until
they fall below N (less than four steps on average). So each sequence has its own slot among
0 .. N-1, found without sorting or shuffling anything.

Sequences go to range partitions by shard (slot // per_shard), where each shard is one compressed row
whose payload is its sequences in slot order, little-endian 16- or 32-bit ids. Within a payload
slot s is (s % per_shard) * stride ids from the start: a reader that stopped at a slot goes on there.

``export_files`` writes the shards as plain binary files of fixed stride for readers without Spark, which can seek in
them or map them: shard=<n>/part-*.txt holds the ids of the slots from n * per_shard on and nothing else, but for a
line feed that the writer puts at the end.

The numbers follow the order of the input's splits, and the written table of sequences
fixes them; so the same files with the same split settings and key give the same order.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemosea.llm._common import materialise, mixed, read_table, shared_folder, sliced
from mnemosea.llm.bpe import Block, vocabulary, vocabulary_path

STRIDE = 512
#: Bytes of text that are encoded together: the more, the fewer words are met twice.
ENCODED_TOGETHER = 16 << 20
PER_SHARD = 256
ROUNDS = 6
#: Ids that a worker lays out at a time.
IDS_AT_ONCE = 200_000


class Feistel:
    """A permutation of 0 .. n-1 chosen by a key."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [mixed(np.array([(key * 1_000_003 + r) & (2**64 - 1)], np.uint64))[0] for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys: list) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        return left, right

    def forward(self, x: np.ndarray) -> np.ndarray:
        out = x.astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            left, right = self._once(out[todo], self.keys)
            out[todo] = (left << np.uint64(self.half)) | right
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def backward(self, slot: np.ndarray) -> np.ndarray:
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        out = slot.astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            swapped = ((out[todo] & mask) << half) | (out[todo] >> half)
            left, right = self._once(swapped, self.keys[::-1])
            out[todo] = (right << half) | left
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)


def write_training_order(docs: DataFrame, path: str, *, key: int = 6, stride: int = STRIDE, per_shard: int = PER_SHARD, vocabulary_file: str | None = None, end: int = 49407) -> str:
    """Write the shards of ``docs`` (doc_id, text; other columns don't matter) to ``path``.

    A null or empty text is one sequence that holds just the end token. Repeated rows are
    sequences of their own. An empty table gives no shards.
    """
    vocabulary_file = vocabulary_file or vocabulary_path()
    wide = "<u2" if max(end, int(vocabulary(vocabulary_file).ids.max())) < 1 << 16 else "<u4"

    def cut(batches):
        piece, at = TaskContext.get().partitionId(), 0
        vocab = vocabulary(vocabulary_file)
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches, "text", ENCODED_TOGETHER):
            block = Block(batch.column("text"), vocab)
            ends = block.offsets[1:]
            low = 0
            while low < batch.num_rows:  # the ids of some texts at a time
                high = max(low + 1, int(np.searchsorted(ends, block.offsets[low] + IDS_AT_ONCE, side="right")))
                ids, edge = block.tokens(low, high), block.offsets[low : high + 1] - block.offsets[low]
                own = -(-(np.diff(edge) + 1) // stride)
                first = np.concatenate([[0], np.cumsum(own)])
                grid = np.full(int(first[-1]) * stride, end, wide)
                grid[np.arange(len(ids)) + np.repeat(first[:-1] * stride - edge[:-1], np.diff(edge))] = ids
                source = np.repeat(np.arange(high - low), own)
                part = np.arange(len(source)) - first[source]
                used = np.minimum(stride, np.diff(edge)[source] + 1 - part * stride)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(low + source)), pa.array(part.astype(np.int32)), pa.array(used.astype(np.int32)),
                        pa.array([pack(r.tobytes()) for r in grid.reshape(-1, stride)], pa.binary()), pa.array(np.full(len(source), piece, np.int32)), pa.array(at + np.arange(len(source))),
                    ],
                    names=["doc_id", "part", "used", "ids", "piece", "at"],
                )
                at += len(source)
                low = high

    rows = materialise(docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, part int, used int, ids binary, piece int, at long"), "tokens")
    pieces = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))  # a row for each split of the input
    upto = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = materialise(pieces.select(F.col("piece").alias("of"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), "n"), "tokens-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    network = Feistel(total, key)

    def placed(batches):
        for batch in batches:
            slot = network.forward(np.asarray(batch.column("number")))
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "part", "used", "ids"]).columns, pa.array(slot), pa.array(slot // per_shard)], names=["doc_id", "part", "used", "ids", "slot", "shard"])

    def shards(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[pa.RecordBatch] = []

        def shard():
            t = pa.Table.from_batches(held)
            slot = np.asarray(t["slot"])
            assert np.array_equal(slot, slot[0] + np.arange(len(slot)))
            payload = b"".join(map(unpack, t["ids"].to_pylist()))
            lists = [pa.array([t[c].to_pylist()], pa.list_(k)) for c, k in (("doc_id", pa.int64()), ("part", pa.int32()), ("used", pa.int32()))]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(slot[0]) // per_shard]), pa.array([int(slot[0])]), pa.array([len(slot)], pa.int64()), pa.array([payload], pa.binary()), *lists],
                names=["shard", "first_slot", "sequences", "payload", "doc_ids", "parts", "used"],
            )

        for batch in batches:
            own = np.asarray(batch.column("shard"))
            edge = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if j > i:
                    if held and held[0].column("shard")[0].as_py() != own[i]:
                        yield shard()
                        held = []
                    held.append(batch.slice(i, j - i))
        if held:
            yield shard()

    numbered = rows.join(pieces, F.col("piece") == F.col("of")).withColumn("number", F.col("before") + F.col("at"))
    order = numbered.select("doc_id", "part", "used", "ids", "number").mapInArrow(placed, "doc_id long, part int, used int, ids binary, slot long, shard long")
    order = order.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
    schema = "shard long, first_slot long, sequences long, payload binary, doc_ids array<long>, parts array<int>, used array<int>"
    order.mapInArrow(shards, schema).write.option("compression", "zstd").parquet(f"{path}/shards")
    manifest = [(total, key, stride, per_shard, wide, end)]
    docs.sparkSession.createDataFrame(manifest, "sequences long, key long, stride int, per_shard int, ids string, end_id long").coalesce(1).write.parquet(f"{path}/manifest")
    return path


def export_files(spark: SparkSession, path: str, to: str, first_shard: int = 0, last_shard: int | None = None) -> str:
    """The shards from ``first_shard`` to ``last_shard`` as plain binary files, one for each shard, in folders of their own under ``to``."""
    rows = spark.read.schema("shard long, payload binary").parquet(f"{path}/shards").filter(F.col("shard") >= first_shard)
    if last_shard is not None:
        rows = rows.filter(F.col("shard") <= last_shard)
    # Bytes that are cast to text are written as they are.
    rows.select("shard", F.col("payload").cast("string").alias("value")).write.partitionBy("shard").text(to)
    return to


def read_slots(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    """slot, doc_id, part, n_tokens, ids of the slots from ``first`` on; other shards are not read."""
    m = spark.read.schema("sequences long, key long, stride int, per_shard int, ids string, end_id long").parquet(f"{path}/manifest").first()
    last = m["sequences"] if count is None else min(m["sequences"], first + count)
    stride, wide, kind = m["stride"], m["ids"], np.dtype(m["ids"])
    schema = "shard long, first_slot long, sequences long, payload binary, doc_ids array<long>, parts array<int>, used array<int>"
    rows = spark.read.schema(schema).parquet(f"{path}/shards").filter((F.col("shard") >= first // m["per_shard"]) & (F.col("shard") <= (last - 1) // m["per_shard"]))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                step = stride * kind.itemsize
                slots = [s for s in range(row["first_slot"], row["first_slot"] + row["sequences"]) if first <= s < last]
                at = [s - row["first_slot"] for s in slots]
                ids = [np.frombuffer(row["payload"], wide, row["used"][i], i * step).astype(np.int32) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots, pa.int64()), pa.array([row["doc_ids"][i] for i in at], pa.int64()), pa.array([row["parts"][i] for i in at], pa.int32()),
                        pa.array([row["used"][i] for i in at], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                    ],
                    names=["slot", "doc_id", "part", "n_tokens", "ids"],
                )

    return rows.mapInArrow(run, "slot long, doc_id long, part int, n_tokens long, ids array<int>")


def slot_digests(spark: SparkSession, path: str) -> DataFrame:
    """slot, doc_id, part, n_tokens, ids_sha256 (of the slot's ids as they are stored) of every slot."""
    m = spark.read.schema("stride int, ids string").parquet(f"{path}/manifest").first()
    size = np.dtype(m["ids"]).itemsize
    step = m["stride"] * size
    rows = spark.read.schema("first_slot long, payload binary, doc_ids array<long>, parts array<int>, used array<int>").parquet(f"{path}/shards")

    def run(batches):
        for batch in batches:
            counts = np.asarray(batch.column("used").value_lengths())
            used = np.asarray(batch.column("used").flatten())
            slot = np.repeat(np.asarray(batch.column("first_slot")), counts) + np.arange(len(used)) - np.repeat(np.cumsum(counts) - counts, counts)
            sha = []
            for k in range(batch.num_rows):
                data = memoryview(batch.column("payload")[k].as_buffer())
                own = batch.column("used")[k].values.to_numpy().tolist()
                sha += [hashlib.sha256(data[i * step : i * step + n * size]).hexdigest() for i, n in enumerate(own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), batch.column("doc_ids").flatten(), batch.column("parts").flatten(), pa.array(used.astype(np.int64)), pa.array(sha, pa.string())],
                names=["slot", "doc_id", "part", "n_tokens", "ids_sha256"],
            )

    return rows.mapInArrow(run, "slot long, doc_id long, part int, n_tokens long, ids_sha256 string")


def op6_training_order(spark, sf_dir):
    """All documents encoded and written in training order, then read back: one row per slot."""
    path = f"{shared_folder(spark)}/llm-order-{uuid.uuid4().hex}"
    return slot_digests(spark, write_training_order(read_table(spark, sf_dir, "documents"), path))
