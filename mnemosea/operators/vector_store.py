"""Nearest vectors over a store of cells.

A store is made of parts (one, or one for each segment of an index). The vectors of a part are grouped by their nearest pivot, packed
in blocks of bounded size and written in a folder for each cell; a small table holds each cell's pivot, radius and count.
A search takes two steps. Each query first looks into the cells nearest to it, until they hold k vectors; the k-th
distance there is the most that matters, and by the triangle inequality only cells with

    distance of query and pivot - radius <= k-th distance

are looked into next. Only folders of cells that some query needs are read. Results are exact.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemosea.sources.shared import kept

#: Most cells of a part; below, half the root of the number of vectors.
MOST_CELLS = 1024
#: Vectors, and bytes of them, in a block; and queries that meet a block at once.
BLOCK_ROWS, BLOCK_BYTES, PACK_QUERIES = 1024, 4 << 20, 256
#: Queries of a request whose cells are chosen on the driver.
FEW = 16
#: Distances are rounded to six places; what rounding may hide.
SLACK = 2e-6


@dataclass(frozen=True)
class Part:
    """One part: its name, and how many vectors it has."""

    seq: str
    n: int


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def write_part(rows: DataFrame, root: str, seq: str, *, key: str, dim: int, cells: int | None = None) -> Part:
    """Writes the vectors (key, embedding) of length ``dim`` as a part. Vectors of other lengths, null ones, and those with null or
    non-finite components can't be near anything and are left out."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    sound = (F.size("embedding") == dim) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows.write.parquet(f"{root}/rows/seq={seq}")
    rows = spark.read.schema(f"id {kind}, embedding array<double>").parquet(f"{root}/rows/seq={seq}")
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(n) // 2))
    seeds = rows.orderBy(F.xxhash64(F.lit(4), "id"), "id").limit(cells).collect()  # a vector for each cell
    pivots = np.unique(np.array([s["embedding"] for s in seeds]).reshape(-1, dim), axis=0)
    half = (pivots**2).sum(1) / 2

    def assigned(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            cell = np.concatenate([(x[i : i + 256] @ pivots.T - half).argmax(1) for i in range(0, len(x), 256)] or [np.zeros(0, np.int64)])
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "embedding", "cell", "far"])

    placed = rows.mapInArrow(assigned, f"id {kind}, embedding array<double>, cell int, far double")
    found = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row for each cell
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    table = [(r["cell"], pivots[r["cell"]].tolist(), r["radius"] * (1 + 1e-9) + 1e-12, r["n"]) for r in found]
    spark.createDataFrame(table, "cell int, pivot array<double>, radius double, n long").coalesce(1).write.parquet(f"{root}/cells/seq={seq}")
    blocks = F.create_map(*[F.lit(x) for r in found for x in (r["cell"], -(-r["n"] // size))]) if found else F.create_map(F.lit(0), F.lit(1))

    def packed(key, table):
        x = _matrix(table["embedding"].combine_chunks(), dim)
        ids = table["id"].combine_chunks()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "data": pa.array([x.tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64("id"), F.element_at(blocks, F.col("cell"))).alias("block")
    packs = placed.select("cell", block, "id", "embedding").groupBy("cell", "block").applyInArrow(packed, f"cell int, ids array<{kind}>, data binary")
    packs.write.partitionBy("cell").parquet(f"{root}/blocks/seq={seq}")
    return Part(seq, n)


def _chooser(cells: list, k: int):
    """A function from queries to (place of the query, place of the cell): without limits the nearest cells that hold k vectors
    together, and with a limit of distance for each query the other cells within reach."""
    pivots = np.array([r["pivot"] for r in cells])
    radius, n = np.array([r["radius"] for r in cells]), np.array([r["n"] for r in cells])

    def choose(q: np.ndarray, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        far = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ pivots.T + (pivots**2).sum(1)))
        order = np.argsort(far, 1, kind="stable")
        held = np.cumsum(n[order], 1) - n[order]
        front = np.zeros(far.shape, bool)
        np.put_along_axis(front, order, held < k, 1)
        if limit is None:
            return np.nonzero(front)
        error = 1e-7 * (1 + np.abs(q).max(1, initial=0) + far.max(1, initial=0))
        return np.nonzero(~front & (far - radius <= (limit + SLACK + error)[:, None]))

    return choose


@dataclass(frozen=True)
class VectorStore:
    """Parts with one key and one length of vectors, in one folder."""

    spark: SparkSession
    root: str
    parts: tuple[Part, ...]
    key: str
    kind: str
    dim: int

    @classmethod
    def build(cls, rows: DataFrame, root: str, *, key: str, dim: int, cells: int | None = None) -> VectorStore:
        return cls(rows.sparkSession, root, (write_part(rows, root, "first", key=key, dim=dim, cells=cells),), key, dict(rows.dtypes)[key], dim)

    def _scan(self, table: str, schema: str, parts: list[str]) -> DataFrame:
        """One scan, however many parts there are."""
        schema = f"{schema}, seq string"
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/seq={s}" for s in parts]) if parts else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """(seq, key, embedding) of all parts."""
        return self._scan("rows", f"id {self.kind}, embedding array<double>", [p.seq for p in self.parts if p.n]).select("seq", F.col("id").alias(self.key), "embedding")

    def cells(self) -> list:
        """A row for each cell of each part, read once."""
        return self._cells

    @functools.cached_property
    def _cells(self) -> list:
        return self._scan("cells", "cell int, pivot array<double>, radius double, n long", [p.seq for p in self.parts if p.n]).collect()

    def blocks(self, needed: list[tuple[str, int]]) -> DataFrame:
        """The blocks of the needed (seq, cell)."""
        rows = self._scan("blocks", f"ids array<{self.kind}>, data binary, cell int", sorted({s for s, _ in needed}))
        own: dict[str, list[int]] = {}
        for seq, cell in needed:
            own.setdefault(seq, []).append(cell)
        wanted = F.lit(False)
        for seq, cells in sorted(own.items()):
            wanted = wanted | ((F.col("seq") == seq) & F.col("cell").isin(sorted(cells)))
        return rows.filter(wanted)

    def search(self, queries: DataFrame, k: int, *, allowed: DataFrame | None = None, gone: DataFrame | None = None, looked: list | None = None) -> DataFrame:
        """(query_id, key, distance, semantic_rank): the k nearest of each of ``queries`` (query_id, qv) by L2 distance, rounded to six places;
        ties go to the smaller key.

        ``allowed`` (key) are the only ones that may be found, ``gone`` (seq, key) those that a part no longer has. Queries
        whose vector is null, of another length or not finite find nothing. ``looked`` gets (cells looked into, vectors compared, of
        how many) summed over the queries.
        """
        schema = f"query_id {dict(queries.dtypes)['query_id']}, {self.key} {self.kind}, distance double"
        cells = self.cells()
        if not cells:
            return self.spark.createDataFrame([], schema).withColumn("semantic_rank", F.lit(0).cast("long"))
        finite = F.forall("qv", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        asked = queries.filter((F.size("qv") == self.dim) & F.coalesce(finite, F.lit(False))).select("query_id", F.col("qv").cast("array<double>").alias("qv"))
        best = Window.partitionBy("query_id").orderBy("distance", self.key)
        ranked = lambda rows: rows.withColumn("semantic_rank", F.row_number().over(best).cast("long")).filter(F.col("semantic_rank") <= k)
        if len(some := asked.limit(FEW + 1).collect()) <= FEW:
            return ranked(self._few(some, asked.schema, cells, k, schema, allowed, gone, looked))
        first = self._probes(asked, cells, k, None)
        near = kept(self._solved(first, k, schema, allowed, gone))
        kth = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", self.key))).groupBy("query_id").agg(F.max(F.when(F.col("place") <= k, F.col("distance"))).alias("kth"), F.count(F.lit(1)).alias("have"))
        bound = asked.join(kth, "query_id", "left").select("query_id", "qv", F.when(F.col("have") >= k, F.col("kth")).alias("kth"))
        second = self._probes(bound, cells, k, "kth")
        if looked is not None:
            sizes = {(r["seq"], r["cell"]): r["n"] for r in cells}
            used = [(r["seq"], r["cell"]) for r in first.unionByName(second).select("seq", "cell").collect()]
            looked.append((len(used), sum(sizes[c] for c in used), sum(sizes.values()) * asked.count()))
        second = second.join(bound.select("query_id", "kth"), "query_id")
        return ranked(near.unionByName(self._solved(second, k, schema, allowed, gone)))

    def _few(self, some: list, kind, cells: list, k: int, schema: str, allowed: DataFrame | None, gone: DataFrame | None, looked: list | None) -> DataFrame:
        """search() of FEW queries at most, whose cells are chosen here: one job for each step."""
        q = np.array([r["qv"] for r in some], np.float64).reshape(-1, self.dim)
        choose, found, used = _chooser(cells, k), [], []
        limit = None
        for _ in range(2):
            row, at = choose(q, limit)
            used += at.tolist()
            if len(row):
                names = [(cells[a]["seq"], cells[a]["cell"]) for a in at.tolist()]
                probes = self.spark.createDataFrame([(some[i]["query_id"], q[i].tolist(), *names[j]) for j, i in enumerate(row.tolist())], f"query_id {kind['query_id'].dataType.simpleString()}, qv array<double>, seq string, cell int")
                found += self._solved(probes, k, schema, allowed, gone, sorted(set(names)), len(some)).collect()  # little more than k for each query and block
            own: dict = {}
            for r in found:
                own.setdefault(r["query_id"], []).append(r["distance"])
            limit = np.array([sorted(d)[k - 1] if len(d := own.get(r["query_id"], [])) >= k else np.inf for r in some])
        if looked is not None:
            looked.append((len(used), sum(cells[a]["n"] for a in used), sum(c["n"] for c in cells) * len(some)))
        return self.spark.createDataFrame(found, schema)

    def _probes(self, asked: DataFrame, cells: list, k: int, kth: str | None) -> DataFrame:
        """(query_id, qv, seq, cell): without ``kth`` the nearest cells that hold k vectors together, and with it the other ones within reach."""
        choose = _chooser(cells, k)
        seq, cell = pa.array([r["seq"] for r in cells], pa.string()), np.array([r["cell"] for r in cells], np.int32)
        names = [*asked.columns[:2], "seq", "cell"]
        dim = self.dim

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    limit = None if kth is None else np.asarray(part.column(kth).fill_null(float("inf")))
                    row, at = choose(_matrix(part.column("qv"), dim), limit)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in names[:2]), seq.take(pa.array(at)), pa.array(cell[at])], names=names)

        kind = dict(asked.dtypes)["query_id"]
        return asked.mapInArrow(run, f"query_id {kind}, qv array<double>, seq string, cell int")

    def _solved(self, probes: DataFrame, k: int, schema: str, allowed: DataFrame | None, gone: DataFrame | None, needed: list | None = None, most: int = 1) -> DataFrame:
        """The k nearest of each query in each block that it looks into, of which none is farther than ``kth``, if the probes have it; ``needed`` are the
        (seq, cell) and ``most`` the queries of one, if known."""
        if needed is None:
            per_cell = probes.groupBy("seq", "cell").agg(F.count(F.lit(1)).alias("q")).collect()  # a row for each cell at most
            needed, most = [(r["seq"], r["cell"]) for r in per_cell], max([r["q"] for r in per_cell], default=1)
        blocks = self.blocks(needed)
        dim, key = self.dim, self.key
        if allowed is not None or gone is not None:
            blocks = self._filtered(blocks, allowed, gone)
        share = F.pmod(F.xxhash64("query_id"), F.lit(-(-most // PACK_QUERIES)))
        most_far = F.coalesce("kth", F.lit(float("inf"))) if "kth" in probes.columns else F.lit(float("inf"))
        asked = F.collect_list(F.struct("query_id", "qv", most_far.alias("kth")))
        packs = probes.groupBy("seq", "cell", share.alias("share")).agg(asked.alias("asked"))
        packs = packs.select("seq", "cell", F.col("asked.query_id").alias("queries"), F.flatten("asked.qv").alias("qv"), F.col("asked.kth").alias("limits"))
        met = blocks.join(packs, ["seq", "cell"]).select("ids", "data", "queries", "qv", "limits")

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    ids, asked = row.column("ids").flatten(), row.column("queries").flatten()
                    x = np.frombuffer(row.column("data")[0].as_py(), np.float64).reshape(-1, dim)
                    q = np.asarray(row.column("qv").flatten()).reshape(-1, dim)
                    near = np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1))
                    scale = (q**2).sum(1)[:, None] + (x**2).sum(1)
                    if len(x) > k:
                        # Products are rounded otherwise than differences, so a little more than k are measured.
                        kth = np.partition(near, k - 1, axis=1)[:, k - 1]
                        of, at = np.nonzero(np.sqrt(near) <= np.sqrt(kth)[:, None] + SLACK + 1e-7 * np.sqrt(scale))
                    else:
                        of, at = np.nonzero(np.ones(near.shape, bool))
                    square = np.cumsum((x[at] - q[of]) ** 2, 1)
                    distance = np.round(np.sqrt(square[:, -1]), 6)
                    within = distance <= np.asarray(row.column("limits").flatten())[of]
                    of, at, distance = of[within], at[within], distance[within]
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(of)), ids.take(pa.array(at)), pa.array(distance)], names=["query_id", key, "distance"])

        return met.mapInArrow(run, schema)

    def _filtered(self, blocks: DataFrame, allowed: DataFrame | None, gone: DataFrame | None) -> DataFrame:
        """The blocks with only what may be found."""
        dim, key, kind = self.dim, self.key, self.kind
        schema = f"seq string, cell int, block long, {key} {kind}, vector binary"

        def opened(batches):
            from pyspark import TaskContext

            block = TaskContext.get().partitionId() << 33
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    ids = row.column("ids").flatten()
                    data = row.column("data")[0].as_py()
                    vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(ids), [None, pa.py_buffer(data)]).cast(pa.binary())
                    own = row.select(["seq", "cell"]).take(pa.array(np.zeros(len(ids), np.int32)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(ids), block)), ids, vectors], names=["seq", "cell", "block", key, "vector"])
                    block += 1

        rows = blocks.select("seq", "cell", "ids", "data").mapInArrow(opened, schema)
        if gone is not None:
            rows = rows.join(gone.select("seq", key), ["seq", key], "left_anti")
        if allowed is not None:
            rows = rows.join(allowed.select(key), key, "left_semi")
        closed = rows.groupBy("seq", "cell", "block").agg(F.collect_list(F.struct(key, "vector")).alias("x"))
        # A list of binaries becomes one: hexadecimal digits are joined and read again.
        data = F.unhex(F.array_join(F.transform("x", lambda p: F.hex(p["vector"])), ""))
        return closed.select("seq", F.transform("x", lambda p: p[key]).alias("ids"), data.alias("data"), "cell")
