"""Exact top-k by inner product as a Voronoi kNN join.

Data and queries are grouped by their nearest pivot. Each cell of data is summed up by its
count, its radius and its few vectors nearest to the pivot (witnesses). From these
alone every query gets a floor for the score of its k-th result, the k-th best among
the witnesses, and for every cell a ceiling for the scores in it,

    q . v = q . p + q . (v - p) <= q . p + |q| * radius.

A group of queries is sent only to the blocks of those cells whose ceiling reaches the floor
of one of its queries. Cells are cut into blocks of bounded size, so that a hot cell is
many blocks, and groups into packs; a task solves a pair of pack and block with
one matrix product and returns what reaches the floors, k for each query at most.

Scores are integers below 2 ** 53 in float64, so they are exact; larger ones fall back to
Python integers, and scores beyond a long's range count as its ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemosea.llm._common import materialise, read_table

#: Fewest and most pivots; between them, half the root of the number of vectors.
PIVOTS, MOST_PIVOTS = 64, 4096
BLOCK_ROWS = 2048
PACK_QUERIES = 512
#: Rows whose products with all pivots or witnesses are held at once.
TOGETHER = 64
#: Blocks that a task takes for a pack, about: a pack that is sent to more is dealt out among more tasks.
TASK_BLOCKS = 16


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Vectors that are null, or have a null or
    non-finite component, are left out, and so are rows without vec_id."""
    x = lambda e: e.cast("double")
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    sound &= F.forall("embedding", lambda e: F.coalesce(~F.isnan(x(e)) & (F.abs(x(e)) < F.lit(float("inf"))), F.lit(False)))
    return vectors.filter(sound).select("vec_id", F.transform("embedding", lambda e: _floor(x(e) * F.lit(scale))).alias("v"))


def _floor(x):
    """The floor as double; from 2 ** 52 on a double is whole already, and a long would not hold all of them."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled with zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(sizes), width))
    values = np.asarray(column.flatten())
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = values
    return out


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    if len(q) and len(d) and np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * q.shape[1] >= 2.0**53:
        return np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in d] for x in q], dtype=object)
    return q @ d.T


def _long(x: np.ndarray) -> np.ndarray:
    """Scores as long; those beyond its range count as its ends."""
    if x.dtype != object:
        return x.astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in x.ravel()], np.int64).reshape(x.shape)


def _floor_of(score: np.ndarray | int) -> np.ndarray:
    """A double that is not above the score, which from 2 ** 53 on need not be a double itself."""
    x = np.asarray(score, np.float64)
    return np.where(np.abs(x) < 2.0**53, x, np.nextafter(x, -np.inf))


def _floors(q: np.ndarray, ids: np.ndarray, w: np.ndarray, w_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the witnesses (or a little less), some queries at a time."""
    out = np.full(len(q), -np.inf)
    for i in range(0, len(q) if len(w) >= k else 0, TOGETHER):
        own = slice(i, i + TOGETHER)
        seen = _floor_of(_long(_products(q[own], w)))
        seen[ids[own, None] == w_ids[None]] = -np.inf
        seen.partition(len(w) - k, axis=1)
        out[own] = seen[:, -k]
    return out


class _Best:
    """The best k so far for each query of a pack."""

    def __init__(self, row: dict, kind, width: int, k: int):
        self.k, self.q_ids = k, np.frombuffer(row["q_ids"], np.int64)
        self.q = np.frombuffer(row["q"], kind).reshape(-1, width).astype(np.float64)
        self.floor = np.frombuffer(row["floor"], np.float64).copy()
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.q_ids]

    def meet(self, d_ids: np.ndarray, d: np.ndarray) -> None:
        s = _products(self.q, d)
        s = _long(s) if s.dtype == object else s
        for j in np.flatnonzero((s >= self.floor[:, None]).any(1)).tolist():
            good = np.flatnonzero((s[j] >= self.floor[j]) & (d_ids != self.q_ids[j]))
            ids = np.concatenate([self.found[j][0], d_ids[good]])
            score = np.concatenate([self.found[j][1], _long(s[j][good])])
            best = np.lexsort((ids, -score))[: self.k]
            self.found[j] = ids[best], score[best]
            if len(best) == self.k:
                self.floor[j] = max(self.floor[j], float(_floor_of(score[best[-1]])))

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(self.q_ids, [len(ids) for ids, _ in self.found])
        ids, score = (np.concatenate([f[c] for f in self.found]) if self.found else np.zeros(0, np.int64) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def voronoi_top_k(vectors: DataFrame, is_query, *, k: int = 20, pivots: int | None = None, routes: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds the k best other rows.

    ``vectors`` has vec_id and embedding; other columns don't matter. Ties go to the smaller
    vec_id. Vectors of different lengths are compared as if filled up with zeros. Rows that
    repeat a vec_id are all candidates, but never of a query with that id. Fewer rows than k
    give what there is; an empty table, or one vector alone, gives no rows. ``routes`` gets a pair: how many
    (pack, block) pairs are compared, and how many there are.
    """
    spark = vectors.sparkSession
    data = materialise(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "knn-vectors")
    width, largest, n = data.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.count(F.lit(1))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], schema)
    kind = np.int16 if (largest or 0) < 1 << 15 else np.float64  # of the components in packs and blocks
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n) // 2))
    seeds = data.orderBy(F.xxhash64(F.lit(2), "vec_id"), "vec_id").limit(pivots).collect()  # bounded by ``pivots``
    p = np.zeros((len(seeds), width))
    for row, s in zip(p, seeds, strict=True):
        row[: len(s["v"])] = s["v"]
    p = np.unique(p, axis=0)

    half = (p**2).sum(1) / 2

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            # The nearest pivot has the largest x . p - p . p / 2.
            cell = np.concatenate([(x[i : i + TOGETHER] @ p.T - half).argmax(1) for i in range(0, len(x), TOGETHER)] or [np.zeros(0, np.int64)])
            far = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "row", "cell", "far"])

    data = materialise(data.mapInArrow(assign, "vec_id long, v array<double>, row long, cell int, far double"), "knn-cells")
    cells = {r["cell"]: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}  # a row for each pivot
    near = Window.partitionBy("cell").orderBy("far", "vec_id")
    witnesses = data.withColumn("w", F.row_number().over(near)).filter(F.col("w") <= k + 1).select("vec_id", "v").collect()  # k + 1 for each pivot
    w_ids = np.array([r["vec_id"] for r in witnesses])
    w = np.zeros((len(witnesses), width))
    for row, r in zip(w, witnesses, strict=True):
        row[: len(r["v"])] = r["v"]
    used = sorted(cells)
    radius = np.array([cells[c]["radius"] for c in used]) * (1 + 1e-9) + 1e-9
    blocks = {c: -(-cells[c]["n"] // BLOCK_ROWS) for c in used}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for c in used for x in (c, blocks[c])]), F.col("cell"))

    def packed(by: str, size: int):
        def run(key, table):
            table = table.combine_chunks()
            order = np.argsort(np.asarray(table["vec_id"]), kind="stable")
            ids = np.asarray(table["vec_id"])[order]
            x = _matrix(table["v"].chunk(0), width)[order]
            return pa.table({by: pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.astype(kind).tobytes()], pa.binary())})

        return run

    block = data.withColumn("block", F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.lit(7), "row"), n_blocks))
    block = materialise(block.groupBy("block").applyInArrow(packed("block", BLOCK_ROWS), "block long, ids binary, x binary"), "knn-blocks")
    queries = data.filter(is_query)
    counts = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], schema)
    # Groups of neighbouring pivots share a pack while they fit in one.
    pack_of, room, number = [], 0, 0
    for c in sorted(counts, key=lambda c: tuple(p[c])):
        own = -(-counts[c] // PACK_QUERIES)
        if own > 1 or room < counts[c]:
            number, room = number + 1, PACK_QUERIES
        pack_of += [F.lit(c), F.struct(F.lit(number).cast("long").alias("at"), F.lit(own).alias("own"))]
        room = room - counts[c] if own == 1 else 0
        number += own - 1
    at = F.element_at(F.create_map(*pack_of), F.col("cell"))
    pack = queries.withColumn("pack", at["at"] + F.pmod(F.xxhash64(F.lit(9), "row"), at["own"]))
    pack = pack.groupBy("pack").applyInArrow(packed("pack", PACK_QUERIES), "pack long, ids binary, x binary")

    def routed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["x"], kind).reshape(-1, width).astype(np.float64)
                floor = _floors(q, ids, w, w_ids, k)
                ceiling = q @ p[used].T + np.sqrt((q**2).sum(1))[:, None] * radius[None]
                slack = 1e-6 * (1 + np.abs(floor))
                need = ~(ceiling < (floor - slack)[:, None]).all(0)  # a ceiling that overflows is no reason to leave a cell out
                to = [c * (1 << 32) + b for c, yes in zip(used, need.tolist(), strict=True) if yes for b in range(blocks[c])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["pack"]], pa.int64()), pa.array([row["ids"]], pa.binary()), pa.array([row["x"]], pa.binary()), pa.array([floor.tobytes()], pa.binary()), pa.array([to], pa.list_(pa.int64()))],
                    names=["pack", "q_ids", "q", "floor", "to"],
                )

    pack = materialise(pack.mapInArrow(routed, "pack long, q_ids binary, q binary, floor binary, to array<long>"), "knn-packs")
    if routes is not None:
        sent, packs = pack.agg(F.sum(F.size("to")), F.count(F.lit(1))).first()
        routes.append((sent, packs * sum(blocks.values())))
    # A task takes the blocks of a pack's part one after another and keeps the best so far, so it
    # returns k rows for each query, however many blocks there are.
    parts_of = F.greatest(F.lit(1), F.ceil(F.size("to") / TASK_BLOCKS)).cast("int")
    parts = pack.select("pack", parts_of.alias("n"), F.explode("to").alias("block")).select("pack", "block", F.pmod(F.xxhash64("block"), F.col("n")).cast("long").alias("part"))
    sent = block.join(parts, "block").select(F.col("pack").alias("of"), F.col("part").alias("share"), F.col("ids").alias("d_ids"), F.col("x").alias("d"))
    held = pack.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts_of - 1).cast("long")))).drop("to")
    pairs = sent.join(held.hint("merge"), (F.col("of") == F.col("pack")) & (F.col("share") == F.col("part")))
    pairs = pairs.select("pack", "part", "q_ids", "q", "floor", "d_ids", "d").sortWithinPartitions("pack", "part")

    def solved(batches):
        now, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if now != (row["pack"], row["part"]):
                    if state:
                        yield state.rows()
                    now, state = (row["pack"], row["part"]), _Best(row, kind, width, k)
                state.meet(np.frombuffer(row["d_ids"], np.int64), np.frombuffer(row["d"], kind).reshape(-1, width).astype(np.float64))
        if state:
            yield state.rows()

    found = pairs.mapInArrow(solved, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_knn_join(spark, sf_dir):
    """The 20 best of all vectors for every vector whose vec_id is divisible by 20."""
    return voronoi_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL_OP2 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
