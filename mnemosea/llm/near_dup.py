"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document's set is its distinct word shingles (64-bit hashes). Its sketch cuts the
hash range into buckets; each bucket keeps of its smallest hash only the number of
leading zeros and the top mantissa bits, 16 bits in all. An empty bucket takes over
the register of another one, in an order fixed for each bucket. Registers are banded
four by four, and one band is exactly one 64-bit key.

1. Documents with the same set form a class; all that follows works on classes.
2. Band keys are sorted, and equal keys make a run. Short runs give their pairs. Longer runs go as a
   whole to tasks that hold a bounded number of bytes. Keys with more classes than a task holds are hot and never
   come together: of a sample of each, the class that agrees most with the others is its leader, and every
   class is compared with one leader of its keys. Classes that are linked with the same leader need no comparison
   with each other. One that is not is compared with those of a leader only if its own estimate with that leader allows
   a link with one of them (distances of sets obey the triangle inequality), in tasks for a block of either side. What no
   leader links gets new leaders, some times over; the rest is compared block by block, so that no link is lost.
3. Pairs whose collision-corrected estimate is six standard deviations or more below
   the threshold are dropped. The others are confirmed on their full sets.
   A task on a long run gives a spanning forest of its links and not all of them.
4. Components come from alternating large-star and small-star steps on the links.

With 32 bands of 4 registers, a pair at a similarity of 0.85 shares no band with
a chance of (1 - 0.85 ** 4) ** 32 = 6e-11, and one of 0.8 with 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemosea.llm._common import encoded, lowered_words, materialise, mixed, read_table, sliced

BUCKETS, MANTISSA, BAND = 128, 10, 4
_VALUE_BITS = 57  # of a 64-bit hash below the 7 bits that choose the bucket
#: A run of more classes than this is compared in tasks of its own.
SHORT_RUN = 12
#: Classes, and shingles in all of them, that a block of a long run has at most, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 2_000_000
#: Bits, in powers of two, of the filter that spares documents without a candidate the second pass: eight for each needed class within these.
FILTER_BITS = 16, 28
#: Rounds of leaders, and classes of which a leader is chosen.
ROUNDS, SAMPLE = 3, 64

_rng = np.random.default_rng(8)
#: The order in which an empty bucket looks for a register to take over.
_DONORS = np.array([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text with fewer than ``width``
    words has its whole sequence as its one shingle; one without words has none."""
    words, offsets = lowered_words(texts)
    distinct, codes = encoded(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes]
    grams = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)]
        grams = mixed(grams)
    out = []
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if j - i >= width:
            s = np.sort(grams[i : j - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif j > i:
            h = xxhash.xxh3_64_intdigest(hashes[i:j].tobytes(), seed=j - i)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_BOUNDS = (np.arange(BUCKETS + 1, dtype=object) << _VALUE_BITS)[:-1].astype(np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The registers of a non-empty sorted set, as uint16."""
    at = np.append(np.searchsorted(s, _BOUNDS), len(s))
    full = at[:-1] < at[1:]
    low = s[np.minimum(at[:-1], len(s) - 1)] & np.uint64((1 << _VALUE_BITS) - 1)
    fraction, exponent = np.frexp(low.astype(np.float64))
    mantissa = np.floor((fraction * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.uint16)
    registers = ((_VALUE_BITS - exponent).clip(0, 63).astype(np.uint16) << MANTISSA) | mantissa
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _DONORS[empty]
        registers[empty] = registers[order[np.arange(len(empty)), full[order].argmax(1)]]
    return registers


def collision_rate(n: np.ndarray) -> np.ndarray:
    """Chance that two registers of sets of about ``n`` shingles agree though their hashes differ."""
    sizes = 2.0 ** np.arange(0, 41)
    if not hasattr(collision_rate, "table"):
        lead = np.repeat(np.arange(1, 60), 1 << 6)
        part = np.tile(np.arange(1 << 6), 59)
        low = (1 + part / (1 << 6)) * 2.0**-lead
        wide = 2.0**-lead / (1 << 6)
        table = []
        for x in sizes:
            own = np.maximum(x / BUCKETS, 1.0)
            p = np.exp(own * np.log1p(-low)) - np.exp(own * np.log1p(-np.minimum(low + wide, 1 - 1e-16)))
            table.append((p**2).sum() / (1 << (MANTISSA - 6)))
        collision_rate.table = np.array(table)
    return np.interp(np.log2(np.maximum(n, 1)), np.arange(41), collision_rate.table)


def estimate(equal: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for collisions."""
    c = collision_rate(n)
    return (equal - c) / (1 - c)


def may_link(equal: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    own = np.minimum(np.maximum(n, 1), BUCKETS) * 0.6  # taken-over registers say nothing new
    return estimate(equal, n) >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / own)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def forest(ids: np.ndarray, sets: list[np.ndarray], cross: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the given sets; with ``cross``, the number of
    each set's block, only links between different blocks are looked for."""
    n = len(sets)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    registers = np.array([sketch(s) for s in sets])
    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        root[root == root[j]] = root[i]
        out.append((int(ids[i]), int(ids[j])))

    # The set nearest to what most registers say comes first: it links most of the others.
    common = np.array([np.bincount(np.unique(c, return_inverse=True)[1]).max() for c in registers.T])
    likely = np.zeros(n)
    for k in np.argsort(-common)[:64]:
        value, count = np.unique(registers[:, k], return_counts=True)
        likely += registers[:, k] == value[count.argmax()]
    for i in np.argsort(-likely, kind="stable"):
        rest = root != root[i]
        if cross is not None:
            rest &= cross != cross[i]
        rest &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (ids != ids[i])
        at = np.flatnonzero(rest)
        if len(at):
            equal = (registers[at] == registers[i]).mean(1)
            at = at[may_link(equal, (sizes[at] + sizes[i]) / 2, percent / 100)]
        for j in at:
            if root[j] != root[i] and linked(sets[i], sets[j], percent):
                join(int(i), int(j))
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots, which are the smallest
    nodes of their components. Each step is written, and the loop ends when a step changes nothing."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(edges.join(least, F.col("a") == F.col("u")).select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        large = materialise(large, "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        moved = large.join(least, F.col("a") == F.col("u"))
        small = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        edges = materialise(small.distinct(), "cc")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, hashed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; component_id is the smallest doc_id that links reach.
    Null and empty texts, and texts of spaces, have no shingles and stay alone. Rows
    that repeat a doc_id with its text are all kept if that id is its component's; a
    null doc_id is never the smallest, and texts that occur under null ids only are
    linked with their copies only. An empty table gives no rows. Other columns don't matter.
    With ``hashed``, text_hash says which text of its doc_id a row is about.
    """
    spark = docs.sparkSession
    more = ["text_hash"] if hashed else []
    docs = docs.select("doc_id", "text", *[F.xxhash64("text").alias(c) for c in more])

    def signatures(batches):
        for batch in sliced(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            node = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            registers = [sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(node, pa.int64()), pa.array(registers, pa.binary()), *[batch.column(c) for c in more]],
                names=["doc_id", "n", "node", "registers", *more],
            )

    signed = materialise(docs.mapInArrow(signatures, ", ".join(["doc_id long, n long, node long, registers binary", *[f"{c} long" for c in more]])), "dup-signed")
    classes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = materialise(classes, "dup-classes")

    def bands(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            keys = mixed(keys ^ mixed(np.arange(1, keys.shape[1] + 1).astype(np.uint64)))
            node = np.repeat(np.asarray(batch.column("node")), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    banded = classes.filter("rep is not null").select("node", "registers").mapInArrow(bands, "key long, node long")
    # Keys are counted before they are shuffled; those with more classes than a task holds don't come together.
    hot = materialise(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_CLASSES).select("key"), "dup-hot")
    is_hot = bool(hot.head(1))
    runs = materialise(_runs(banded.join(hot, "key", "left_anti") if is_hot else banded), "dup-runs")
    crowd = materialise(banded.join(hot, "key", "left_semi"), "dup-crowd") if is_hot else None

    pairs = runs.filter("b is not null").select("a", "b").distinct()
    sketches = classes.select("node", "n", "registers")
    pairs = pairs.join(sketches.withColumnsRenamed({"node": "a", "n": "na", "registers": "ra"}), "a").join(sketches.withColumnsRenamed({"node": "b", "n": "nb", "registers": "rb"}), "b")

    def filtered(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            good = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & may_link((ra == rb).mean(1), (na + nb) / 2, percent / 100)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    pairs = materialise(pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(filtered, "a long, b long"), "dup-pairs")

    tasks = materialise(_block_tasks(runs.filter("b is null").select(F.col("key"), F.col("a").alias("node")), sketches), "dup-tasks")

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select("b").toDF("node")).unionByName(tasks.select("node"))
    if is_hot:
        needed = needed.unionByName(crowd.select("node"))
    needed = needed.distinct()
    needed = materialise(needed.join(classes.select("node", "rep"), "node"), "dup-needed")
    sets = materialise(_needed_sets(docs, needed, width).join(needed.select("node"), "node", "left_semi"), "dup-sets")

    def confirmed(batches):
        for batch in batches:
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def confirm(some: DataFrame) -> DataFrame:
        both = some.join(sets.withColumnsRenamed({"node": "a", "hashes": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "hashes": "sb"}), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(confirmed, "a long, b long")

    def compared(key, table):
        ids = np.asarray(table["node"])
        own = np.asarray(table["own"])
        found = forest(ids, [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()], own if len(np.unique(own)) > 1 else None, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    def compare(some: DataFrame) -> DataFrame:
        return some.join(sets, "node").select("task", "node", "own", "hashes").groupBy("task").applyInArrow(compared, "a long, b long")

    links = confirm(pairs).unionByName(compare(tasks))
    rest = crowd
    for _ in range(ROUNDS if is_hot else 0):
        own, direct, cross, rest = _round(rest, sketches, confirm, percent)
        links = links.unionByName(direct.select("a", "b")).unionByName(compare(cross))
        if not rest.groupBy("key").count().filter(F.col("count") > BLOCK_CLASSES).head(1):
            break
    if is_hot:
        links = links.unionByName(compare(materialise(_block_tasks(rest, sketches), "dup-tasks")))

    roots = components(links)
    of = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = materialise(of, "dup-roots")
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "root").select(F.col("node").alias("of"), "component_id")
    rows = signed.select("doc_id", "n", "node", *more).join(of, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more)


def _block_tasks(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, own, task) that compare all members (key, node) of each key, a block of them with a block. Keys of equal members
    are compared once."""
    plan = members.join(sketches.select("node", "n"), "node").groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
    plan = plan.filter("g > 1").groupBy("g", "total", "same").agg(F.min("key").alias("run"))
    plan = plan.select("run", _blocks(F.col("g"), F.col("total")).alias("blocks"))
    tasks = members.join(plan, F.col("key") == F.col("run")).withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return tasks.withColumn("other", other).select("node", "own", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"))


def _blocks(classes, shingles):
    return F.greatest(F.lit(1), F.ceil(classes / BLOCK_CLASSES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _round(rest: DataFrame, sketches: DataFrame, confirm, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round of leaders for the members (key, node) of hot keys: each node's leader, confirmed links with leaders (a: the
    node, b: the leader), tasks that compare the others with classes of a leader, and the members that no leader links."""

    def best(key, table):
        registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
        agree = np.array([(registers == r).sum() for r in registers])
        nodes = np.asarray(table["node"])
        return pa.table({"key": pa.array([key[0].as_py()]), "leader": pa.array([int(nodes[np.lexsort((nodes, -agree))[0]])])})

    place = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node")
    sample = rest.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= SAMPLE).select("key", "node")
    leaders = sample.join(sketches.select("node", "registers"), "node").select("key", "node", "registers").groupBy("key").applyInArrow(best, "key long, leader long")
    lead = materialise(rest.join(leaders, "key").groupBy("node").agg(F.min("leader").alias("leader")), "dup-lead")
    direct = materialise(confirm(lead.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))), "dup-direct")
    settled = direct.select(F.col("a").alias("node"), F.col("b").alias("leader")).unionByName(lead.filter("node = leader"))
    inside = rest.join(settled, "node")
    outside = materialise(rest.join(settled.select("node"), "node", "left_anti"), "dup-rest")

    # Who is not linked with a leader may still be linked with a class that is, if it is near enough to the leader. That is
    # asked once for a class and a leader, however many keys bring them together.
    meets = outside.join(inside.select("key", "leader").distinct(), "key").select("node", "leader").distinct().join(sketches.withColumnsRenamed({"n": "na", "registers": "ra"}), "node")
    meets = meets.join(sketches.select(F.col("node").alias("leader"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "leader")

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            good = may_link((ra == rb).mean(1), (na + nb) / 2, max(0.05, 2 * percent / 100 - 1))
            yield batch.select(["leader", "node"]).filter(pa.array(good))

    ring = materialise(meets.select("leader", "node", "na", "nb", "ra", "rb").mapInArrow(near, "leader long, node long"), "dup-ring")
    around = settled.join(ring.select("leader").distinct(), "leader", "left_semi").select("leader", "node")
    sides = ring.withColumn("own", F.lit(0)).unionByName(around.withColumn("own", F.lit(1))).join(sketches.select("node", "n"), "node")
    mine = lambda k, c: F.sum(F.when(F.col("own") == k, c).otherwise(0))
    plan = sides.groupBy("leader").agg(_blocks(mine(0, F.lit(1)), mine(0, F.col("n"))).alias("b0"), _blocks(mine(1, F.lit(1)), mine(1, F.col("n"))).alias("b1"))
    placed = sides.select("leader", "node", "own").join(plan, "leader")
    block = F.pmod(F.xxhash64("node", "leader"), F.when(F.col("own") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("own") == 0, F.col("b1")).otherwise(F.col("b0")) - 1))
    placed = placed.withColumn("block", block).withColumn("other", others)
    first, second = F.when(F.col("own") == 0, F.col("block")).otherwise(F.col("other")), F.when(F.col("own") == 0, F.col("other")).otherwise(F.col("block"))
    cross = placed.select("node", "own", F.xxhash64("leader", first, second).alias("task"))
    return lead, direct, materialise(cross, "dup-cross"), outside


def _runs(banded: DataFrame) -> DataFrame:
    """Pairs (a, b) of short runs; members (key, a) of long ones. Each task reads its keys in
    order and holds no more than a short run and a batch."""

    def scan(batches):
        held_keys, held_nodes, long_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _with_end(batches):
            last = batch is None
            keys = held_keys if last else np.concatenate([held_keys, np.asarray(batch.column("key"))])
            nodes = held_nodes if last else np.concatenate([held_nodes, np.asarray(batch.column("node"))])
            if not len(keys):
                continue
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            end = np.append(begin[1:], len(keys))
            size = end - begin
            stop = len(keys)
            if not last:  # the last run may go on: hold it back unless it is long already
                if size[-1] <= SHORT_RUN and keys[-1] != long_key:
                    stop = begin[-1]
                    begin, end, size = begin[:-1], end[:-1], size[:-1]
            is_long = size > SHORT_RUN
            if long_key is not None and len(begin) and keys[begin[0]] == long_key:
                is_long[0] = True
            out_key, out_a, out_b = [], [], []
            at = np.repeat(is_long, size)
            out_key.append(keys[:stop][at])
            out_a.append(nodes[:stop][at])
            out_b.append(np.full(int(at.sum()), None))
            for g in range(2, SHORT_RUN + 1):
                first = begin[(size == g) & ~is_long]
                for i in range(g if len(first) else 0):
                    for j in range(i + 1, g):
                        x, y = nodes[first + i], nodes[first + j]
                        out_key.append(keys[first])
                        out_a.append(np.minimum(x, y))
                        out_b.append(np.maximum(x, y))
            long_key = keys[stop - 1] if len(is_long) and is_long[-1] and stop == len(keys) else None
            held_keys, held_nodes = keys[stop:], nodes[stop:]
            # Equal pairs of one task's keys are given once.
            n_long = len(out_key[0])
            a = np.concatenate([out_a[0], *out_a[1:]])
            if len(out_a) > 1:
                pair = np.unique(np.stack([np.concatenate(out_a[1:]), np.concatenate(out_b[1:]).astype(np.int64)], 1), axis=0)
            else:
                pair = np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([out_key[0], np.zeros(len(pair), np.int64)])),
                    pa.array(np.concatenate([a[:n_long], pair[:, 0]])),
                    pa.concat_arrays([pa.nulls(n_long, pa.int64()), pa.array(pair[:, 1], pa.int64())]),
                ],
                names=["key", "a", "b"],
            )

    return banded.repartition("key").sortWithinPartitions("key", "node").mapInArrow(scan, "key long, a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def _needed_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the needed classes and of few others. Documents are sifted by a filter
    of bounded size over the ids of the needed classes before any of their words are looked at."""
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * needed.count()).bit_length()))
    slot = F.pmod(F.xxhash64("x"), F.lit(1 << size))
    slots = needed.select(F.col("rep").alias("x")).select(slot.alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("b"))
    full = np.zeros(((1 << size) >> 3) + 8192, np.uint8)
    for row in bits.collect():  # one row for each 32,768 slots at most
        part = np.frombuffer(bytes(row["b"]), np.uint8)
        start = (row["k"] - 1) * 4096 if row["k"] > 0 else 0
        full[start : start + len(part)] |= part

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column("slot"))
            # bitmap_bucket_number counts from 1 for slots from 1 on, and slot 0 is bucket 0's
            position = np.where(at > 0, at - 1, 0)
            wanted = (full[position >> 3] >> (position & 7).astype(np.uint8)) & 1 | (at == 0)
            for own in sliced([batch.filter(pa.array(wanted.astype(bool)))], "text"):
                sets = shingle_sets(own.column("text"), width)
                some = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in some], pa.int64()), pa.array([s.tobytes() for s in some], pa.binary())], names=["node", "hashes"]
                )

    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").alias("x"), "text").select(slot.alias("slot"), "text")
    return keyed.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, without those that near_duplicates() does not keep. A row
    that repeats another's doc_id and text stays once; rows without doc_id are compared with
    each other only, and only for equal texts."""
    found = near_duplicates(docs.filter("doc_id is not null"), hashed=True, **how)
    gone = materialise(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct(), "dup-gone")
    twice = materialise(found.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice")), "dup-twice")
    rows = docs.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("_text")), "left_anti")
    single = rows.join(twice, F.col("doc_id") == F.col("_twice"), "left_anti").filter("doc_id is not null")
    several = rows.join(twice, F.col("doc_id") == F.col("_twice"), "left_semi").unionByName(docs.filter("doc_id is null"))
    return single.unionByName(several.dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def op8_near_dup(spark, sf_dir):
    """All documents, by three-word shingles at 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)
