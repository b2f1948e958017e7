"""How five document filters interact, in every order of applying them.

A document fails some of the filters: a set out of 32. A table of 32 sets by 120 orders holds the first step at which
a document with that set goes. Tasks look their documents up in it and count by part, order and step; the arrays of all tasks are
summed. A text that many documents share is met once for each part and label, with its count, and never as pairs.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemosea.llm._common import read_table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: For each order and step the number of its filter.
FILTER_AT = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
#: For each set of failed filters (bit k: filter k) and each order, the first step that fails, from 0; 5 if none does.
FIRST_FAILURE = np.array([[next((s for s, f in enumerate(own) if mask >> f & 1), len(FILTERS)) for own in FILTER_AT] for mask in range(1 << len(FILTERS))])
WORDS = r"[\x20\x09-\x0D]+"
MEASURES = ("documents", "failing", "alone", "removed", "good_lost", "toxic_lost")
#: Parts whose arrays a task holds before it hands them on.
HELD = 500


def failures(text: Column) -> Column:
    """Filters A to D that the text fails, as bits 0 to 3; a null text counts as empty. Filter E (bit 4) needs all texts."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of ``mask``.

    Copies are counted before they are shuffled, and the smallest doc_id of a text is found among those counts.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_key"), failures(F.col("text")).alias("mask"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = own.join(marks, "doc_id", "left").select("doc_id", "text_key", "mask", "part", *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")])
    same = ["text_key", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    nameless = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    groups = by_id.groupBy(*same).agg(F.sum("n").alias("n"), nameless.alias("nameless"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    # A text has a row for each part and label at most here.
    first = F.min("first").over(Window.partitionBy("text_key"))
    original = F.col("nameless") + F.when(F.col("first") == first, F.col("n_first")).otherwise(0)
    split = groups.withColumn("original", original).select("mask", "part", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("original").alias("n")), F.struct(F.lit(16).alias("copy"), (F.col("n") - F.col("original")).alias("n")))).alias("x"))
    return split.filter("x.n > 0").select("part", (F.col("mask") + F.col("x.copy")).alias("mask"), "good", "toxic", F.col("x.n").alias("n"))


def _arrays(parts: list[str], histogram: np.ndarray) -> pa.RecordBatch:
    """The counts of each part by order and step, from its documents by mask, good and toxic."""
    steps, columns = len(FILTERS) + 1, {m: [] for m in MEASURES}
    place = np.arange(len(ORDERS)) * steps + FIRST_FAILURE  # mask x order

    def removed(counts: np.ndarray) -> np.ndarray:
        by = np.bincount(place.ravel(), np.repeat(counts, len(ORDERS)), len(ORDERS) * steps)
        return by.reshape(len(ORDERS), steps)[:, : len(FILTERS)].ravel()

    masks = np.arange(32)
    for h in histogram.reshape(len(parts), 32, 2, 2):
        counts = h.sum((1, 2))
        failing = np.array([counts[masks >> f & 1 == 1].sum() for f in range(len(FILTERS))])
        for m, x in zip(MEASURES, (np.full(FILTER_AT.size, counts.sum()), failing[FILTER_AT].ravel(), counts[1 << FILTER_AT].ravel(), removed(counts), removed(h[:, 1].sum(1)), removed(h[:, :, 1].sum(1))), strict=True):
            columns[m].append(np.rint(x).astype(np.int64))
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * FILTER_AT.size), pa.array(np.concatenate(columns[m]))) for m in MEASURES]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *lists], names=["part", *MEASURES])


def _counted(batches):
    seen: dict[str, int] = {}
    total = np.zeros(0)
    for batch in batches:
        names, code = np.unique(np.asarray(batch.column("part").to_pylist(), object), return_inverse=True)
        number = np.array([seen.setdefault(p, len(seen)) for p in names.tolist()], np.int64)
        slot = ((number[code] * 32 + np.asarray(batch.column("mask"))) * 2 + np.asarray(batch.column("good"))) * 2 + np.asarray(batch.column("toxic"))
        more = np.bincount(slot, np.asarray(batch.column("n"), np.float64), len(seen) * 128)
        more[: len(total)] += total
        total = more
        if len(seen) >= HELD:
            yield from _handed_on(seen, total)
            seen, total = {}, np.zeros(0)
    yield from _handed_on(seen, total)


def _handed_on(seen: dict[str, int], total: np.ndarray):
    names = list(seen)
    for k in range(0, len(names), HELD):
        some = names[k : k + HELD]
        yield _arrays(some, total[k * 128 : (k + len(some)) * 128])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order and step.

    - Parts are the values of ``lang``; a null one is the part ''. An empty table has no parts and so no rows.
    - A null text counts as empty. Rows that repeat doc_id and text are documents of their own with one fate; a document fails E if a smaller
      doc_id has its text. A row without a doc_id never fails E and makes no other fail.
    - Labels: a document is good (toxic) if any of its label rows says quality (toxic) 1; rows without doc_id don't count.
    - Very long texts are read whole; other columns are not looked at.
    """
    arrays = failure_counts(docs, labels).mapInArrow(_counted, "part string, " + ", ".join(f"{m} array<long>" for m in MEASURES))
    steps = len(FILTERS)
    cells = arrays.select("part", F.posexplode(F.arrays_zip(*MEASURES)).alias("place", "x")).groupBy("part", "place").agg(*[F.sum(f"x.{m}").alias(m) for m in MEASURES])
    orders = F.array(*[F.lit(o) for o in ORDERS])
    cells = cells.withColumns({"filter_order": F.element_at(orders, (F.col("place") / steps).cast("int") + 1), "step": F.col("place") % steps + 1})
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    overall = F.sum("removed").over(Window.partitionBy("part", letter))
    return cells.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("documents") - so_far).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"), "good_lost", "toxic_lost", overall.alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir):
    """All documents through all 120 orders of the five filters."""
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SQL_OP12 = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
 regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f FROM words LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, good, toxic, f, count(*) AS n FROM failed GROUP BY ALL),
orders AS (SELECT letter AS o FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) UNION ALL SELECT o || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(o, letter)),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS s FROM orders WHERE length(o) = 5),
met AS (SELECT part, good, toxic, n, o, s, f[ascii(o[s]) - 64] AS fails, len(list_filter(range(1, s), lambda k: f[ascii(o[k]) - 64])) > 0 AS before, len(list_filter(f, lambda x: x)) = 1 AS single FROM counted, steps),
sums AS (SELECT part, o, s, sum(CASE WHEN NOT fails AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND before THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN fails AND single THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT before AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT before AND toxic THEN n ELSE 0 END) AS toxic_lost FROM met GROUP BY part, o, s)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, o[s]))::BIGINT AS shapley FROM sums
"""
