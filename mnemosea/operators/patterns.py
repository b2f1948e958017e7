"""Many patterns in many texts: one automaton, one pass over each text.

The patterns of all queries are one automaton (Aho-Corasick), so how long a text takes depends on its length and on what it
contains, not on the number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosea.functions.batches import sliced

#: Bytes of distinct patterns that are sent to every task at once; more are answered in blocks of queries.
PATTERN_BYTES = 8 << 20


def contained(texts: DataFrame, patterns: DataFrame, *, key: str = "unit_id", text: str = "text") -> DataFrame:
    """(query_id, key, matches): how many of each query's distinct patterns a text contains, if any.

    ``texts`` has key and text, ``patterns`` (query_id, pattern). An empty pattern is in every text but a null one; null
    patterns and texts match nothing. Repeated patterns of a query count once, rows that repeat a key stay rows.
    """
    spark = texts.sparkSession
    patterns = patterns.filter(F.col("pattern").isNotNull()).distinct()
    total = patterns.select("pattern").distinct().agg(F.sum(F.octet_length("pattern") + 8)).first()[0] or 0
    blocks = -(-total // PATTERN_BYTES)
    kinds = dict(patterns.dtypes)["query_id"], dict(texts.dtypes)[key]
    out = None
    for block in range(blocks):
        own = patterns if blocks == 1 else patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        made = _searched(texts, own, key, text, kinds)
        out = made if out is None else out.unionByName(made)
    if out is None:
        return spark.createDataFrame([], f"query_id {kinds[0]}, {key} {kinds[1]}, matches long")
    return out if blocks == 1 else out.groupBy("query_id", key).agg(F.sum("matches").alias("matches"))


def _searched(texts: DataFrame, patterns: DataFrame, key: str, text: str, kinds: tuple[str, str]) -> DataFrame:
    found = patterns.groupBy("pattern").agg(F.collect_list("query_id").alias("queries")).toArrow()  # PATTERN_BYTES bound the patterns
    words, owners = found.column("pattern").to_pylist(), found.column("queries").combine_chunks()
    sizes = np.asarray(owners.value_lengths()).astype(np.int64)
    queries, owner = owners.flatten().dictionary_encode(), None
    owner, names = np.asarray(queries.indices).astype(np.int64), queries.dictionary
    begin = np.cumsum(sizes) - sizes
    held = patterns.sparkSession.sparkContext.broadcast((words, sizes, begin, owner, names))

    def run(batches):
        import ahocorasick

        words, sizes, begin, owner, names = held.value
        automaton = ahocorasick.Automaton()
        empty = [k for k, w in enumerate(words) if not w]
        for k, w in enumerate(words):
            if w:
                automaton.add_word(w, k)
        automaton.make_automaton()
        some = len(automaton) > 0
        for batch in sliced(batches, text):
            rows, which, times = [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                if t is None:
                    continue
                hits = {k for _, k in automaton.iter(t)} if some else set()
                hits = np.array([*hits, *empty], np.int64)
                if len(hits):
                    n = sizes[hits]
                    at = np.repeat(begin[hits] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    query, count = np.unique(owner[at], return_counts=True)
                    rows.append(np.full(len(query), i))
                    which.append(query)
                    times.append(count)
            if rows:
                at, query, count = (np.concatenate(x) for x in (rows, which, times))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), batch.column(key).take(pa.array(at)), pa.array(count.astype(np.int64))], names=["query_id", key, "matches"])

    return texts.select(key, text).mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, matches long")
