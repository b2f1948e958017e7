"""Mixing sources to target weights by Pareto order sampling (native DataFrame code).

Every source has a target number of words. A document of source ``s`` is taken
``floor(r)`` certain whole times, ``r`` being target over size of the source; for
the rest of the target a sample is drawn whose size is fixed in words. The draw
ranks the documents of a source by random odds divided by inclusion odds,

    Q = (U / (1 - U)) / (p / (1 - p)),

and takes them in that order until their words reach the rest of the target.
``p = 1 - (1 - f) ** ((size / mean size) ** size_bias)`` is the chance to be drawn
of a document when the fraction ``f`` of its source is wanted: unequal, and within
(0, 1) without a cap. The document at the border is taken if that brings the
source's words nearer to the target.

No task sorts a source: Q is cut into cells, sums of cells are counted before
they are shuffled, and only the documents of the one cell at the border (a
65,536th of the source) are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemosea.llm._common import materialise, read_table

#: Cells of the first and of the second level for each source.
CELLS = 256

_SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.size(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).cast("long")
    return F.when(F.length(trimmed) > 0, words).otherwise(F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source from rows (source, source_size, ...).

    Sources in order of code points, null last, get ``weights`` in turn. They share
    ``share`` times the total size by weight; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight until none is above.
    That fixed point has a closed form over the sources in order of size by
    weight, so two windows over one row per source find it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.greatest((F.col("total") - F.col("capped")) / F.col("open"), F.lit(0.0)))
        .withColumn("level", F.max("level").over(everything))
    )
    # The level rises as long as the sources in front really stop at their caps, and falls after.
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return w.withColumn("target", target).drop("weight", "cap", "total", "capped", "open", "level")


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    size_bias: float = 0.5,
    seed: int = 20,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, row (a hash
    of doc_id and text).

    ``docs`` needs doc_id, text and source; other columns don't matter, whatever
    their names. Null or empty text has size 0 and is taken ``floor(r)`` times, or
    once more if its rank falls within the sample; either way it adds no words.
    Null sources form one source, which comes last. Repeated rows count as
    documents of their own; equal ones tie and share the rank order of the hash.
    An empty table gives no rows. The draw depends on ``seed`` and each row's own
    doc_id and text only, so reruns agree.
    """
    u = (F.shiftrightunsigned("row", 11).cast("double") + 0.5) * F.lit(2.0**-53)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _row_hash(seed).alias("row"))
    rows = materialise(rows.withColumn("u", u), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = (
        source_targets(sizes, weights=weights, share=share, most=most)
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("ratio"))
        .withColumn("part", F.col("ratio") - F.col("whole"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("mean", F.col("source_size") / F.col("n"))
        .withColumnRenamed("source", "of")
    )
    plan = materialise(plan, "mix-plan")  # one row per source: Spark broadcasts it if its file is small
    lean = F.when(F.col("mean") > 0, F.pow(F.col("size") / F.col("mean"), F.lit(float(size_bias)))).otherwise(F.lit(0.0))
    odds = F.expm1(-lean * F.log1p(-F.least(F.col("part"), F.lit(1.0 - 1e-12))))
    # Cells are cut in Q times the mean odds, x / (1 + x) of it, so that they fill evenly whatever the fraction is.
    x = (F.col("u") / (1.0 - F.col("u"))) * (F.col("part") / (1.0 - F.least(F.col("part"), F.lit(1.0 - 1e-12)))) / odds
    place = F.when((F.col("part") > 0) & (odds > 0), F.when(x < 1e300, x / (1.0 + x)).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    ranked = rows.join(plan, _same(rows["source"], plan["of"])).withColumn("place", place)
    cell = F.least(F.floor(F.col("place") * CELLS), F.lit(CELLS - 1))
    cell2 = F.least(F.floor((F.col("place") * CELLS - cell) * CELLS), F.lit(CELLS - 1))
    ranked = ranked.withColumn("cell", cell).withColumn("cell2", cell2)

    cuts = _border(ranked, "cell", F.lit(0).cast("long"))
    cuts = materialise(cuts, "mix-cut").withColumnsRenamed({"of": "of1", "edge": "edge1", "base": "base1"})
    inside = ranked.join(cuts, _same(F.col("of"), F.col("of1")) & (F.col("cell") == F.col("edge1")))
    cuts2 = _border(inside, "cell2", F.first("base1"))
    cuts2 = cuts2.withColumnsRenamed({"of": "of2", "edge": "edge2", "base": "base2"})
    cuts = materialise(cuts.join(cuts2, _same(F.col("of1"), F.col("of2")), "left").drop("of2"), "mix-cuts")

    at = ranked.join(cuts, _same(F.col("of"), F.col("of1")), "left")
    at_edge = (F.col("cell") == F.col("edge1")) & (F.col("cell2") == F.col("edge2"))
    clear = F.when(F.col("edge1").isNull(), True).when(F.col("cell") != F.col("edge1"), F.col("cell") < F.col("edge1")).when(F.col("edge2").isNull(), True).otherwise(F.col("cell2") < F.col("edge2"))
    on_edge = at.filter(at_edge)
    order = Window.partitionBy("of").orderBy("place", "u", "doc_id", "size")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("base2") + run - F.col("size") / 2.0
    on_edge = on_edge.withColumn("more", middle <= F.col("rest"))
    off_edge = at.filter(~F.coalesce(at_edge, F.lit(False))).withColumn("more", clear)
    keep = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "part", "more"]
    both = off_edge.select(*keep).unionByName(on_edge.select(*keep))
    copies = (F.col("whole") + F.when((F.col("part") > 0) & F.col("more"), 1).otherwise(0)).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def repeated_as_mixed(docs: DataFrame, *, seed: int = 20, **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as mix_sources() takes it."""
    copies = mix_sources(docs, seed=seed, **how).groupBy(F.col("row").alias("_of")).agg(F.sum("copies").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.withColumn("_row", _row_hash(seed)).join(copies.filter("_total > 0"), F.col("_row") == F.col("_of"))
    # Rows that repeat doc_id and text share what they are given, the first ones the odd copies.
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    own = F.floor(F.col("_total") / F.col("_rows")) + F.when(nth <= F.col("_total") % F.col("_rows"), 1).otherwise(0)
    rows = rows.withColumn("_own", own.cast("int")).filter("_own > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _border(rows: DataFrame, cell: str, base: Column) -> DataFrame:
    """For each source the first cell by whose end the words exceed the rest of the
    target, and the words before it; no row where the whole source is wanted."""
    sums = rows.groupBy("of", cell).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), base.alias("start"))
    upto = Window.partitionBy("of").orderBy(cell)
    sums = sums.withColumn("after", F.col("start") + F.sum("words").over(upto))
    over = sums.filter(F.col("after") > F.col("rest"))
    edge = F.min(F.struct(F.col(cell), (F.col("after") - F.col("words")).alias("base")))
    return over.groupBy("of").agg(edge.alias("e")).select("of", F.col(f"e.{cell}").alias("edge"), F.col("e.base").alias("base"))


def op1_pareto_mix(spark, sf_dir):
    """All documents mixed with the production weights."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
