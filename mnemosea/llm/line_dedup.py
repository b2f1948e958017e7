"""Lines that many documents share are dropped from all of them.

Texts become rows of lines, each with a 128-bit hash of its normalised form. Documents are counted once for
each hash, the hashes of at least ``min_documents`` documents are written to the shared folder, and the lines,
without those, are put together again by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosea.llm._common import materialise, read_table

#: Common lines, of 16 bytes each, that are sent to every task; more are joined by a shuffle.
SENT = 1_000_000
#: Parts of each hash in that shuffle, so that a line that a third of the texts hold meets no single task.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased (other letters stay)."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(docs: DataFrame, text: str, min_chars: int, *columns: Column) -> DataFrame:
    """A row for each line: its place and hashes (null if it is too short to count), and ``columns`` of its document."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = docs.select(*columns, F.posexplode(split).alias("_at", "_line")).withColumn("_key", line_key(F.col("_line")))
    counts = F.length("_key") >= min_chars
    return rows.withColumns({"_h": F.when(counts, F.xxhash64("_key")), "_g": F.when(counts, F.xxhash64(F.lit("line"), "_key"))}).drop("_key")


def documents_of_lines(docs: DataFrame, min_chars: int, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_h, _g, count): how many documents hold each line. The pairs of line and document are made distinct first, on a
    shuffle by both, so a line of very many documents loads no single task."""
    pairs = _lines(docs, text, min_chars, F.col(doc_id).alias("_doc")).filter("_h is not null").select("_h", "_g", "_doc").distinct()
    return pairs.groupBy("_h", "_g").count()


def drop_common_lines(docs: DataFrame, *, min_documents: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id", sent: int = SENT) -> DataFrame:
    """``docs`` with ``text`` made of the lines that stay, ``n_lines`` (before) and ``n_dropped``.

    - A null or empty text is one empty line, which never counts as common (with ``min_chars`` of 1 or more); its text becomes ''.
    - A text of which all lines go becomes ''. Very long texts are lines as any other.
    - Rows that repeat a ``doc_id`` are one document in the counts, rows without one are together one; all rows stay rows.
    - Columns named n_lines and n_dropped are replaced; all others stay. An empty table gives an empty table.

    Rows are numbered as they are read: read ``docs`` from files, so that a task that runs again numbers them alike.
    """
    docs = docs.drop("n_lines", "n_dropped")
    found = documents_of_lines(docs, min_chars, text=text, doc_id=doc_id).filter(F.col("count") >= min_documents).select("_h", "_g")
    common = materialise(found, "common-lines").withColumn("_common", F.lit(True))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = _lines(docs.select(text, others.alias("_others"), F.monotonically_increasing_id().alias("_row")), text, min_chars, F.col("_row"), F.col("_others"))
    # What the document has beside its text travels with its first line.
    rows = rows.withColumn("_others", F.when(F.col("_at") == 0, F.col("_others")))
    if common.count() <= sent:
        rows = rows.join(F.broadcast(common), ["_h", "_g"], "left")
    else:
        salted = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.col("_row") + F.col("_at"), F.lit(SALTS)).cast("int")).join(salted, ["_h", "_g", "_salt"], "left")
    stays = F.when(F.col("_common").isNull(), F.struct("_at", "_line"))
    whole = rows.groupBy("_row").agg(F.first("_others", ignorenulls=True).alias("_others"), F.count(F.lit(1)).alias("n_lines"), F.count("_common").alias("n_dropped"), F.collect_list(stays).alias("_kept"))
    kept = F.array_join(F.transform(F.sort_array("_kept"), lambda x: x["_line"]), "\n")
    back = [kept.alias(c) if c == text else F.col("_others").getField(c).alias(c) for c in docs.columns]
    return whole.select(*back, "n_lines", "n_dropped")


def op11_line_dedup(spark, sf_dir):
    """All documents without the lines that ten documents or more share."""
    kept = drop_common_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL_OP11 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, e' \\t\\n\\x0B\\f\\r'), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (SELECT k, true AS goes FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(goes)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (goes IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""
