"""Line dedup against plain Python."""

import hashlib

import pytest

from mnemosea.llm import entries, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def by_hand(rows, least=10, chars=1):
    """Sorted (doc_id, kept text, lines, dropped) of (doc_id, text) rows."""
    docs = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                docs.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def awkward():
    rows = [(k, f"own {k}\n Shared LINE\t\n\nÉtat commun\nend") for k in range(12)]
    rows += [(k, f"état commun\nown {k}\n\n") for k in range(12, 20)]  # another É, so two different keys
    rows += [(20, None), (21, ""), (22, "\n"), (23, "shared line"), (23, "shared line"), (None, "rare\nshared line"), (None, "rare"), (24, "x\n" * 20000 + "SHARED line"), (25, " end "), (26, "end\r")]
    return rows + [(30 + k % 9, "nine documents hold this\n" * 2) for k in range(18)]


@pytest.mark.parametrize("sent", [line_dedup.SENT, 0])
def test_equals_plain_python_both_ways(spark, sent):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.drop_common_lines(docs, sent=sent).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == by_hand(rows)


def test_other_thresholds(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.drop_common_lines(docs, min_documents=2, min_chars=5).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == by_hand(rows, 2, 5)


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    docs = spark.createDataFrame([(k, "both\nown" + str(k), "x", k * 2, {"a": k}) for k in range(10)], "doc_id long, text string, n_lines string, `a.b` long, _row map<string,long>")
    got = line_dedup.drop_common_lines(docs)
    assert got.columns == ["doc_id", "text", "a.b", "_row", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.select("doc_id", "text", "`a.b`", "_row.a", "n_lines").collect()) == [(k, f"own{k}", 2 * k, k, 2) for k in range(10)]


def test_empty_table(spark):
    assert line_dedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_takes_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in by_hand(docs))
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in entries.QUERIES["op11_line_dedup"](spark, sf).collect())
    assert got == want and any(r[2] for r in got)


def test_the_pairs_are_shuffled_by_line_and_document(spark):
    """A line of all documents is spread over tasks before it is counted."""
    docs = spark.createDataFrame([(1, "same")], "doc_id long, text string")
    plan = line_dedup.documents_of_lines(docs, 1)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert len(shuffles) == 2 and "_doc" in shuffles[-1] and "_doc" not in shuffles[0]
