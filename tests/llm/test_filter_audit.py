"""The filter audit against documents that pass the filters one by one."""

from itertools import permutations

import pytest

from mnemosea.llm import entries, filter_audit

WORD_BREAKS = "".join(map(chr, [*range(9, 14), 32]))


def fails(docs):
    """For each (doc_id, text, lang) row the letters of the filters it fails."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        words = "".join(" " if c in WORD_BREAKS else c for c in t).split(" ")
        words = [w for w in words if w]
        own = {"A"} if len(words) < 100 else set()
        own |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        own |= {"D"} if set(t) & set("#$%&*|") else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        out.append(own)
    return out


def by_hand(docs, labels):
    failed = fails(docs)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = {}
    for part in {lang or "" for _, _, lang in docs}:
        own = [(i, f) for (i, _, lang), f in zip(docs, failed, strict=True) if (lang or "") == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, stay = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                totals[x] += len(gone)
                rows[part, order, step] = [len(stay), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = stay
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                rows[part, order, step].append(totals[x])
    return {k: tuple(v) for k, v in rows.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {tuple(r)[:3]: tuple(r)[3:] for r in got}, len(got)


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{k}" for k in range(120))
    texts = [long, long + " #", "ab " * 150, "ABC", "", None, "A\tB C", long.upper(), "X" * 50000 + " *", "&", "fine"]
    docs = [(k, texts[k % len(texts)], ["en", "fr", None, ""][k % 4]) for k in range(60)]
    docs += [(3, "ABC", "en"), (70, "only one", "de"), (None, "fine", "en"), (None, long, "fr"), (-5, long, "fr"), (71, "only two", None), (71, "only two", None)]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(40)] + [(1, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 0)]
    return docs, labels


def test_equals_documents_sent_through_one_by_one(spark, rows):
    got, n = audited(spark, *rows)
    assert n == len(got) and got == by_hand(*rows)


def test_parts_that_a_task_hands_on_early(spark, rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 2)
    got, _ = audited(spark, *rows)
    assert got == by_hand(*rows)


def test_empty_tables(spark, rows):
    assert audited(spark, [], rows[1]) == ({}, 0)
    got, _ = audited(spark, rows[0], [])
    assert got == by_hand(rows[0], [])


def test_columns_beside_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 9, "x"), (2, "a b", "en", 9, "x")], "doc_id long, text string, lang string, n int, mask string")
    labels = spark.createDataFrame([(1, 1, 0, "en")], "doc_id long, quality int, toxic int, lang string")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    # The first fails A alone; the second A and E, of which either removes it in half of all orders.
    assert got["ABCDE", 1] == (0, 2, 0, 1, 1, 0, 180) and got["EABCD", 1] == (1, 1, 0, 0, 0, 0, 60)


def test_the_table_of_first_failures():
    for mask in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            first = filter_audit.FIRST_FAILURE[mask, k]
            assert first == next((s for s, x in enumerate(order) if mask >> "ABCDE".index(x) & 1), 5)


def test_the_query_takes_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in entries.QUERIES["op12_filter_audit"](spark, sf).collect()}
    assert got == by_hand(docs, labels)
