"""Every operator and every pipeline stage on awkward tables: nulls in any column, empty and long
texts, ties and repeated rows, empty tables, extra columns whose names clash."""

import collections
import glob
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from mnemosea.llm import bpe, entries, knn_join, langid, lm_score, mixing, near_dup, token_output, toxicity, warc, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000 + "ending"
ROWS = [
    (1, "The cat sat on the mat today.", "en", "a", 1),
    (2, "The cat sat on the mat today.", "en", "a", 1),
    (3, "Le chat est sur la table verte.", "fr", "b", 1),
    (3, "Le chat est sur la table verte.", "fr", "b", 1),
    (4, None, "en", "a", None),
    (5, "", None, None, 0),
    (6, " \t\n\x0b\x0c\r ", "en", None, 7),
    (7, LONG, "en", "b", len(LONG)),
    (8, "one", "fr", "a", 3),
    (9, "two words", "fr", "a", 3),
    (None, "no id here at all", "en", "a", 1),
    (None, "no id here at all", "en", None, 1),
    (10, "１２３ 🎉🎉 !!!", None, "b", 1),
    (11, "naïve ÉTÉ Straße <|endoftext|> don't İ Σ", "fr", "b", 1),
]
CLASHES = ("score", "copies", "row", "node", "rank", "ids", "slot", "train", "size", "registers", "_row", "u", "key")


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    return docs.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")


def model(docs):
    return langid.fit(docs, F.lit(True))


OPERATORS = {
    "mix": lambda s, d: mixing.mix_sources(d),
    "language": lambda s, d: langid.identify(d, model(d)),
    "encode": lambda s, d: bpe.decode(bpe.encode(d)),
    "digests": lambda s, d: bpe.digests(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s), F.lit(True))),
    "media": lambda s, d: webp.read_media(webp.to_media(d)),
    "near duplicates": lambda s, d: near_dup.near_duplicates(d, width=3, percent=85),
    "language model": lambda s, d: lm_score.score(d, F.col("doc_id") % 2 == 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(spark, awkward, nothing, name):
    assert len(OPERATORS[name](spark, awkward).collect()) == len(ROWS)
    assert OPERATORS[name](spark, nothing).collect() == []


def test_null_and_empty_texts_have_their_defined_results(spark, awkward):
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(awkward, model(awkward)).collect()}
    assert all(lang[k] == ("und", 0.0) for k in (4, 5, 6)) and lang[1][0] == "en" and lang[10][0] == "und"
    dup = {r.doc_id: r for r in near_dup.near_duplicates(awkward, width=3, percent=85).collect() if r.doc_id is not None}
    assert [(dup[k].n_shingles, dup[k].component_id, dup[k].kept) for k in (4, 5, 6)] == [(0, 4, True), (0, 5, True), (0, 6, True)]
    assert (dup[2].component_id, dup[2].kept, dup[1].kept) == (1, False, True) and dup[8].n_shingles == dup[9].n_shingles == 1
    lm = {r.doc_id: r for r in lm_score.score(awkward, F.col("doc_id") % 2 == 0).collect()}
    assert lm[4].n_tokens == lm[5].n_tokens == lm[6].n_tokens == 1 and lm[7].n_tokens == 30002
    media = {r.doc_id: r for r in webp.read_media(webp.to_media(awkward)).collect()}
    assert (media[4].n_bytes, media[4].payload_bytes) == (media[5].n_bytes, media[5].payload_bytes) == (0, 64)
    ids = {r.doc_id: r for r in bpe.digests(awkward).collect()}
    assert ids[4].n_tokens == ids[5].n_tokens == ids[6].n_tokens == 0
    taken = {r.doc_id: r for r in mixing.mix_sources(awkward).collect() if r.doc_id is not None}
    assert taken[4].size == taken[5].size == taken[6].size == 0 and taken[7].size == 30001


def test_columns_stay_in_operators_that_keep_them(spark, awkward):
    m = model(awkward)
    kept = langid.keep_identified(awkward, m)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 7}
    clean = toxicity.drop_toxic(awkward, toxicity.fit(awkward, labels(spark), F.lit(True)))
    assert clean.columns == awkward.columns
    one = near_dup.keep_one_of_each(awkward, width=5, percent=80)
    rows = one.collect()
    assert one.columns == awkward.columns and sorted(r.doc_id for r in rows if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11] and sum(r.doc_id is None for r in rows) == 1
    mixed = mixing.repeated_as_mixed(awkward)
    assert mixed.columns == awkward.columns
    want = mixing.mix_sources(awkward).agg(F.sum("copies")).first()[0]
    assert mixed.count() == want


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language ID", "toxicity", "near-duplicates", "mixing", "BPE"]
    for name, f in stage.items():
        none = f(spark, nothing, str(tmp_path))
        assert none.collect() == [] and (name == "BPE" or none.columns == nothing.columns)
    ids = lambda rows: collections.Counter(r.doc_id for r in rows)
    every = ids(awkward.collect())
    # Texts without a letter go; repeated rows, long texts and rows without an id stay.
    known = stage["language ID"](spark, awkward, str(tmp_path))
    assert known.columns == awkward.columns and ids(known.collect()) == every - collections.Counter([4, 5, 6, 10])
    clean = stage["toxicity"](spark, awkward, str(tmp_path))
    assert clean.columns == awkward.columns and ids(clean.collect()) <= every and {4, 5, 6} <= set(ids(clean.collect()))
    single = stage["near-duplicates"](spark, awkward, str(tmp_path)).collect()
    assert ids(single) == collections.Counter([1, 3, 4, 5, 6, 7, 8, 9, 10, 11, None])
    mixed = stage["mixing"](spark, awkward, str(tmp_path))
    assert mixed.columns == awkward.columns and set(ids(mixed.collect())) <= set(every)
    encoded = {r.doc_id: r for r in stage["BPE"](spark, awkward, str(tmp_path)).collect()}
    assert len(encoded) == len(every) and encoded[4].n_tokens == encoded[5].n_tokens == encoded[6].n_tokens == 0 < encoded[7].n_tokens


def test_training_order_of_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    path = token_output.write_training_order(awkward, f"{tmp_path}/a", stride=64, per_shard=8)
    rows = token_output.read_slots(spark, path).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and sum(r.doc_id == 4 for r in rows) == 1 and sum(r.doc_id == 3 for r in rows) == 2
    some = token_output.read_slots(spark, path, 5, 10).orderBy("slot").collect()
    assert some == rows[5:15]
    token_output.export_files(spark, path, f"{tmp_path}/files")
    for r in rows:  # every slot is where its number says
        (file,) = glob.glob(f"{tmp_path}/files/shard={r.slot // 8}/part-*")
        with open(file, "rb") as f:
            f.seek(r.slot % 8 * 64 * 2)
            assert np.frombuffer(f.read(r.n_tokens * 2), "<u2").tolist() == r.ids
    sizes = [os.path.getsize(f) for f in glob.glob(f"{tmp_path}/files/shard=*/part-*")]
    assert sum(sizes) == len(rows) * 64 * 2 + len(sizes)
    path = token_output.write_training_order(nothing, f"{tmp_path}/n")
    assert token_output.read_slots(spark, path).collect() == [] == token_output.slot_digests(spark, path).collect()


def test_vectors_that_are_null_ragged_infinite_or_repeated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [0.25, 0.25]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, []), (7, [1.0]), (None, [9.0, 9.0]), (8, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(2))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn_join.voronoi_top_k(df, F.col("vec_id") == 0, k=20).collect()}
    assert got == {(0, 1): (1, 64 * 64 + 32 * 32), (0, 2): (7, 4096), (0, 3): (1, 64 * 16 + 32 * 16), (0, 4): (6, 0), (0, 5): (8, -6144)}
    assert knn_join.voronoi_top_k(df.filter("vec_id is null"), F.lit(True)).collect() == []
    assert knn_join.voronoi_top_k(df.filter("vec_id = 0"), F.lit(True)).collect() == []
    assert knn_join.voronoi_top_k(df, F.lit(False)).collect() == []


def test_vectors_with_huge_components_and_a_hot_id(spark):
    big = float(2**40)
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 0.0]), (3, [3.0, 4.0])] + [(9, [0.5, 0.5])] * 3000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    routes = []
    got = {r["rank"]: (r.vec_id, r.score) for r in knn_join.voronoi_top_k(df, F.col("vec_id") == 0, k=4, routes=routes).collect()}
    q = (2**46, 64)
    assert got == {1: (1, 2**63 - 1), 2: (3, q[0] * 192 + q[1] * 256), 3: (9, q[0] * 32 + q[1] * 32), 4: (9, q[0] * 32 + q[1] * 32)}
    assert routes[0][1] >= 3  # the repeated id is in several blocks


def test_groups_of_vectors_are_not_sent_to_all_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 8
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.1).tolist()) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    routes = []
    got = {}
    for r in knn_join.voronoi_top_k(df, F.col("vec_id") % 400 == 0, k=5, pivots=80, routes=routes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(np.array([x for _, x in rows]) * 64).astype(np.int64)
    for i, found in got.items():
        s = v @ v[i]
        order = [j for j in np.lexsort((np.arange(len(v)), -s)) if j != i][:5]
        assert [x[1:] for x in sorted(found)] == [(int(j), int(s[j])) for j in order]
    sent, every = routes[0]
    assert len(got) == 20 and sent < 0.6 * every, routes


def test_pages_with_nulls_copies_and_clashing_columns(spark, tmp_path):
    big = "x" * 100
    rows = [(1, "http://a\r\nb", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (2, None, big), (6, "u", ""), (7, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("payload", F.lit("p"))
    path = warc.write_archive(pages, f"{tmp_path}/w")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_index(spark, path).collect()), key=repr)
    want = [(-1, 100, "revisit", 1), (1, 100, "response", None), (2, 100, "revisit", 1), (2, 100, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 100, "response", None)]
    assert got == sorted(want, key=repr)
    stored = spark.read.parquet(f"{path}/payloads").groupBy("digest").count().collect()
    assert all(r["count"] == 1 for r in stored) and len(stored) == 4
    every = [(r.page_id, bytes(r.record)) for r in warc.reconstruct(spark, path).collect()]
    records = dict(every)
    assert records[1].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[1].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n") and b"WARC-Target-URI: http://a%0D%0Ab\r\n" in records[1]
    assert b"WARC-Target-URI" not in records[2] and big.encode() not in records[2]
    ids = [re.search(rb"WARC-Record-ID: (<urn:page:[^>]+>)\r\n", r)[1] for _, r in every]
    assert len(set(ids)) == len(rows) and re.search(rb"WARC-Refers-To: (<urn:page:[^>]+>)", records[2])[1] in ids
    for _, r in every:  # a block is as long as its header says, and the record is a whole HTTP message
        head, rest = r.split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and fields[b"Content-Type"] == b"application/http; msgtype=response" and fields[b"WARC-Date"].endswith(b"Z")
        http, body = block.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        assert len(body) == (size if fields[b"WARC-Type"] == b"response" else 0)
    full = {r.page_id: bytes(r.record) for r in warc.reconstruct(spark, path, full=True).collect()}
    assert full[2].endswith(big.encode() + b"\r\n\r\n")
    empty = warc.write_archive(pages.filter("page_id = 99"), f"{tmp_path}/e")
    assert warc.read_index(spark, empty).collect() == []


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 14))
