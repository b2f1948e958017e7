"""Training-data operators that must take all of their features and rows."""

import numpy as np
from pyspark.sql import functions as F

from mnemosea.llm import near_dup, toxicity


def test_toxicity_keeps_every_n_gram_that_passes(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8))
    signs = [word() for _ in range(60)]
    rows = [(k % 2, " ".join([word() for _ in range(12)] + ([signs[k // 2 % 60]] if k % 2 else []))) for k in range(1440)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), g2=8.0)
    found = model.features.present(signs)
    # Each sign occurs in 12 toxic texts and in no other, so its own n-grams of 4 characters or more pass.
    assert len(model.features.hashes) > 400 and min(map(len, found)) >= 5 + 4 + 3


def test_a_repeated_id_loses_only_the_text_that_is_a_copy(spark):
    copy, own = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = spark.createDataFrame([(1, copy), (2, copy + " end"), (2, own), (3, copy), (4, None)], "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert {(2, 1, False), (2, 2, True)} <= found
    assert sorted((r.doc_id, r.text) for r in near_dup.keep_one_of_each(docs).collect() if r.text) == [(1, copy), (2, own)]
    assert near_dup.keep_one_of_each(docs).filter("doc_id = 4").count() == 1
