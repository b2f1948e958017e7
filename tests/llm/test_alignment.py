"""Alignment of two tokenizers against whole texts and plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from mnemosea.llm import alignment, entries
from mnemosea.llm.bpe import vocabulary_path

ODD = [" ", "　", " ", "\u0085", "▁", "é", "É", "ß", "日本", "👍🏽", "é", "\t", "\n", "\r\n", "  ", "   ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "'ll", "don't", "\x00", "\x7f", "12", "1234567", "ñandú", "¿", "x" * 40, ".", ",", "!?", "-", "_", "Ā", "я", "﻿", "​"]

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def both():
    return alignment.tokenizers(vocabulary_path(alignment.A), vocabulary_path(alignment.B))


def whole(both, text):
    """Ids of both sides for the whole text in one call, or none."""
    if not text:
        return [], []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    want = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != want or b"".join(both.bytes_b[i] for i in b) != want:
        return [], []
    return a, b


def by_hand(both, docs):
    """Sorted rows of the contract for (doc_id, text) rows."""
    rows, links = [], []
    for i, text in docs:
        a, b = whole(both, text)
        ends_a, ends_b = {}, {}
        for ids, spell, ends in ((a, both.bytes_a, ends_a), (b, both.bytes_b, ends_b)):
            at = 0
            for k, t in enumerate(ids):
                ends[at := at + len(spell[t])] = k
        common = sorted(ends_a.keys() & ends_b.keys())
        groups, x, y = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[x : ends_a[e] + 1])) + "|" + ",".join(map(str, b[y : ends_b[e] + 1])))
            x, y = ends_a[e] + 1, ends_b[e] + 1
        links.append([(a[ends_a[e]], b[ends_b[e]]) for e in common])
        rows.append((i, len(a), len(b), len(groups), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((*r, sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own)) for r, own in zip(rows, links, strict=True)), key=repr)


def aligned(spark, docs):
    got = alignment.align(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr)


def odd_text(rng):
    words = [rng.choice(ODD) if rng.random() < 0.3 else "".join(rng.choice("aeiounrstldmABC") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))]
    return "".join(w + rng.choice([" ", " ", " ", "", "  ", "\n"]) for w in words)


def test_pieces_encode_as_whole_texts(both):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = [odd_text(rng) for _ in range(400)] + [None, "", " ", "  ", "a", " a ", "\n a", "▁", "a ▁b", "é é", "à é", "a é", "é a", "x y z"]
    ids, offsets = alignment._both_encoded(pa.array(texts), both)
    spelt = 0
    for k, t in enumerate(texts):
        want = whole(both, t)
        for s in (0, 1):
            assert ids[s][offsets[s][k] : offsets[s][k + 1]].tolist() == want[s], repr(t)
        spelt += bool(want[0])
    assert spelt > 100 and spelt < len(texts)
    assert np.all(np.isin(both.pairs % len(both.bytes_b), np.arange(len(both.bytes_b))))


def test_equals_whole_texts(spark, both):
    rng = random.Random(6)
    docs = [(k, odd_text(rng)) for k in range(150)]
    docs += [(200, None), (201, ""), (202, "same text again"), (203, "same text again"), (203, "same text again"), (None, "no id"), (None, None), (204, "word " * 30000), (205, "z" * 30000), (206, "a▁b")]
    assert aligned(spark, docs) == by_hand(both, docs)


def test_short_runs_and_slices(spark, both, monkeypatch):
    rng = random.Random(7)
    docs = [(k, odd_text(rng)) for k in range(60)] + [(100, "tions of thndhain. " * 50)]
    want = by_hand(both, docs)
    for run, swept in ((3, 40), (1, 2), (50, 64)):
        monkeypatch.setattr(alignment, "RUN", run)
        monkeypatch.setattr(alignment, "SWEPT", swept)
        assert aligned(spark, docs) == want


def test_few_pieces_in_a_row_and_empty_tables(spark, both, monkeypatch):
    docs = [(k, f"text number {k} of some") for k in range(30)]
    monkeypatch.setattr(alignment, "IN_A_ROW", 3)
    assert aligned(spark, docs) == by_hand(both, docs)
    assert aligned(spark, []) == []


def test_without_the_quicker_encoder(both, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    texts = pa.array([odd_text(rng) for _ in range(100)])
    want = alignment._both_encoded(texts, both)
    monkeypatch.setattr(both, "fast", None)
    got = alignment._both_encoded(texts, both)
    assert all((a == b).all() for a, b in zip(sum(want, []), sum(got, []), strict=True))


def test_latin_words_alike_in_both_encoders_of_a(both):
    rng = random.Random(10)
    letters = [chr(k) for k in [*range(32, 127), *range(0xC0, 0x100), 9, 10, 13]]
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))
        assert both.fast.encode_ordinary(t) == both.a.encode(t, add_special_tokens=False).ids


def test_columns_beside_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n_a int, row string")
    assert set(alignment.align(docs).columns) == set(COLUMNS)
    assert alignment.align(docs).first().n_groups == 2


def test_linked_pairs_are_bounded_by_the_vocabularies(both):
    assert len(both.pairs) <= sum(map(len, both.bytes_a)) + sum(map(len, both.bytes_b))


def test_the_query_takes_whole_texts(spark, sf, both):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, entries.QUERIES["op13_alignment"](spark, sf).select(*COLUMNS).collect()), key=repr) == by_hand(both, docs)
