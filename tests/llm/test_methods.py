"""Results against brute force, exact round trips and held-out accuracy."""

import base64
import cProfile
import collections
import hashlib
import importlib.resources
import importlib.util
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from mnemosea.llm import bpe, entries, langid, lm_score, mixing, near_dup, token_output, toxicity, webp
from mnemosea.llm._common import sliced

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_sliced_batches_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "c" * 30, "", "d e f"] * 3)], names=["t"])
    for size in (1, 4, 31, 1000):
        assert [x for b in sliced([batch, batch], "t", size) for x in b.column(0).to_pylist()] == batch.column(0).to_pylist() * 2


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entries.QUERIES[name](spark, sf)
    rel = con.sql(entries.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_the_mix_meets_its_targets(spark, sf, docs):
    rows = entries.QUERIES["op1_pareto_mix"](spark, sf).collect()
    assert sorted(rows, key=repr) == sorted(entries.QUERIES["op1_pareto_mix"](spark, sf).collect(), key=repr)
    size = {i: len(WORD.findall(t or "")) for i, t, _, _ in docs}
    of = {i: s for i, _, _, s in docs}
    total = collections.Counter()
    for i, n in size.items():
        total[of[i]] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while True:  # share by weight, stop at the caps, share the excess
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        s = of[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and math.isclose(r.target, target[s], rel_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in total)


def test_the_sample_is_of_unequal_probability(spark):
    """Of documents of 10 and of 90 words, the longer are drawn more often, seed by seed."""
    rows = [(i, "w " * (10 if i % 2 else 90), "a") for i in range(400)] + [(1000 + i, "w " * 1000, "b") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = collections.Counter()
    for seed in (1, 2, 3):
        for r in mixing.mix_sources(df, weights=(1.0, 9.0), share=0.5, seed=seed).collect():
            if r.doc_id < 1000:
                share[r.size, r.copies] += 1
    rate = lambda n: share[n, 1] / (share[n, 0] + share[n, 1])
    assert 0 < rate(10) < rate(90) < 1


def test_encodings_equal_the_library(docs, tokenizer):
    random.seed(4)
    texts = [t for _, t, _, _ in docs]
    texts += ["".join(random.choice("abcdefghijklmnopqrstuvwxyz'.,!?0123 éüßñ") for _ in range(150)) for _ in range(300)]
    texts += ["".join(random.choice("ab") for _ in range(80)) for _ in range(100)]
    texts += ["<|startoftext|>x<|endoftext|> ΣΑΣ İs　a\u0085b é 日本 🎉", "a<|endoftext|><|endoftext|>b", "'S'LL", ""]
    vocab = bpe.Vocabulary(bpe.vocabulary_path())
    for part in (texts, texts[::-1]):  # the second time from what is remembered
        block = bpe.Block(pa.array(part, pa.string()), vocab)
        words = block.decoded()
        for i, t in enumerate(part):
            want = tokenizer.encode(t, add_special_tokens=False).ids
            assert block.tokens(i, i + 1).tolist() == want
            own = [words[k] for k in block.codes[block.word_offsets[i] : block.word_offsets[i + 1]]]
            assert " ".join(w for w in own if w) == tokenizer.decode(want, skip_special_tokens=False)


def test_very_long_words(tokenizer):
    """Pieces beyond a part's size: cut and joined, and merged pair by pair where parts do not agree on a border."""
    random.seed(11)
    vocab = bpe.Vocabulary(bpe.vocabulary_path())
    words = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (2304, 2305, 30000)]
    words += ["a" * 2305, "ha" * 5001, "é" * 4000, "!" * 7000, "thequickbrownfox" * 700 + "a" * 5000]
    for w in words:
        want = tokenizer.encode(w, add_special_tokens=False).ids
        assert bpe.Block(pa.array([w]), vocab).tokens(0, 1).tolist() == want
        assert vocab.ids[vocab._encode_by_merging(bpe.normalised(w).encode())].tolist() == want


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 5000)
    vocab = bpe.Vocabulary(bpe.vocabulary_path())
    for k in range(20):
        bpe.Block(pa.array([" ".join(f"word{k}x{j}" for j in range(20))]), vocab)
        assert vocab.known_bytes <= 5000 and len(vocab.known) < 60


def test_digest_query(spark, sf, docs, tokenizer):
    got = {r.doc_id: tuple(r)[1:] for r in entries.QUERIES["op4_bpe"](spark, sf).collect()}
    for i, t, _, _ in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_language_on_held_out_documents(spark, docs):
    rows = spark.createDataFrame([(i, t, la) for i, t, la, _ in docs], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(rows, langid.fit(rows, F.col("doc_id") % 3 != 1)).collect()}
    held = [(got[i].lang_pred, la) for i, _, la, _ in docs if i % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def grams_of(text):
    """Blended n-grams of a text as tuples, all that is no letter being one symbol."""
    symbols = [c if langid._LETTER.match(c) else "" for c in text.lower()]
    return {tuple(symbols[i : i + n]) for n in langid.ORDERS for i in range(len(symbols) - n + 1)}


def test_the_language_kernel_equals_sets_of_n_grams():
    rows = [("en", "The cat sat on the mat."), ("en", "A dog!"), ("el", "Η γάτα κάθεται στο χαλί"), ("ja", "猫はマットの上に座った。"), ("ru", "Кошка сидит на коврике"), ("am", "ድመቷ ምንጣፉ ላይ ተቀመጠች")]
    model = langid.Model([*rows, *rows], landmarks=2, ridge=1e-3, sharpness=4.0)
    texts = ["The mat", "猫", "кот на коврике, 12", "x", "", "word " * 3000 + "猫", "ድመት"]
    marks = [t for lang in model.languages for t in [x for la, x in sorted([*rows, *rows]) if la == lang][:2]]
    sets = [grams_of(t) for t in marks]
    got = model.kernel(texts)
    for i, t in enumerate(texts):
        own = grams_of(t)
        want = [len(own & s) / math.sqrt(max(1, len(own)) * max(1, len(s))) for s in sets]
        assert np.allclose(got[i], want, atol=1e-6), t
    # Each script is told apart from the others by letters of its own.
    assert [model.predict([t])[0][0] for _, t in rows] == [la for la, _ in rows]
    many = model.predict([t for _, t in rows] * 40)  # beyond one batch
    assert many[0] == [la for la, _ in rows] * 40


def test_the_language_ridge_regression_is_that_of_the_nystrom_map():
    rows = [("a", "aaa aab abb"), ("a", "aba aaa"), ("b", "bcb ccc bbc"), ("b", "cbc bcc"), ("c", "ded eee"), ("c", "dde ded")]
    model = langid.Model(rows, landmarks=2, ridge=0.1, sharpness=1.0)
    own = model.marks.T.astype(float) @ model.marks
    value, vector = np.linalg.eigh(own)
    root = vector / np.sqrt(value)
    z = np.concatenate([model.kernel([t for _, t in sorted(rows)]) @ root, np.ones((6, 1))], 1)
    y = np.array([[1.0 if la == c else -1.0 for c in "abc"] for la, _ in sorted(rows)])
    w = np.diag(np.full(6, 0.5))
    solved = np.linalg.solve(z.T @ w @ z + 0.1 * np.eye(z.shape[1]), z.T @ w @ y)
    assert np.allclose(model.weights, root @ solved[:-1], atol=1e-6) and np.allclose(model.bias, solved[-1], atol=1e-6)


def test_language_fit_takes_repeated_rows_once(spark):
    rows = [(1, "the cat sat on the mat", "en")] * 3000 + [(k, f"le chat numéro {k} est là", "fr") for k in range(2, 40)] + [(50, "the dog ran", "en"), (51, "un perro corre", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), per_language=20)
    assert model.languages == ["en", "es", "fr"] and model.predict(["the cat ran"])[0] == ["en"]


def count_features(texts, orders=toxicity.ORDERS, levels=toxicity.LEVELS):
    out = []
    for t in texts:
        low = t.lower()
        n_grams = collections.Counter(low[i : i + n] for n in orders for i in range(len(low) - n + 1))
        out.append({(g, k) for g, c in n_grams.items() for k, level in enumerate(levels) if c >= level})
    return out


def test_toxic_features_and_ratios_equal_brute_force():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("tree stone river glum zorb".split()) for _ in range(6)) + (" zorbzorb zorb zorb zorb" if k % 3 == 0 else "") for k in range(90)]
    y = np.array([k % 3 == 0 for k in range(90)])
    sets = count_features(texts)
    counts = collections.Counter((f, label) for own, label in zip(sets, y.tolist(), strict=True) for f in own)
    want = set()
    n, m = int(y.sum()), int((~y).sum())
    for f in {f for own in sets for f in own}:
        p, q = counts[f, True], counts[f, False]
        table = [(p, n), (q, m), (n - p, n), (m - q, m)]
        e = (p + q) / (n + m)
        stat = 2 * sum(o * math.log(o / (size * (e if k < 2 else 1 - e))) for k, (o, size) in enumerate(table) if o)
        lower = (f[0], f[1] - 1)
        if p + q >= 3 and stat >= 8.0 and (f[1] == 0 or (counts[lower, True], counts[lower, False]) != (p, q)):
            want.add(f)
    hashes, levels = toxicity._select(texts, y, 8.0)
    hash_of = lambda g: [h for n, h in toxicity._grams(np.array([ord(c) for c in g], np.uint32)) if n == len(g)][0][0]
    named = {(int(hash_of(g)), k): (g, k) for g, k in {f for own in sets for f in own}}
    got = [named[int(h), int(k)] for h, k in zip(hashes, levels, strict=True)]
    assert set(got) == want and len(got) == len(want) > 20
    features = toxicity.Features(hashes, levels)
    present = features.present(texts)
    assert [{got[i] for i in own} for own in present] == [own & want for own in sets]
    ratio = toxicity.log_count_ratios(present, y, features.size)
    for i, f in enumerate(got):
        assert math.isclose(ratio[i], math.log(((counts[f, True] + 1) / (n + 1)) / ((counts[f, False] + 1) / (m + 1))), rel_tol=1e-12)
    # The regression separates the classes, and a text of either kind gets a score of its kind.
    model = toxicity.Model(list(zip(y.astype(int).tolist(), texts, strict=True)), g2=8.0)
    assert model.score(["tree zorbzorb zorb zorb zorb", "tree stone"]).round().tolist() == [1.0, 0.0]


def test_toxicity_fit_with_clashing_labels_and_repeated_rows(spark):
    rows = [(k, f"stone river {k} " + ("zorblat grumfik " * 4 if k % 2 else "tree lake " * 4)) for k in range(60)] + [(1, "stone river 1 zorblat grumfik")] * 2000 + [(200, "tree lake " * 5)] * 2
    said = [(k, k % 2) for k in range(60)] + [(200, 1), (200, 0), (3, 1), (None, 1), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fit = lambda: toxicity.fit(docs, spark.createDataFrame(said, "doc_id long, toxic int"), F.lit(True), g2=8.0)
    texts = ["zorblat grumfik " * 4, "tree lake " * 4, ""]
    a, b = fit().score(texts), fit().score(texts)
    assert a.tolist() == b.tolist() and a[0] > 0.7 > 0.3 > a[1]


def test_the_toxicity_query_on_held_out_documents(spark, sf):
    got = {r.doc_id: r for r in entries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    said = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet' where toxic is not null").fetchall()
    held = [(got[i].predicted, y) for i, y in said if got[i].held_out]
    toxic = [p for p, y in held if y]
    assert sum(p for p, y in held if not y) <= 0.02 * len(held) and sum(toxic) >= 0.4 * len(toxic)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())


def test_toxicity_on_held_out_texts(spark):
    random.seed(5)
    plain = ["river", "stone", "window", "garden", "letter", "music", "evening", "paper", "bridge", "coffee"]
    bad = ["zorblat", "grumfik", "vexnard"]
    rows = [(i, " ".join(random.choices(plain, k=30) + (random.choices(bad, k=3) if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 3 == 1]
    assert max(s for s, y in held if not y) < 0.1 and sum(s >= toxicity.TOXIC for s, y in held if y) >= 0.9 * sum(y for _, y in held)
    alone = toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True))
    assert max(alone.score(["zorblat", ""])) < 0.01


def test_feistel_permutes_and_inverts():
    for n in (1, 2, 3, 5, 64, 65, 1000, 70000):
        f = token_output.Feistel(n, 6)
        x = f.forward(np.arange(n))
        assert np.array_equal(np.sort(x), np.arange(n)) and np.array_equal(f.backward(x), np.arange(n))
    assert not np.array_equal(token_output.Feistel(1000, 6).forward(np.arange(1000)), token_output.Feistel(1000, 7).forward(np.arange(1000)))


def test_training_order_holds_every_sequence_once(spark, sf, docs, tokenizer):
    rows = entries.QUERIES["op6_training_order"](spark, sf).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    got = {(r.doc_id, r.part): (r.n_tokens, r.ids_sha256) for r in rows}
    want = {}
    for i, t, _, _ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 49407]
        for k in range(0, len(ids), token_output.STRIDE):
            own = np.array(ids[k : k + token_output.STRIDE], "<u2")
            want[i, k // token_output.STRIDE] = (len(own), hashlib.sha256(own.tobytes()).hexdigest())
    assert got == want


def test_encoder_makes_no_python_call_for_each_piece():
    vocab = bpe.vocabulary(bpe.vocabulary_path())
    letters, pick = "abcdefghijklmnopqrstuvwxyz", random.Random(4)
    words = sorted({"".join(pick.choices(letters, k=8)) for _ in range(20_000)})
    vocab._forget()
    profile = cProfile.Profile()
    block = profile.runcall(bpe.Block, pa.array([" ".join(words)]), vocab)
    assert sum(entry.callcount for entry in profile.getstats()) < len(words)
    vocab._forget()
    again = bpe.Block(pa.array([" ".join(words[:50]), "", None, " ".join(words[50:])]), vocab)
    assert np.array_equal(block.tokens(0, 1), again.tokens(0, 4))


TRANSFORMS = [(), (0,), (1,), (2,), (0, 1, 2), (2, 0, 1), (3,), (3, 0)]


def plain_encoder():
    spec = importlib.util.spec_from_file_location("plain_webp", Path(__file__).with_name("plain_webp.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("transforms", TRANSFORMS)
def test_webp_round_trips(transforms):
    """Every feature of the format, written by a plain encoder; all images of a case are decoded side by side."""
    rng, encode, files, want = np.random.default_rng(7), plain_encoder().encode, [], []
    for height, width in ((1, 1), (1, 7), (9, 13), (17, 8)):
        for colours in (1, 2, 4, 15, 40):
            pixels = rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (height, width))]
            coded = int(webp._blocks(width, webp._per_byte(len(np.unique(pixels.reshape(-1, 4), axis=0))))) if 3 in transforms else width
            for cache_bits in (0, 1, 6):
                for groups in (None, rng.integers(0, 3, (webp._blocks(height, 2), webp._blocks(coded, 2)))):
                    files.append(encode(pixels, transforms=transforms, cache_bits=cache_bits, groups=groups, seed=colours))
                    want.append(pixels)
    for got, pixels in zip(webp.images(b"".join(files)), want, strict=True):
        assert np.array_equal(got, pixels)


def test_images_of_another_encoder():
    """A one-pixel file, and the alpha channel (a lossless stream) of the logo among Python's own test data."""
    one = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert next(webp.images(one)).tolist() == [[[0, 0, 0, 0]]]
    try:
        logo = importlib.resources.files("test.test_email").joinpath("data/python.webp").read_bytes()
    except (ImportError, OSError):
        pytest.skip("Python's test data are not installed")
    at = logo.index(b"ALPH")
    own = logo[at + 8 : at + 8 + int.from_bytes(logo[at + 4 : at + 8], "little")]
    assert own[0] == 1  # lossless, without a filter
    alpha = webp.Images([own[1:]]).decoded(np.array([16]), np.array([16]))[0].view(np.uint8)[1::4].reshape(16, 16)
    assert alpha[0].tolist() == [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0]
    assert np.array_equal(alpha[:, 0] > 100, [False] * 4 + [True] * 7 + [False] * 5) and (alpha[4:12, 4] >= 78).all()


RAWS = (b"", b"a", b"hello " * 5000, bytes(range(256)) * 9, b"ab" * 600_000, bytes(random.Random(7).randrange(256) for _ in range(9000)))


def payload_of(raw):
    out = np.zeros(max(64, -(-len(raw) // 64) * 64), np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def test_webp_payloads_and_damaged_files(monkeypatch):
    payloads = [payload_of(raw) for raw in RAWS]
    edges = np.cumsum([0, *map(len, payloads)])
    media = webp.encode_payloads(np.concatenate(payloads), edges)
    assert all(np.array_equal(a, b) for a, b in zip(webp.decode_payloads(media), payloads, strict=True))
    for k, own in enumerate(payloads):  # an image does not depend on its neighbours
        assert webp.encode_payloads(own, np.array([0, len(own)])) == [media[k]]
    assert len(media[4]) < len(payloads[4]) / 20 and len(media[2]) < len(payloads[2]) / 20
    monkeypatch.setattr(webp, "PIXELS", 4096)
    assert webp.encode_payloads(np.concatenate(payloads), edges) == media
    assert all(np.array_equal(a, b) for a, b in zip(webp.decode_payloads(media), payloads, strict=True))
    for broken in (media[3][:-40], b"RIFF" + media[3][8:], media[3][:20] + b"\x00" + media[3][21:], media[3][:24] + b"\xff" * 30 + media[3][54:]):
        with pytest.raises(webp.Damaged):
            webp.decode_payloads([broken])


def test_media_query(spark, sf, docs, monkeypatch):
    got = {r.doc_id: r for r in entries.QUERIES["op7_webp"](spark, sf).collect()}
    by_text = {}
    for i, t, _, _ in docs:
        raw = (t or "").encode()
        payload = payload_of(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload.tobytes()).hexdigest(), zlib.crc32(payload[-64:]))
        change = int(np.abs(np.diff(payload.astype(int))).sum())
        assert r.feature == f"{len(payload) // 64}x64 sum {int(payload.sum())} change {change} values {len(set(payload.tolist()))}"
        assert by_text.setdefault(t, tuple(r)[1:]) == tuple(r)[1:]
    # The stored bytes use all of the format's means.
    media = {r.doc_id: bytes(r.media) for r in webp.to_media(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert all((got[i].media_bytes, got[i].media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) for i, m in media.items())
    seen = collections.Counter()
    read = webp.Images.pixels

    def counted(self, own, width, height, main):
        if main:
            seen["coded pixels"] += int((width * height).sum())
        return read(self, own, width, height, main)

    monkeypatch.setattr(webp.Images, "pixels", counted)
    monkeypatch.setattr(webp, "_unpredict", lambda *a, f=webp._unpredict: (seen.update(predicted=len(a[0]), modes=len(set(a[1].tolist()))), f(*a))[1])
    monkeypatch.setattr(webp, "_cross", lambda *a, f=webp._cross: (seen.update(crossed=int((a[1][:, 1:3] != 0).any(1).sum())), f(*a))[1])
    monkeypatch.setattr(webp, "_unpalette", lambda *a, f=webp._unpalette: (seen.update(indexed=len(a[0])), f(*a))[1])
    monkeypatch.setattr(webp, "_expanded", lambda *a, f=webp._expanded: (seen.update(dict(zip(("literals", "cached", "copied"), np.bincount(a[0], minlength=3).tolist(), strict=True))), f(*a))[1])
    webp.decode_payloads(list(media.values()))
    assert all(seen[k] > 1000 for k in ("coded pixels", "predicted", "crossed", "indexed", "literals", "cached", "copied")), seen
    assert seen["modes"] >= 3


def test_webp_reads_references_for_many_images_at_a_time(monkeypatch):
    """References and longer codes cost a look-up of their own, so images that meet one wait for others: by far fewer such look-ups than steps."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 117, rng.integers(3, 12), dtype=np.uint8)) + b" " for _ in range(400)]
    payloads = [payload_of(b"".join(words[i] for i in rng.integers(0, 400, 600))) for _ in range(40)]
    media = webp.encode_payloads(np.concatenate(payloads), np.cumsum([0, *map(len, payloads)]))
    seen = collections.Counter()
    run, look = webp.Images._run, webp.Codes.look

    def counted(self, own, codes, *rest):
        monkeypatch.setattr(webp.Codes, "look", lambda *a: (seen.update(looks=1), look(*a))[1])
        image, symbols, size, value = run(self, own, codes, *rest)
        monkeypatch.setattr(webp.Codes, "look", look)
        seen.update(symbols=len(symbols), references=int((size > 1).sum()), images=len(own), most=int(np.bincount(image).max()))
        return image, symbols, size, value

    monkeypatch.setattr(webp.Images, "_run", counted)
    assert all(np.array_equal(a, b) for a, b in zip(webp.decode_payloads(media), payloads, strict=True))
    assert seen["references"] > 20 * seen["images"] and seen["looks"] < seen["most"] / 5, seen


def test_webp_references_of_one_pixel():
    """Images that wait at nearly every step take more steps than they have pixels."""
    out, own, width, height = webp.Bitstreams(2), np.arange(2), np.array([40, 64]), np.array([5, 64])
    out.put(own, 0x2F | (width - 1) << 8 | (height - 1) << 22, 40)
    out.put(own, 0, 3)  # no transform, no cache, one group
    lengths = np.zeros((10, 280), np.uint8)
    lengths[[0, 0, 5, 5], [7, 256, 9, 256]] = 1  # green: a literal, or a reference of one pixel
    lengths[[1, 2, 6, 7], 0] = lengths[[3, 8], 255] = lengths[[4, 9], 1] = 1  # the second short distance: one to the left
    webp._put_codes(out, np.repeat(own, 5), lengths)
    count = width * height
    out.put(np.repeat(own, count), np.concatenate([np.minimum(np.arange(n), 1) for n in count]), 1)
    for got, colour, w, h in zip(webp.decode(out.chunks()), (7, 9), width, height, strict=True):
        assert np.array_equal(got, np.broadcast_to(np.array([0, colour, 0, 255], np.uint8), (h, w, 4)))


def test_webp_images_are_coded_in_ranges_of_like_size():
    """What 4 MB of text leaves beyond two ranges is no range of its own, in which few images would take as many steps."""
    size = np.full(2066, webp.HIGH * webp.WIDE)
    ranges = webp._groups(size)
    assert [j - i for i, j in ranges] == [1034, 1032]
    for n in (0, 1, 5, 1023, 1024, 1025, 1300, 1600, 5000):
        ranges = webp._groups(size[:1].repeat(n))
        assert [i for i, _ in ranges] == [0, *(j for _, j in ranges)][: len(ranges)] and (ranges[-1][1] if ranges else 0) == n
        lengths = [j - i for i, j in ranges]
        assert max(lengths, default=0) * size[0] <= webp.PIXELS * 5 // 4 + size[0] and min(lengths, default=1) >= max(lengths, default=0) * 0.9 - 1


def components(sets, linked):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and linked(sets[i], sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def shingles(t, width):
    w = low_words(t)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, width, percent):
    sets = {i: frozenset(shingles(t, width)) for i, t in docs}
    return sets, components(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))


def test_near_duplicates_equal_brute_force(spark, sf, docs):
    sets, want = brute([(i, t) for i, t, _, _ in docs], 3, 85)
    for r in entries.QUERIES["op8_near_dup"](spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("rounds", (0, 1, 3))
def test_large_groups_of_near_copies(spark, monkeypatch, rounds):
    """Edits of one base, chains of edits, and small sets near the threshold; few classes are hot and blocks are small."""
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    random.seed(8)
    base = [f"w{random.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(random.randrange(0, 14)):
            own[random.randrange(len(own))] = f"e{random.randrange(10**6)}"
        texts.append(" ".join(own))
    chain = [f"c{k}" for k in range(60)]
    for k in range(30):
        chain[(7 * k) % 60] = f"d{k}"
        texts.append(" ".join(chain))
    for k in range(60):
        texts.append(" ".join(f"s{j}" for j in range(k % 12)))
    rows = list(enumerate(texts))
    sets, want = brute(rows, 3, 85)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_the_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(9)
    a = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3600], rng.integers(0, 2**64, 400, dtype=np.uint64)]))
    equal = (near_dup.sketch(np.sort(a)) == near_dup.sketch(b)).mean()
    assert abs(near_dup.estimate(np.array([equal]), np.array([4000]))[0] - 3600 / 4400) < 0.12
    assert 0 < near_dup.collision_rate(np.array([4000]))[0] < 0.01


def language_model(tokens, train, order):
    """A dictionary model: probability of a token after a history of any length, and the word counts."""
    counts = [collections.Counter() for _ in range(order)]
    for i, w in tokens.items():
        if train[i]:
            line = [0, *w]
            for k in range(1, len(line)):
                for n in range(min(order, k + 1)):
                    counts[n][tuple(line[k - n : k + 1])] += 1
    n, v, texts = sum(counts[0].values()), len(counts[0]), sum(train.values())

    def p(history, w):
        if not history:
            return (counts[0][w,] + 0.5) / (n + 0.5 * (v + 1))
        seen = texts if history == (0,) else 0 if history[-1] is None else counts[len(history) - 1][history]
        lower = p(history[1:], w)
        if not seen:
            return lower
        mu = lm_score.SCALE * seen**lm_score.POWER
        return (counts[len(history)][*history, w] + mu * lower) / (seen + mu)

    return p, counts[0], n


def held_against_brute_force(got, tokens, train, order, held=True):
    p, c, n = language_model(tokens, train, order)
    for i, w in tokens.items():
        r, line = got[i], [0, *w]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x,] > 0 for x in w), n) and (not held or r.held_out == (not train[i]))
        assert math.isclose(r.base_score, sum(math.log10(p((), x)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line))), rel_tol=1e-9)
    return p, c


def test_language_model_sums_and_normalises(spark, sf, docs):
    got = {r.doc_id: r for r in entries.QUERIES["op9_lm_score"](spark, sf).collect()}
    train = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _, _, _ in docs}
    tokens = {i: [*low_words(t), None] for i, t, _, _ in docs}
    p, c = held_against_brute_force(got, tokens, train, lm_score.ORDER)
    pair = next((w[k - 1], w[k]) for i, w in tokens.items() if train[i] for k in range(1, len(w) - 1))
    for history in ((), pair[:1], pair, (0,), (0, pair[0])):
        assert math.isclose(sum(p(history, w) for w, in c) + p(history, "never seen"), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("order", (1, 2, 4))
def test_language_model_with_many_shards_chunks_and_long_texts(spark, order):
    """Small chunks and a small fan, so that parts are merged and split on the way to the shards and back."""
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice("a b c d e f g hh ii jj".split()) for _ in range(rng.choice((0, 1, 2, 3, 30, 90)))) for i in range(60)}
    texts[60], texts[61] = "long " * 3 + "x y z " * 700, None
    train = {i: i % 3 != 1 for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") % 3 != 1, order=order, shard_items=40, fan=4, chunk_bytes=600, piece=7).collect()}
    held_against_brute_force(got, {i: [*low_words(t), None] for i, t in texts.items()}, train, order, held=False)


def test_the_pipeline_equals_its_parts(spark, sf, docs, tokenizer):
    """Brute force over the stages that have one; the classifiers' own verdicts for the others."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, table, sf).collect()}
    found = {r.doc_id: r for r in entries.QUERIES["op3_langid"](spark, sf).collect()}
    assert kept == {i for i, r in found.items() if r.lang_pred != "und" and r.score >= langid.LEAST}
    part = table.filter(F.col("doc_id").isin(*kept))
    clean = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.STAGES[1][1](spark, part, sf).collect()]
    _, want = brute([(i, t) for i, t, _ in clean], 5, 80)
    left = spark.createDataFrame([x for x in clean if want[x[0]] == x[0]], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(left).collect() if r.copies}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in rows) == copies
    text = {i: t for i, t, _, _ in docs}
    assert all(r.n_tokens == len(tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids) for r in rows)
