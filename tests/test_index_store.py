"""The stored index after changes, with bounds and merges, against plain Python."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemosea.functions import postings
from mnemosea.operators import index_store, patterns, search

SCHEMA = "unit_id string, title string, body string, state string, sensitivity string"
WORDS = [f"w{k}" for k in range(60)]


def rows(units):
    return [(u, t, b, "active", "secret" if "hush" in b else "private") for u, (t, b) in units.items()]


def body_of(b):
    return "" if "hush" in b else b


def by_hand(units, query, substring=False):
    """{unit: bm25} over (title, body) units."""
    low = {u: (t.lower(), body_of(b).lower()) for u, (t, b) in units.items()}
    terms = list(dict.fromkeys(w for w in query.lower().split() if len(w) >= (3 if substring else 2)))

    def count(u, term):
        if not substring:
            return Counter(low[u][0].split() + low[u][1].split())[term]
        return sum(x.startswith(term, i) for x in low[u] for i in range(len(x)))

    length = {u: sum(max(0, len(x) - 2) for x in low[u]) if substring else sum(len(x.split()) for x in low[u]) for u in units}
    mean = sum(length.values()) / len(units)
    out = {}
    for term in terms:
        tf = {u: n for u in units if (n := count(u, term))}
        idf = max(1e-6, math.log((len(units) - len(tf) + 0.5) / (len(tf) + 0.5))) if tf else 0
        for u, n in tf.items():
            out[u] = out.get(u, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[u] / mean))
    return {u: -round(x, 6) for u, x in out.items()}


def text_of(rng, n):
    # Words of low numbers are in most texts.
    return " ".join(WORDS[min(59, int(rng.expovariate(0.12)))] for _ in range(n))


@pytest.fixture(scope="module")
def small_ranges():
    patch = pytest.MonkeyPatch()
    patch.setattr(index_store, "RANGE_UNITS", 8)
    patch.setattr(index_store, "SLOTS", 4)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def grown(spark, small_ranges):
    """An index that was built and changed some times, and what it holds by then."""
    rng = random.Random(2)
    units = {f"u{k}": (text_of(rng, rng.randint(0, 2)), text_of(rng, rng.choice([3, 3, 5, 10, 40, 200]))) for k in range(160)}
    frame = lambda some: spark.createDataFrame(rows(some), SCHEMA)
    index, history = search.rebuild(frame(units)), []
    history.append(len(index.segments))
    for step in range(5):
        changed = {f"u{rng.randrange(200)}": (text_of(rng, 1), text_of(rng, rng.choice([2, 20, 90])) + (" hush" if rng.random() < 0.1 else "")) for _ in range([3, 2, 30, 1, 4][step])}
        gone = [u for u in rng.sample(sorted(units), 4) if u not in changed]
        units = {u: x for u, x in units.items() if u not in gone} | changed
        index = search.update(index, frame(changed), frame(units), gone=spark.createDataFrame([(u,) for u in gone], "unit_id string"))
        history.append(len(index.segments))
    return index, units, history


QUERIES = ["w0 w1", "w5", "w30 w2 w59", "nothing", "w0 w0 w7 w12 w40"]


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def test_segments_stay_few(grown):
    _, _, history = grown
    assert history[0] == 1 and max(history) <= 4 and history[-1] < 6
    sizes, most = [100_000], 0
    for _ in range(2000):
        sizes.append(1)
        while len(sizes) > 1 and index_store.due(sizes[-2], sizes[-1]):
            sizes[-2:] = [sum(sizes[-2:])]
        most = max(most, len(sizes))
        if _ == 199:
            assert len(sizes) <= math.log2(200) + 2
    assert most <= math.log2(2000) + 2


def test_statistics_come_from_the_manifest(spark, grown):
    index, units, _ = grown
    lengths = {u: len(t.split()) + len(body_of(b).split()) for u, (t, b) in units.items()}
    assert index.statistics() == (len(units), pytest.approx(sum(lengths.values()) / len(units)))
    assert {r.unit_id: r.doc_len for r in index.units.collect()} == lengths
    again = search.Index.open(spark, index.manifest, index.texts)
    assert again.segments == index.segments and again.statistics() == index.statistics() and again.root == index.root


def test_postings_and_vectors_are_those_of_what_is_there(grown):
    index, units, _ = grown
    want = {(u, w, n) for u, (t, b) in units.items() for w, n in Counter(t.split() + body_of(b).split()).items()}
    assert {(r.unit_id, r.term, r.tf) for r in index.postings.collect()} == want
    assert {r.unit_id for r in index.vectors.collect()} == {u for u, (_, b) in units.items() if "hush" not in b}


@pytest.mark.parametrize("compacted", [False, True])
def test_the_best_of_all_and_of_some(spark, grown, compacted):
    index, units, _ = grown
    if compacted:
        index = index.compacted()
        assert len(index.segments) == 1 and not index.has_dead
    want = {(k, u): s for k, q in enumerate(QUERIES) for u, s in by_hand(units, q).items()}
    assert {(r.query_id, r.unit_id): r.bm25 for r in search.bm25(index, asked(spark)).collect()} == pytest.approx(want, abs=2e-6)
    some = {u for u in units if u.endswith(("1", "4"))}
    for allowed in (None, some):
        got = search.lexical(index, asked(spark), 5, None if allowed is None else spark.createDataFrame([(u,) for u in allowed], "unit_id string")).collect()
        best = {}
        for (k, u), s in want.items():
            if allowed is None or u in allowed:
                best.setdefault(k, []).append((s, u))
        expect = {(k, rank): s for k, own in best.items() for rank, (s, _) in enumerate(sorted(own)[:5], 1)}
        assert {(r.query_id, r.lexical_rank): r.bm25 for r in got} == pytest.approx(expect, abs=2e-6)
        assert all(want[r.query_id, r.unit_id] == pytest.approx(r.bm25, abs=2e-6) for r in got)


def test_few_blocks_are_read_for_a_common_term(spark, small_ranges):
    """Where some units say a common word often, the others' blocks stay unread."""
    rng = random.Random(3)
    units = {f"u{k}": ("", ("common " if k % 5 < 2 else "") + text_of(rng, 30)) for k in range(1200)} | {f"v{k}": ("", "common " * 12) for k in range(20)}
    index = search.rebuild(spark.createDataFrame(rows(units), SCHEMA))
    one = spark.createDataFrame([(1, "common w50")], "query_id long, query string")
    best = search.BestFirst(index, one, 5)
    read, every = best.block_counts()
    assert every > 40 and read < every / 3
    want = sorted((s, u) for u, s in by_hand(units, "common w50").items())[:5]
    got = sorted((r.bm25, r.unit_id) for r in search.lexical(index, one, 5).collect())
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-6)
    plan = best.heads._jdf.queryExecution().executedPlan().toString()
    assert "unit_ids" not in plan.split("ReadSchema")[-1]  # bounds are read without the postings


def test_a_plan_does_not_grow_with_the_segments(grown):
    index, _, _ = grown
    assert len(index.segments) > 1
    for frame in (index.postings, index.units, index.vectors):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2


def test_trigrams_find_parts_of_words_in_any_script(spark, small_ranges):
    units = {
        "a": ("日本語の本", "全文検索は日本語でも動く。日本語"), "b": ("", "Banana bandana BANANA"), "c": ("anan", "nothing here"), "d": ("", "ab"), "e": ("語で", "も動く"),
        "f": ("x" * 3, "xxxxx"), "g": ("", "hush banana"),
    }
    frame = lambda some: spark.createDataFrame(rows(some), SCHEMA)
    index = search.rebuild(frame(units), tokenizer="trigram")
    queries = ["日本語", "anan", "ab", "xxx", "語でも動く", "BANDANA anan", "ban"]
    for step in range(2):
        want = {(k, u): s for k, q in enumerate(queries) for u, s in by_hand(units, q, True).items()}
        got = search.lexical(index, spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), 10).collect()
        assert {(r.query_id, r.unit_id): r.bm25 for r in got} == pytest.approx(want, abs=2e-6) and want
        if step == 0:
            units = units | {"b": ("", "only bandanas now"), "h": ("", "ananas")}
            del units["c"]
            index = search.update(index, frame({u: units[u] for u in "bh"}), frame(units), gone=spark.createDataFrame([("c",)], "unit_id string"))


def test_patterns_in_one_pass(spark, monkeypatch):
    texts = [("t1", "she sells sea shells"), ("t2", ""), ("t3", None), ("t4", "日本語 and she"), ("t1", "sea")]
    wanted = [(1, "she"), (1, "sea"), (1, "she"), (2, "shells"), (3, ""), (4, None), (5, "本"), (6, "absent"), (1, "hells")]
    want = sorted((q, k, n) for k, t in texts if t is not None for q in range(1, 7) if (n := len({p for o, p in wanted if o == q and p is not None and p in t})))
    t, p = spark.createDataFrame(texts, "unit_id string, text string"), spark.createDataFrame(wanted, "query_id long, pattern string")
    for size in (patterns.PATTERN_BYTES, 20):  # all at once, and in blocks
        monkeypatch.setattr(patterns, "PATTERN_BYTES", size)
        got = patterns.contained(t, p) if size > 100 else patterns.contained(t.filter("text <> 'sea' or text is null"), p)
        rest = want if size > 100 else sorted((q, k, n) for k, x in texts if x not in (None, "sea") for q in range(1, 7) if (n := len({w for o, w in wanted if o == q and w is not None and w in x})))
        assert sorted(tuple(r) for r in got.collect()) == rest
    assert patterns.contained(t, p.filter("query_id > 9")).collect() == []


def test_many_patterns_take_as_long_as_few(spark):
    """25 times as many patterns: less than twice the time of a pass over the texts."""
    import time

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    texts = spark.createDataFrame([(str(k), " ".join(rng.choices(vocabulary, k=400))) for k in range(1500)], "unit_id string, text string").repartition(4).cache()
    texts.count()
    took = {}
    for n in (200, 200, 5000):
        # Patterns that are all absent but one, so that what is found does not count.
        wanted = spark.createDataFrame([(k, w + "zz" if k else w) for k, w in enumerate(vocabulary[:n])], "query_id long, pattern string")
        began = time.perf_counter()
        patterns.contained(texts, wanted).write.format("noop").mode("overwrite").save()
        took[n] = time.perf_counter() - began
    texts.unpersist()
    assert took[5000] < 2 * took[200] + 1.0, took


def test_the_update_reads_only_touched_slots(spark, grown):
    index, _, _ = grown
    scan = index._scan("units").filter(F.col("slot").isin([1]))
    assert "slot" in spark._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "formatted").split("PartitionFilters")[1].split("\n")[0]


@pytest.mark.parametrize("tokenizer", index_store.TOKENIZERS)
def test_merged_blocks_are_those_of_a_new_index(spark, small_ranges, tokenizer):
    """Ranges of the merged segments are halved or joined, and lose their dead."""
    rng = random.Random(4)
    units = {f"u{k}": ("", text_of(rng, rng.choice([4, 4, 4, 30]))) for k in range(90)}
    frame = lambda some: spark.createDataFrame(rows(some), SCHEMA)
    index = search.rebuild(frame({u: units[u] for u in sorted(units)[:50]} | {"gone": ("", "w1 w2 w3 w4")}), tokenizer=tokenizer)
    units |= {f"u{k}": ("", text_of(rng, 4)) for k in (3, 17, 30)}
    new = {u: x for u, x in units.items() if u not in sorted(units)[:50] or u in ("u3", "u17", "u30")}
    merged = search.update(index, frame(new), frame(units), gone=spark.createDataFrame([("gone",)], "unit_id string")).compacted()
    plain = search.rebuild(frame(units), tokenizer=tokenizer)
    own = lambda index: sorted(tuple(r) for r in index.blocks().drop("seq").collect())
    assert own(merged) == own(plain) and len(merged.segments) == 1
    assert merged.segments[0].parts == plain.segments[0].parts and max(json.loads(plain.segments[0].parts).values()) > max(json.loads(index.segments[0].parts).values())


def test_blocks_are_small_on_their_way_whatever_the_number_of_buckets(spark):
    rng = random.Random(6)
    units = [(f"unit-{k}", text_of(rng, 60), 60, 0) for k in range(256)]
    made = postings.token_blocks(spark.createDataFrame(units, "unit_id string, text string, doc_len long, range long"), 48)
    n = sum(len(set(t.split())) for _, t, _, _ in units)
    assert made.agg(F.sum(F.octet_length("packed"))).first()[0] < 8 * n
