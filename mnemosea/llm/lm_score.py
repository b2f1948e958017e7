"""Language-model scoring with a weighted backoff automaton.

The model is a word n-gram model (three words unless told otherwise), each order with Dirichlet smoothing
over the next lower one and the lowest over an add-half unigram model. As an automaton: a state is a
history that training has seen (of up to two words, or the start of a text); an arc is an n-gram that training
has seen, with its log-probability, and leads to the longest state that its words end in; a state's
failure arc leads to the history without its first word, and weighs the log of the mass that the state leaves
to the lower order. The empty state has an arc for every word. A text is read once from left to right:
from the state it is in, a token takes its arc, or failure arcs until there is one, and the
weights add up. The probabilities of all known tokens and of one unknown token add up to 1 in each state.

The corpus' counts never meet in one place. Texts are cut into chunks, each chunk
is written as a row with the numbers of its words. A chunk sends its distinct n-grams
(as hashes, with their training counts) to shards by hash; as a chunk names an n-gram
once, frequent ones load no shard more than rare ones. A shard adds up and answers each
chunk with the corpus' counts of the n-grams that it named, in the order in which it
named them. With its answers a chunk builds the part of the automaton that its texts
can reach, and walks it. What moves grows with the distinct n-grams of all chunks.

A chunk sends FAN parts at most. Where the corpus needs more shards than that, the parts of some chunks
for the same shard are merged into one list, which is split into FAN parts again, and so on; the answers come back
the same way. So rows, too, grow as the corpus does, and not as chunks times shards.

Hash collisions would add two n-grams' counts. Hashes get 20 bits more than it takes to number
the corpus' n-grams (64 at most), so that the chance that a given n-gram is hit is below a millionth.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosea.llm._common import crc_mod, encoded, lowered_words, materialise, mixed, read_table, sliced

#: Bytes of text in a chunk.
CHUNK = 4 << 20
#: N-grams that a shard adds up, about.
SHARD_ITEMS = 2_000_000
#: Parts at most into which a list of n-grams is split at once.
FAN = 1024
#: Longest n-grams, in words.
ORDER = 3
#: Weight, in tokens, of the lower order in a state that was seen c times: SCALE * c ** POWER.
#: Distinct followers of a word grow about so (Heaps' law), and with them the mass of new ones.
SCALE, POWER = 3.0, 0.9
#: Tokens that are walked one after another; the walks of a chunk's pieces go side by side.
PIECE = 256

_END, _START = np.uint64(0x8C2F_1D5B_93A7_4E61), np.uint64(0x51B7_E0C9_2F48_AD13)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers as their differences, all first bytes, then all second bytes, and so on."""
    step = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return _pack(np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def _unpack_keys(b: bytes) -> np.ndarray:
    planes = _unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _small(a: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes; the first byte of what _pack_counts() gives says how many."""
    return a.astype(np.uint8 if a.max(initial=0) < 1 << 8 else np.uint16 if a.max(initial=0) < 1 << 16 else np.uint64)


def _pack_counts(a: np.ndarray) -> bytes:
    a = _small(a)
    return bytes([a.itemsize]) + _pack(a)


def _unpack_counts(b: bytes) -> np.ndarray:
    return _unpack(b[1:], f"<u{b[0]}")


class Chunk:
    """Tokens of some texts as numbers, and the distinct n-grams among them, order by order."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray, offsets: np.ndarray, train: np.ndarray, order: int):
        end, start = len(hashes), len(hashes) + 1
        self.end, self.start, self.texts = end, start, len(offsets) - 1
        self.sizes = np.diff(offsets) + 1
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        tokens = np.full(int(self.begin[-1]), end, np.int32)
        inside = np.ones(len(tokens), bool)
        inside[self.begin[1:] - 1] = False
        tokens[inside] = codes
        weight = np.repeat(train.astype(np.float32), self.sizes)
        place = np.arange(len(tokens)) - np.repeat(self.begin[:-1], self.sizes)
        word = np.concatenate([hashes, [_END, _START]])
        #: For each order from 1 on: the number of the n-gram that ends at each token (-1: it would begin before the
        #: start), each n-gram's first words' and last words' numbers in the order below, its hash and training count.
        self.number, self.prefix, self.suffix = [tokens], [None], [None]
        self.hashes, self.train = [mixed(word[: end + 1])], [np.bincount(tokens, weight, end + 1)]
        for n in range(2, order + 1):
            there = np.flatnonzero(place >= n - 2)
            below = self.number[-1]
            before = below[there - 1] if n > 2 else np.where(place[there] == 0, start, tokens[there - 1])
            kind, first, number = np.unique(before.astype(np.int64) * (start + 1) + tokens[there], return_index=True, return_inverse=True)
            own = np.full(len(tokens), -1, np.int32)
            own[there] = number
            self.number.append(own)
            self.prefix.append(kind // (start + 1))
            self.suffix.append(below[there[first]].astype(np.int64))
            left = np.append(self.hashes[0], mixed(word[start:])) if n == 2 else self.hashes[-1]
            self.hashes.append(mixed(left[self.prefix[-1]] * np.uint64(3) + word[kind % (start + 1)]))
            self.train.append(np.bincount(number, weight[there], len(kind)))
        self.ends = [np.append(np.zeros(end, bool), True)]
        for n in range(1, order):
            self.ends.append(self.ends[-1][self.suffix[n]])

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys of all n-grams and their training counts; odd keys are words."""
        cut = np.uint64(64 - bits)
        keys = np.concatenate([(h >> cut) & ~np.uint64(1) | np.uint64(k == 0) for k, h in enumerate(self.hashes)])
        self.turn = np.argsort(keys)
        return keys[self.turn], np.concatenate(self.train)[self.turn].astype(np.uint32)

    def corpus(self, answers: np.ndarray) -> list[np.ndarray]:
        """Counts in the corpus of the n-grams of each order, from those of the sorted keys."""
        out = np.empty(len(answers), np.float64)
        out[self.turn] = answers
        return np.split(out, np.cumsum([len(h) for h in self.hashes])[:-1])


class Automaton:
    """The states and arcs that the tokens of a chunk can reach.

    States: 0 is the empty one, 1 the start of a text, then n-grams of each order but the highest. An arc has the
    number of its n-gram within its order, and its order is one more than the words of its state.
    """

    def __init__(self, counts: list[np.ndarray], chunk: Chunk, *, total: int, types: int, texts: int, scale: float, power: float):
        order = len(counts)
        self.unigram = np.log10((counts[0] + 0.5) / (total + 0.5 * (types + 1)))
        #: The first state of each number of words, and by state: the words, failure arc and its weight.
        self.first = np.cumsum([2, *map(len, counts)])[:-1]
        #: By order, of each arc: weight (NaN if training has not seen it) and where it leads.
        self.weight, self.to = [self.unigram], []
        states = int(self.first[order - 1])
        self.words, self.fall, self.fall_weight = np.zeros(states, np.int8), np.zeros(states, np.int64), np.zeros(states)
        self.words[1] = 1
        # A history is followed by a token as often as it was seen, unless it ends a text.
        seen = [np.where(ends, 0, c) for c, ends in zip(counts, chunk.ends, strict=True)]
        mass = lambda c: scale * np.maximum(c, 1.0) ** power
        self.fall_weight[1] = np.log10(mass(texts) / (texts + mass(texts))) if texts else 0.0
        self.started = 1 if texts and order > 1 else 0
        longest = np.where(seen[0] > 0, self.first[0] + np.arange(len(seen[0])), 0) if order > 1 else np.zeros(len(seen[0]), np.int64)
        self.to.append(longest)
        for n in range(1, order):
            c = (np.append(seen[0], texts) if n == 1 else seen[n - 1])[chunk.prefix[n]]
            mu = mass(c)
            lower = self.weight[n - 1][chunk.suffix[n]]
            with np.errstate(divide="ignore", invalid="ignore"):
                self.weight.append(np.where((counts[n] > 0) & (c > 0), np.log10((counts[n] + mu * 10.0**lower) / (c + mu)), np.nan))
            # The state of n words, with its failure arc to the longest state below.
            own = np.arange(self.first[n - 1], self.first[n - 1] + len(seen[n - 1]))
            some = own < states
            self.words[own[some]] = n
            self.fall_weight[own[some]] = np.log10(mass(seen[n - 1]) / (seen[n - 1] + mass(seen[n - 1])))[some]
            if n > 1:
                self.fall[own[some]] = self.to[n - 2][chunk.suffix[n - 1]][some]
            shorter = self.to[n - 1][chunk.suffix[n]]
            self.to.append(np.where(seen[n] > 0, self.first[n] + np.arange(len(seen[n])), shorter) if n < order - 1 else shorter)

    def walk(self, chunk: Chunk, piece: int = PIECE) -> np.ndarray:
        """The sum of the weights of each text's tokens. Long texts are cut into pieces, and a piece
        finds its state on the words before it, of which a state has no more than that many."""
        order = len(self.weight)
        pieces = -(-chunk.sizes // piece)
        text = np.repeat(np.arange(chunk.texts), pieces)
        begin = chunk.begin[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
        stop = np.minimum(begin + piece, chunk.begin[1:][text])
        early = np.maximum(chunk.begin[:-1][text], begin - (order - 1))  # where reading begins, some words before the piece
        state = np.where(early == chunk.begin[:-1][text], self.started, 0)
        total = np.zeros(len(text))
        turn = np.argsort(early - stop, kind="stable")
        text, begin, stop, at, state, total = (x[turn] for x in (text, begin, stop, early, state, total))
        weight, to, size = np.concatenate(self.weight), np.concatenate(self.to), np.cumsum([0, *map(len, self.weight)])
        numbers = np.stack(chunk.number)
        live, steps = len(text), int((stop - at).max(initial=0))
        for k in range(steps):
            while stop[live - 1] - at[live - 1] <= k:
                live -= 1
            here = at[:live] + k
            s = state[:live].copy()
            gain = np.zeros(live)
            arc = np.zeros(live, np.int64)
            todo = np.arange(live)
            while len(todo):
                words = self.words[s[todo]]
                arc[todo] = size[words] + numbers[words, here[todo]]
                todo = todo[np.isnan(weight[arc[todo]])]
                gain[todo] += self.fall_weight[s[todo]]
                s[todo] = self.fall[s[todo]]
            gain += weight[arc]
            total[:live] += np.where(here >= begin[:live], gain, 0.0)
            state[:live] = to[arc]
        return np.bincount(text, total, chunk.texts)


def chunk_table(docs: DataFrame, train: Column, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows unit, doc_ids, train, offsets, hashes, codes, tokens (of all texts), train_tokens, train_texts."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(sliced(batches, "text", chunk_bytes)):
            words, offsets = lowered_words(batch.column("text"))
            distinct, codes = encoded(words)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
            train = np.asarray(batch.column("train").fill_null(False))
            own = np.diff(offsets) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{k}"]),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([_pack(a)], pa.binary()) for a in (train, offsets, hashes, codes.astype(np.uint32))),
                    *(pa.array([int(x)], pa.int64()) for x in (own.sum(), own[train].sum(), train.sum())),
                ],
                names=["unit", "doc_ids", "train", "offsets", "hashes", "codes", "tokens", "train_tokens", "train_texts"],
            )

    schema = "unit string, doc_ids array<long>, train binary, offsets binary, hashes binary, codes binary, tokens long, train_tokens long, train_texts long"
    return materialise(docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, schema), "lm-chunks")


def _chunk(row: dict, order: int) -> Chunk:
    return Chunk(_unpack(row["hashes"], np.uint64), _unpack(row["codes"], np.uint32), _unpack(row["offsets"], np.int64), _unpack(row["train"], bool), order)


_PARTS = "unit string, bucket long, keys binary, counts binary"
_ANSWERS = "unit string, bucket long, counts binary, types long"


def _split(unit: str, keys: np.ndarray, counts: np.ndarray, bits: int, bucket: int, buckets: int, fan: int) -> list[dict]:
    """The parts of sorted keys that all lie in one of ``buckets`` ranges of equal size, cut into ``fan`` ranges each;
    empty parts are left out."""
    low = [-(-((bucket * fan + k) << bits) // (buckets * fan)) for k in range(fan)]
    edge = np.append(np.searchsorted(keys, np.array(low, np.uint64)), len(keys)).tolist()
    return [
        {"unit": unit, "bucket": bucket * fan + k, "keys": _pack_keys(keys[i:j]), "counts": _pack_counts(counts[i:j])}
        for k, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i
    ]


def _table(rows: list[dict], names: tuple[str, ...], kinds: tuple) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)})


_PART_COLUMNS = ("unit", "bucket", "keys", "counts"), (pa.string(), pa.int64(), pa.binary(), pa.binary())
_ANSWER_COLUMNS = ("unit", "bucket", "counts", "types"), (pa.string(), pa.int64(), pa.binary(), pa.int64())


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of some parts, their counts, and the places of each part's keys among them."""
    keys = [_unpack_keys(r["keys"]) for r in rows]
    counts = np.concatenate([_unpack_counts(r["counts"]) for r in rows]).astype(np.float64)
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(number, counts, len(distinct)), np.split(number, np.cumsum([len(k) for k in keys])[:-1])


def corpus_counts(parts: DataFrame, *, bits: int, buckets: int, items: int, units: int, shard_items: int, fan: int) -> DataFrame:
    """For every part (unit, bucket, keys, counts) the corpus' counts of its keys: unit, bucket, counts,
    types (words of the bucket that training has, in one of its rows)."""
    if items <= shard_items * buckets:

        def add_up(table):
            rows = table.to_pylist()
            distinct, total, places = _merged(rows)
            types = int(((distinct & np.uint64(1) == 1) & (total > 0)).sum())
            return _table([{"unit": r["unit"], "bucket": r["bucket"], "counts": _pack_counts(total[p]), "types": types * (k == 0)} for k, (r, p) in enumerate(zip(rows, places, strict=True))], *_ANSWER_COLUMNS)

        return materialise(parts.groupBy("bucket").applyInArrow(add_up, _ANSWERS), "lm-counts")

    parts = materialise(parts.withColumn("of", F.pmod(F.xxhash64("unit"), F.lit(-(-units // fan)))), "lm-parts")
    more = min(fan, -(-items // (shard_items * buckets)))

    def merge(key, table):
        distinct, total, _ = _merged(table.to_pylist())
        bucket, of = key[0].as_py(), key[1].as_py()
        return _table(_split(str(of), distinct, total, bits, bucket, buckets, more), *_PART_COLUMNS)

    merged = parts.groupBy("bucket", "of").applyInArrow(merge, _PARTS)
    answers = corpus_counts(merged, bits=bits, buckets=buckets * more, items=items, units=-(-units // fan), shard_items=shard_items, fan=fan)
    answers = answers.select(F.col("unit").cast("long").alias("of"), F.expr(f"bucket div {more}").alias("above"), "bucket", "counts", "types")

    def restore(left, right):
        rows = left.to_pylist()
        _, _, places = _merged(rows)
        total = np.concatenate([_unpack_counts(b).astype(np.uint64) for b in right.sort_by("bucket")["counts"].to_pylist()])
        types = sum(right["types"].to_pylist())
        return _table([{"unit": r["unit"], "bucket": r["bucket"], "counts": _pack_counts(total[p]), "types": types * (k == 0)} for k, (r, p) in enumerate(zip(rows, places, strict=True))], *_ANSWER_COLUMNS)

    back = parts.groupBy("bucket", "of").cogroup(answers.groupBy("above", "of")).applyInArrow(restore, _ANSWERS)
    return materialise(back, "lm-counts")


def score(
    docs: DataFrame, train: Column, *, order: int = ORDER, scale: float = SCALE, power: float = POWER, shard_items: int = SHARD_ITEMS, fan: int = FAN,
    chunk_bytes: int = CHUNK, piece: int = PIECE,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` needs doc_id and text; ``train`` says which rows the model learns from (null:
    not). A null text is empty, and an empty text is the one token that ends every text.
    Repeated rows are documents of their own, in training too. Without training rows
    every token has probability 1 in both models. An empty table gives no rows.
    """
    chunks = chunk_table(docs, train, chunk_bytes)
    n = chunks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_texts"), F.count("*")).first()
    tokens, total, texts, units = (x or 0 for x in n)
    items = order * tokens
    bits = min(64, max(32, items.bit_length() + 20))
    buckets = min(fan, max(8, math.ceil(items / shard_items)))

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, counts = _chunk(row, order).keys(bits)
                yield from _table(_split(row["unit"], keys, counts, bits, 0, 1, buckets), *_PART_COLUMNS).to_batches()

    parts = chunks.select("unit", "train", "offsets", "hashes", "codes").mapInArrow(send, _PARTS)
    counts = corpus_counts(parts, bits=bits, buckets=buckets, items=items, units=units, shard_items=shard_items, fan=fan)
    types = counts.agg(F.sum("types")).first()[0] or 0

    def walk(left, right):
        out = []
        answers = [_unpack_counts(x).astype(np.uint64) for x in right.sort_by("bucket")["counts"].to_pylist()]
        for row in left.to_pylist():
            c = _chunk(row, order)
            c.keys(bits)
            known = c.corpus(np.concatenate(answers))
            machine = Automaton(known, c, total=total, types=types, texts=texts, scale=scale, power=power)
            add = lambda x: pa.array(np.add.reduceat(x, c.begin[:-1]))
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "n_tokens": pa.array(c.sizes),
                        "n_known": add((known[0][c.number[0]] > 0).astype(np.int64)),
                        "train_tokens": pa.array(np.full(c.texts, total, np.int64)),
                        "base_score": add(machine.unigram[c.number[0]]),
                        "score": pa.array(machine.walk(c, piece)),
                    }
                )
            )
        return pa.concat_tables(out) if out else schema_table()

    names = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    schema_table = lambda: pa.table({k: pa.array([], t) for k, t in names.items()})
    left = chunks.drop("tokens", "train_tokens", "train_texts").groupBy("unit")
    right = counts.select("unit", "bucket", "counts").groupBy("unit")
    return left.cogroup(right).applyInArrow(walk, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_score(spark, sf_dir):
    """All documents scored by a model of those whose crc32(doc_id) mod 5 is not 1."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, crc_mod(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
