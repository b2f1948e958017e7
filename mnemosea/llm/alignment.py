"""Where the tokens of two tokenizers end together, by an event sweep.

Each text is encoded by both tokenizers. The ends of A's and of B's tokens are events, packed in runs of ids behind the
byte at which the run begins (a token's length follows from its id). The runs of both sides are dealt out by document and
sorted by offset, and a state machine streams through them: it holds the tokens since the last common end, counters and a
digest. At each common end it emits a group, and the link of the two tokens that end there.

Of two tokens that end together the shorter one is a suffix of the longer one. So the pairs that can be linked are known
from the two vocabularies alone: fewer than their bytes. Counts of all pairs are sent to every task within that bound.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosea.llm._common import encoded, materialise, read_table, sliced, text_bytes
from mnemosea.llm.bpe import PairTable, byte_letters, ragged, vocabulary_path

#: Places of the two vocabulary files; parameters of every function here.
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded together, and of ids that are swept together.
TOGETHER, SWEPT = 4 << 20, 2 << 20
#: Tokens in a run of events.
RUN = 4096
#: Pieces that A encodes in a row.
IN_A_ROW = 8192
SPACE = 0x20


class Tokenizers:
    """Both tokenizers, the bytes of all of their tokens, and the pairs that can end together."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of_letter = {x: b for b, x in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(of_letter.__getitem__, token)) if of_letter.keys() >= set(token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if not all(self.bytes_a) or not all(self.bytes_b):
            raise ValueError("a token without bytes ends nowhere")
        #: How ids are packed.
        self.kind = np.uint16 if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else np.uint32
        #: Pieces may be encoded apart if none goes on over a space.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.fast = self._fast(vocab, of_letter)

    def _fast(self, vocab: dict[str, int], of_letter: dict[str, int]):
        """A quicker encoder of A's vocabulary for texts of ASCII and Latin-1 letters, of which all versions of Unicode think alike;
        None if A's ids are not in the order of its merges, or it splits words otherwise."""
        import public_tokenizers
        import tiktoken

        spec = json.loads(self.a.to_str())
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        splits = spec["pre_tokenizer"] or {}
        if made != sorted(made) or spec["normalizer"] or splits.get("type") != "ByteLevel" or not splits.get("use_regex") or splits.get("add_prefix_space"):
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(of_letter.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def pairs(self) -> np.ndarray:
        """All pairs of ids (as a * number of B's ids + b, ascending) of which one's bytes are a suffix of the other's."""
        found = set()
        for own, other, flip in ((self.bytes_a, self.bytes_b, False), (self.bytes_b, self.bytes_a, True)):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(other):
                ids.setdefault(t, []).append(i)
            for i, t in enumerate(own):
                for k in range(len(t)):
                    found.update((j, i) if flip else (i, j) for j in ids.get(t[k:], ()))
        return np.sort(np.array([a * len(self.bytes_b) + b for a, b in found], np.int64))

    @functools.cached_property
    def pair_table(self) -> PairTable:
        n = len(self.bytes_b)
        return PairTable(self.pairs // n, self.pairs % n, np.arange(len(self.pairs)))

    @functools.cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))

    @functools.cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id in decimal, padded by one place at least, and its number of digits."""
        n = max(len(self.bytes_a), len(self.bytes_b))
        width = len(str(n)) + 1
        table = np.frombuffer("".join(str(i).ljust(width) for i in range(n)).encode(), np.uint8).reshape(n, width)
        return table, (table != SPACE).sum(1)

    @functools.cached_property
    def spelling(self) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """The bytes of all tokens of each side, and where each token's begin."""
        return tuple((np.frombuffer(b"".join(own), np.uint8), np.cumsum(n) - n) for own, n in zip((self.bytes_a, self.bytes_b), self.lengths, strict=True))

    def encode(self, pieces: pa.LargeBinaryArray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For pieces that begin with a space: the ids of A and B of all, how many each piece has, and whether both spell it."""
        data, starts = _raw(pieces)
        size = np.diff(starts)
        texts = pieces.cast(pa.large_string()).to_pylist()
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)  # B writes the space itself
        count_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        ids = [self._encoded_by_a(texts, data, starts, size), (np.fromiter(chain.from_iterable(ids_b), np.int64, int(count_b.sum())), count_b)]
        good = np.ones(len(size), bool)
        for (own, n), length, (letters, begin) in zip(ids, self.lengths, self.spelling, strict=True):
            owner = np.repeat(np.arange(len(n)), n)
            same = np.bincount(owner, length[own], len(n)).astype(np.int64) == size
            good &= same
            some = same[owner]
            spelt = letters[ragged(begin[own[some]], length[own[some]])]
            wrong = spelt != data[ragged(starts[:-1][same], size[same])]
            good[np.repeat(np.flatnonzero(same), size[same])[wrong]] = False
        return [i for i, _ in ids], [n for _, n in ids], good

    def _encoded_by_a(self, texts: list[str], data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, latin = data == 0xC3, np.zeros(len(data), bool)
        latin[1:] = first[:-1] & (data[1:] >= 0x80)
        shown = ((data > SPACE) & (data < 0x7F)) | latin
        simple = np.logical_and.reduceat(shown | first | (data == SPACE) | (data == 9) | (data == 10) | (data == 13), starts[:-1]) if len(size) else np.zeros(0, bool)
        if self.fast is None:
            simple[:] = False
        last = np.minimum(starts[:-1] + 1, len(data) - 1)
        # Pieces that begin with one space and end with a letter or sign are encoded in a row, as they would be apart.
        rowed = np.flatnonzero(simple & (size > 1) & (shown[last] | first[last]) & shown[starts[1:] - 1])
        count = np.zeros(len(size), np.int64)
        found: dict[int, list[int]] = {}
        in_row = []
        for k in range(0, len(rowed), IN_A_ROW):
            own = rowed[k : k + IN_A_ROW]
            ids = np.array(self.fast.encode_ordinary("".join([texts[i] for i in own.tolist()])), np.int64)
            ends = np.cumsum(self.lengths[0][ids])
            edge = np.searchsorted(ends, np.cumsum(size[own]))
            if (ends[edge] == np.cumsum(size[own])).all():
                count[own] = np.diff(edge, prepend=-1)
                in_row.append(ids)
            else:
                raise ValueError("pieces of A are not encoded in a row as they are apart")
        alone = np.ones(len(size), bool)
        alone[rowed] = False
        slow = np.flatnonzero(alone & ~simple).tolist()
        found |= dict(zip(slow, (e.ids for e in self.a.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)), strict=True))
        for i in np.flatnonzero(alone & simple).tolist():
            found[i] = self.fast.encode_ordinary(texts[i])
        apart = sorted(found)
        count[apart] = [len(found[i]) for i in apart]
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        if len(rowed):
            out[ragged(begin[rowed], count[rowed])] = np.concatenate(in_row)
        out[ragged(begin[apart], count[apart])] = np.fromiter(chain.from_iterable(found[i] for i in apart), np.int64)
        return out, count


def _raw(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces and where each begins (one more than pieces)."""
    starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8) if pieces.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between two letters or signs (ASCII, or Latin-1 letters), where no token of A or B goes across:
    A's words begin with one space at most, and no piece of B has a space after something else."""
    shown = (data > SPACE) & (data < 0x7F)
    first, second = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[1:] = shown[:-1]
    first[2:] |= (data[1:-1] >= 0x80) & (data[:-2] == 0xC3)
    second[:-1] = shown[1:] | (data[1:] == 0xC3)
    return np.flatnonzero((data == SPACE) & first & second)


def _both_encoded(texts: pa.Array, both: Tokenizers) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For A and B: all ids of the texts, and the offset at which each text's begin (one more than texts)."""
    full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    at = np.flatnonzero(np.asarray(full))
    own = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(full).cast(pa.large_string()), pa.scalar("", pa.large_string()))
    data, starts = text_bytes(own)
    begins = np.zeros(len(data), bool)
    begins[starts[:-1]] = True
    if both.apart:
        begins[cuts(data)] = True
    edges = np.append(np.flatnonzero(begins), len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    distinct, code = encoded(pieces)
    made, size, good = both.encode(distinct)
    text = np.searchsorted(starts, edges[:-1], side="right") - 1
    spoilt = np.bincount(text[~good[code]], minlength=len(at)) > 0
    stays = ~spoilt[text]
    used = code[stays]
    ids, offsets = [], []
    for side in (0, 1):
        begin = np.cumsum(size[side]) - size[side]
        ids.append(made[side][ragged(begin[used], size[side][used])])
        n = np.zeros(len(texts), np.int64)
        n[at] = np.bincount(text[stays], size[side][used], len(at))
        offsets.append(np.concatenate([[0], np.cumsum(n)]))
    return ids, offsets


def _runs(ids: np.ndarray, offsets: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, first id) of each run of at most RUN ids of one text."""
    n = np.diff(offsets)
    count = -(-n // RUN)
    text = np.repeat(np.arange(len(n)), count)
    first = offsets[text] + RUN * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    ends = np.concatenate([[0], np.cumsum(length[ids])])
    return text, ends[first] - ends[offsets[text]], first


EVENTS = "doc_id long, row long, side int, start long, ids binary"


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Both sides' events of each text: ``row`` numbers the texts, ``start`` is the byte before the run's first token and ``ids`` its
    ids (32 bits, or 16 where both vocabularies are that small). A text without tokens has one run without ids."""

    def run(batches):
        from pyspark import TaskContext

        both = tokenizers(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text", TOGETHER):
            doc_id = batch.column("doc_id")
            ids, offsets = _both_encoded(batch.column("text"), both)
            for side in (0, 1):
                text, start, first = _runs(ids[side], offsets[side], both.lengths[side])
                edges = np.append(first, len(ids[side])).astype(np.int64)
                if side == 0:
                    none = np.flatnonzero(np.diff(offsets[0]) == 0)
                    text, start = np.concatenate([text, none]), np.concatenate([start, np.zeros(len(none), np.int64)])
                    edges = np.concatenate([edges, np.full(len(none), edges[-1])])
                # Runs follow each other, so one buffer holds the ids of all.
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(edges * np.dtype(both.kind).itemsize), pa.py_buffer(ids[side].astype(both.kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(text)), pa.array(row + text), pa.array(np.full(len(text), side, np.int32)), pa.array(start), packed], names=["doc_id", "row", "side", "start", "ids"])
            row += batch.num_rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, EVENTS)


class Sweep:
    """The machine that streams through the sorted runs. Between two calls it holds the open document: the ids after its
    last common end, its counters, digest and pairs."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.row, self.doc_id = None, None
        self._reset()

    def _reset(self) -> None:
        none = np.zeros(0, np.int64)
        self.ids, self.ends = [none, none], [none, none]
        self.n, self.groups, self.digest, self.pairs, self.times = [0, 0], 0, None, none, none

    def feed(self, batch: pa.RecordBatch) -> list[tuple]:
        """Takes sorted runs; returns the documents that end among them."""
        rows, side, start = (np.asarray(batch.column(c)) for c in ("row", "side", "start"))
        doc_ids = batch.column("doc_id").to_pylist()
        if not len(rows):
            return []
        fresh = np.concatenate([[self.row is None or rows[0] != self.row], rows[1:] != rows[:-1]])
        done = [self._closed()] if self.row is not None and fresh[0] else []
        heads = np.flatnonzero(fresh)
        if fresh[0]:
            self._reset()
        else:
            heads = np.concatenate([[-1], heads])  # the open document goes on
        ordinal = np.cumsum(fresh) - fresh[0]
        names = [(self.row, self.doc_id) if h < 0 else (int(rows[h]), doc_ids[h]) for h in heads]
        ids, keys, hits = [], [], []
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            runs = batch.column("ids").take(pa.array(own))
            kind = self.both.kind
            sizes = np.asarray(pc.binary_length(runs)).astype(np.int64) // np.dtype(kind).itemsize
            new = np.frombuffer(b"".join(runs.to_pylist()), kind).astype(np.int64)
            ends = np.cumsum(self.both.lengths[s][new])
            begin = np.cumsum(sizes) - sizes
            before = np.concatenate([[0], ends])[begin]
            ends = ends - np.repeat(before - start[own], sizes)
            ids.append(np.concatenate([self.ids[s], new]))
            keys.append(np.concatenate([self.ends[s], (np.repeat(ordinal[own], sizes) << 40) | ends]))
        for s in (0, 1):
            mine, other = keys[s], keys[1 - s]
            place = np.minimum(np.searchsorted(other, mine), max(len(other) - 1, 0))
            hits.append(other[place] == mine if len(other) else np.zeros(len(mine), bool))
        self._groups(ids, keys, hits, names, done)
        return done

    def _groups(self, ids, keys, hits, names, done) -> None:
        # Ids after the last common end of all stay for the next call; they are the last document's.
        closed = [np.flatnonzero(h)[-1] + 1 if h.any() else 0 for h in hits]
        rest = [(i[c:], k[c:] & ((1 << 40) - 1)) for i, k, c in zip(ids, keys, closed, strict=True)]
        a, b = (i[:c] for i, c in zip(ids, closed, strict=True))
        hit_a, hit_b = (h[:c] for h, c in zip(hits, closed, strict=True))
        n = int(hit_a.sum())
        group_a, group_b = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
        last_a, last_b = np.flatnonzero(hit_a), np.flatnonzero(hit_b)
        through_a, through_b = last_a + 1, last_b + 1  # ids of each side up to each group's end
        at_a = np.arange(len(a)) + np.concatenate([[0], through_b])[group_a]
        at_b = np.arange(len(b)) + through_a[group_b] if n else np.zeros(0, np.int64)
        text, width = self._written(a, b, at_a, at_b, at_a[last_a], at_b[last_b] if n else at_b)
        ends = np.concatenate([[0], np.cumsum(width)])
        group_doc = keys[0][: closed[0]][hit_a] >> 40
        edge = np.searchsorted(group_doc, np.arange(len(names) + 1))  # groups of each document
        ids_a, ids_b = np.concatenate([[0], through_a])[edge], np.concatenate([[0], through_b])[edge]
        bytes_at = ends[ids_a + ids_b]
        linked = self.both.pair_table.get(a[last_a], b[last_b])
        assert not n or linked.min() >= 0, "two tokens end together and neither is a suffix of the other"
        slots, times = np.unique(group_doc * len(self.both.pairs) + linked, return_counts=True)
        pair_edge = np.searchsorted(slots, np.arange(len(names) + 1) * len(self.both.pairs))
        for k, (self.row, self.doc_id) in enumerate(names):
            if k:
                self._reset()
            if edge[k + 1] > edge[k]:
                part = text[bytes_at[k] : bytes_at[k + 1] - 1]
                if self.digest is None:
                    self.digest = hashlib.sha256(part)
                else:
                    self.digest.update(b";")
                    self.digest.update(part)
                self.n = [self.n[0] + int(ids_a[k + 1] - ids_a[k]), self.n[1] + int(ids_b[k + 1] - ids_b[k])]
                self.groups += int(edge[k + 1] - edge[k])
                own = slice(pair_edge[k], pair_edge[k + 1])
                self._count(slots[own] % len(self.both.pairs), times[own])
            if k + 1 < len(names):
                self.ids = [x[:0] for x in self.ids]
                done.append(self._closed())
        self.ids, self.ends = [r[0] for r in rest], [r[1] for r in rest]

    def _count(self, pairs: np.ndarray, times: np.ndarray) -> None:
        if not len(self.pairs):
            self.pairs, self.times = pairs, times
            return
        self.pairs, place = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        self.times = np.bincount(place, np.concatenate([self.times, times])).astype(np.int64)

    def _written(self, a, b, at_a, at_b, end_a, end_b) -> tuple[memoryview, np.ndarray]:
        """The ids in decimal in their order, each with what separates it from the next, and the length of each."""
        table, size = self.both.digits
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[end_a], mark[end_b] = ord("|"), ord(";")
        width = size[ids] + 1
        wide = table[ids]
        wide[np.arange(len(ids)), width - 1] = mark
        return memoryview(np.ascontiguousarray(wide[np.arange(table.shape[1]) < width[:, None]])), width

    def _closed(self) -> tuple:
        assert not len(self.ids[0]) and not len(self.ids[1]), "a document's tokens don't end together"
        return self.doc_id, *self.n, self.groups, self.groups, self.digest.hexdigest() if self.digest else "", self.pairs, self.times

    def close(self) -> list[tuple]:
        return [] if self.row is None else [self._closed()]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _aligned(done: list[tuple]) -> pa.RecordBatch:
    *plain, pairs, times = zip(*done, strict=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (pairs, times)]
    columns = [pa.array(c, pa.string() if name == "groups_sha256" else pa.int64()) for name, c in zip(_NAMES, plain, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[*_NAMES, "pairs", "times"])


def sweep(runs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each text: its tokens, groups and links, the digest of its groups, and the distinct linked pairs with
    how often it links them. ``runs`` are those of ``events``."""

    def run(batches):
        machine = Sweep(tokenizers(path_a, path_b))
        for batch in sliced(batches, "ids", SWEPT):
            if done := machine.feed(batch):
                yield _aligned(done)
        if done := machine.close():
            yield _aligned(done)

    return runs.repartition("row").sortWithinPartitions("row", "start", "side").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links hold each pair; the vocabularies bound its length."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("pairs").flatten()), np.asarray(batch.column("times").flatten()), n_pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    summed = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_pairs, np.int64)
    counts[np.asarray(summed.column("pair"))] = np.asarray(summed.column("n"))
    return counts


def align(docs: DataFrame, *, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text.

    - Null and empty texts, and texts that either side's tokens don't spell exactly, have no tokens: zeros and ''.
    - A row is a document: repeated rows and rows without doc_id have rows of their own, and each counts.
    - Very long texts are runs as all others; the machine holds one run of each side and what a common end has not closed.
    - Ties for the highest count of a B id all count. An empty table gives an empty table; columns beside don't matter.

    Rows are numbered as they are read: read ``docs`` from files, so that a task that runs again numbers them alike.
    """
    path_a, path_b = path_a or vocabulary_path(A), path_b or vocabulary_path(B)
    aligned = materialise(sweep(events(docs, path_a, path_b), path_a, path_b), "aligned")
    both = tokenizers(path_a, path_b)
    counts = pair_counts(aligned, len(both.pairs))
    of_b = both.pairs % len(both.bytes_b)
    highest = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(highest, of_b, counts)
    best = counts == highest[of_b]

    def run(batches):
        for batch in batches:
            pairs, times = (batch.column(c) for c in ("pairs", "times"))
            p, n = np.asarray(pairs.flatten()), np.asarray(times.flatten()).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(pairs)))
            sums = []
            for x in (n * best[p], n * counts[p]):
                whole = np.zeros(batch.num_rows, np.int64)
                np.add.at(whole, doc, x)
                sums.append(pa.array(whole))
            own = {c: batch.column(c) for c in _NAMES} | {"n_best": sums[0], "count_sum": sums[1]}
            yield pa.RecordBatch.from_pydict(own)

    return aligned.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def op13_alignment(spark, sf_dir):
    """All documents aligned between the two vocabularies."""
    return align(read_table(spark, sf_dir, "documents"))
