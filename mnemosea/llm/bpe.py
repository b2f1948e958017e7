"""BPE encoding by dynamic programming over prefixes.

For every prefix of a word the encoding that the merges produce ends in exactly one
token, and that token, once known for all prefixes, gives the ids of the whole word by
following back-pointers. A token that matches at the end of a prefix is the last one
exactly if it and the last token of what comes before it are compatible, that is if
the merges leave the two side by side when they encode the text of both.

- Matches come from a suffix automaton of the vocabulary: its states are walked over
  the text and each state knows the tokens that end there. Here the automaton is a table
  of (state, symbol) transitions over token prefixes together with, for each state, the
  longest token that is a suffix of it and a link to the next shorter one.
- The compatibility test undoes the two tokens' merges side by side, in descending rank,
  and fails as soon as a merge across the border would have come first.

Both are numpy code over all distinct words of a block at once. Words are distinct per
block of text, so each word is encoded once a block.

A very long piece is cut into overlapping parts, which are words of their own side by side. Two parts are
joined where both have a border between tokens and the tokens at it are compatible: a
sequence of tokens of which each two neighbours are compatible is the encoding. If two parts never
agree on a border (as in long repetitions), the piece is merged pair by pair instead.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from mnemosea.llm._common import encoded, lowered_words, read_table, sliced, text_bytes

#: Place of the vocabulary file; a parameter of every function here.
VOCABULARY = "word_bpe_49k.json"
#: Bytes, about, of the encoded pieces that a worker remembers; when they are full it forgets them all.
KNOWN_BYTES = 24 << 20
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20
#: Pieces of more bytes than this are cut into parts of so many bytes, which overlap by OVERLAP.
PART, OVERLAP = 2048, 256


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    characters stand for themselves, the other bytes take code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class PairTable:
    """An open-addressing map from pairs of ids to an id, looked up by arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo = np.arange(len(key))
        slot = self._slot(key)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            first = np.unique(np.where(free, slot[todo], -1), return_index=True)
            take = first[1][first[0] >= 0]
            at = todo[take]
            self.keys[slot[at]] = key[at]
            self.values[slot[at]] = value[at]
            todo = np.delete(todo, take)
            slot[todo] = (slot[todo] + (self.keys[slot[todo]] != -1)) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        again = np.flatnonzero((found != key) & (found != -1))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[again]]
            hit = found == key[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (found != -1)]
        return out


class Vocabulary:
    """Tokens, merges and tables of one BPE file. Ids inside are ranks: base symbols
    first, then the products of the merges in their order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = {a + b for a, b in merges}
        base = sorted((t for t in vocab if t not in made), key=vocab.__getitem__)
        rank = {t: i for i, t in enumerate(base)}
        for a, b in merges:
            rank.setdefault(a + b, len(rank))
        self.n_base, n = len(base), len(rank)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        for a, b in merges:
            if (t := rank[a + b]) >= self.n_base and self.left[t] == t:
                self.left[t], self.right[t] = rank[a], rank[b]
        pairs = np.array([(rank[a], rank[b], rank[a + b]) for a, b in merges], np.int64)
        self.pairs = PairTable(*pairs.T)
        self.ids = np.array([vocab[t] for t in rank], np.uint32)
        self.text = list(rank)
        self.symbols: dict[str, int] = {t: i for t, i in rank.items() if i < self.n_base}
        letters = byte_letters()
        inner = [self.symbols.get(x, -1) for x in letters]
        last = [self.symbols.get(x + self.suffix, -1) for x in letters]
        self.of_byte = np.array([inner, last], np.int32)
        self._automaton()
        self._forget()

    def _forget(self) -> None:
        #: Pieces that this worker has encoded already, with where their ranks are.
        self.known: dict[str, int] = {}
        self.known_ranks, self.known_begin, self.known_size = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.known_bytes = 0

    def encode_pieces(self, pieces: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks, and where each piece's ranks begin and how many they are, of ``pieces``, whose ``names`` they are. A piece is encoded
        once as long as the worker remembers it; a name that starts with \\r has no ranks."""
        at = np.fromiter((self.known.get(n, -1) for n in names), np.int64, len(names)) if self.known else np.full(len(names), -1)
        new = np.flatnonzero(at < 0)
        fresh = [names[i] for i in new.tolist()] if len(new) < len(names) else names
        data, edges = text_bytes(pieces.take(pa.array(new)) if len(new) < len(names) else pieces)
        special = data[edges[:-1]] == 13  # no piece is empty
        ranks, start = self.encode_words(*_without(data, np.diff(edges), special))
        begin, size = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        old = at >= 0
        begin[old], size[old] = self.known_begin[at[old]], self.known_size[at[old]]
        begin[new], size[new] = len(self.known_ranks) + start[:-1], np.diff(start)
        every = np.concatenate([self.known_ranks, ranks.astype(np.int32)])
        self.known_bytes += len(data) + 120 * len(fresh) + 4 * len(ranks)
        if self.known_bytes > KNOWN_BYTES:
            self._forget()
        else:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.known_begin, self.known_size = (np.append(x, y[new].astype(np.int32)) for x, y in ((self.known_begin, begin), (self.known_size, size)))
            self.known_ranks = every
        return every, begin, size

    def _automaton(self) -> None:
        """States are the distinct prefixes of tokens as symbol sequences; state 0 is empty."""
        spelled: list[tuple[int, ...]] = []
        for t in range(len(self.ids)):
            spelled.append((t,) if t < self.n_base else spelled[self.left[t]] + spelled[self.right[t]])
        state_of: dict[tuple[int, ...], int] = {(): 0}
        for s in spelled:
            for k in range(1, len(s) + 1):
                state_of.setdefault(s[:k], len(state_of))
        states = sorted(state_of, key=len)
        number = {s: i for i, s in enumerate(states)}
        token = {s: t for t, s in enumerate(spelled)}
        n = len(states)
        self.length = np.array([len(s) for s in spelled], np.int32)
        self.fail = np.zeros(n, np.int32)
        #: For each state, the longest token that is a suffix of its text.
        self.ends = np.full(n, -1, np.int32)
        for i, s in enumerate(states[1:], 1):
            k = 1
            while s[k:] not in number:
                k += 1
            self.fail[i] = number[s[k:]]
            self.ends[i] = token.get(s, self.ends[self.fail[i]])
        #: For each token, the next shorter token that is a suffix of it.
        self.shorter = np.full(len(spelled), -1, np.int32)
        for t, s in enumerate(spelled):
            self.shorter[t] = self.ends[self.fail[number[s]]]
        steps = np.array([(number[s[:-1]], s[-1], number[s]) for s in states[1:]], np.int64)
        self.steps = PairTable(*steps.T)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.steps.get(state, symbol)
        todo = np.flatnonzero(out < 0)
        at = state[todo]
        while len(todo):
            stuck = at == 0
            out[todo[stuck]] = 0
            todo, at = todo[~stuck], self.fail[at[~stuck]]
            got = self.steps.get(at, symbol[todo])
            out[todo[got >= 0]] = got[got >= 0]
            todo, at = todo[got < 0], at[got < 0]
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merges leave ``first`` and ``second`` side by side.

        Take back, again and again, the later of the two merges next to the border. Those
        merges all came before ``bound``, so a merge of the two neighbours would have
        happened if its rank is below it. The right neighbour wins a tie because equal
        merges go from left to right.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        bound = np.full(len(a), np.iinfo(np.int64).max)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.pairs.get(x, y)
            bad = (across >= 0) & (across < bound[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            done = (x < self.n_base) & (y < self.n_base)
            live, x, y = live[~done], x[~done], y[~done]
            first_later = x > y
            bound[live] = np.where(first_later, x, y + 1)
            a[live] = np.where(first_later, self.right[x], x)
            b[live] = np.where(first_later, y, self.left[y])
        return good

    def encode_words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all words' tokens in one array, and where each word's begin. Words are ``size`` bytes of ``data`` each, one after another."""
        long = size > PART + OVERLAP
        if not long.any():
            return self._encode(data, size)
        ranks, start = self._encode(*_without(data, size, long))
        parts = np.split(ranks, start[1:-1])
        ends = np.cumsum(size)
        for k in np.flatnonzero(long).tolist():
            parts[k] = self._encode_long(data[ends[k] - size[k] : ends[k]].tobytes())
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _encode_long(self, word: bytes) -> np.ndarray:
        first = list(range(0, max(1, len(word) - OVERLAP), PART))
        words = [word[a : a + PART + OVERLAP] for a in first]
        ranks, start = self._encode(np.frombuffer(b"".join(words), np.uint8), np.array([*map(len, words)]), np.array(first) + PART + OVERLAP >= len(word))
        parts = np.split(ranks, start[1:-1])
        ends = [a + np.cumsum(self.length[t]) for a, t in zip(first, parts, strict=True)]
        out, low = [], 0  # low: the first token of the part that counts
        for k in range(1, len(first)):
            begins = np.concatenate([[first[k]], ends[k][:-1]])
            border, left, right = np.intersect1d(ends[k - 1], begins, return_indices=True)
            good = np.flatnonzero((left >= low) & self.compatible(parts[k - 1][left], parts[k][right]))
            if not len(good):
                return self._encode_by_merging(word)
            out.append(parts[k - 1][low : left[good[0]] + 1])
            low = int(right[good[0]])
        return np.concatenate([*out, parts[-1][low:]])

    def _encode_by_merging(self, word: bytes) -> np.ndarray:
        """All places of the pair of the lowest rank are merged at a time, from left to right."""
        none = np.iinfo(np.int32).max
        tokens = self.of_byte[0][np.frombuffer(word, np.uint8)].astype(np.int64)
        tokens[-1] = self.of_byte[1][word[-1]]

        def ranks(at: np.ndarray) -> np.ndarray:
            r = self.pairs.get(tokens[at], tokens[at + 1])
            return np.where(r < 0, none, r)

        pair = ranks(np.arange(len(tokens) - 1))
        while len(pair) and (best := int(pair.min())) < none:
            at = np.flatnonzero(pair == best)
            run = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]  # places side by side share a token: every other one counts
            tokens[at] = best
            tokens = np.delete(tokens, at + 1)
            at = at - np.arange(len(at))
            pair = np.delete(pair, np.minimum(at + np.arange(len(at)), len(pair) - 1))
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(tokens) - 1)]
            pair[near] = ranks(near)
        return tokens

    def _encode(self, data: np.ndarray, size: np.ndarray, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Words that are not ``closed`` go on: their last byte does not end a word."""
        order = np.argsort(-size, kind="stable")
        sizes = size[order]
        begin = np.concatenate([[0], np.cumsum(size)])
        closing = np.where(closed[order], sizes, -1) if closed is not None else sizes
        at = begin[:-1][order]
        total = int(begin[-1])
        last = np.full(total, -1, np.int32)
        state = np.zeros(len(size), np.int64)
        alive = len(size)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            alive = int(np.searchsorted(-sizes, -(j + 1), side="right"))
            here = at[:alive] + j
            symbol = self.of_byte[(closing[:alive] == j + 1).astype(np.int8), data[here]]
            state[:alive] = self.step(state[:alive], symbol)
            token = self.ends[state[:alive]].astype(np.int64)
            todo = np.arange(alive)
            while len(todo):
                t = token[todo]
                start = j + 1 - self.length[t]
                before = np.where(start > 0, last[np.maximum(here[todo] - self.length[t], 0)], -1)
                ok = start == 0
                check = np.flatnonzero(~ok & (before >= 0))
                ok[check] = self.compatible(before[check], t[check])
                last[here[todo[ok]]] = t[ok]
                todo = todo[~ok]
                token[todo] = self.shorter[token[todo]]
        # Back-pointers, from the end of every word.
        rest = size.copy()
        count = np.zeros(len(size), np.int64)
        chain = []
        todo = np.flatnonzero(rest > 0)
        while len(todo):
            t = last[begin[todo] + rest[todo] - 1]
            chain.append((todo, t))
            rest[todo] -= self.length[t]
            count[todo] += 1
            todo = todo[rest[todo] > 0]
        offset = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(offset[-1]), np.int64)
        left = count.copy()
        for todo, t in chain:
            left[todo] -= 1
            out[offset[todo] + left[todo]] = t
        return out, offset


def _without(data: np.ndarray, size: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``size`` bytes each, those that are ``gone`` as empty ones."""
    return (data[np.repeat(~gone, size)], np.where(gone, 0, size)) if gone.any() else (data, size)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Fixed value: the split pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES_AND_ENDS = regex.compile(rf"\n|{SPLIT}")


def normalised(text: str) -> str:
    """NFC, lower-cased character by character (so a final sigma is like any other)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def lines(values: pa.Array) -> str:
    """All values, with a line end after each."""
    return text_bytes(pc.binary_join_element_wise(values.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n"))))[0].tobytes().decode()


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + count[i] - 1 for each i in turn."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - (ends - count), count)


class Block:
    """The encoding of a block of texts: ids in one array, a text's at ``offsets``."""

    def __init__(self, texts: pa.Array, vocab: Vocabulary):
        words, offsets = lowered_words(texts, lower=False)
        distinct, codes = encoded(words)
        # Pieces of each distinct word. Words are split in one go, with a line end after each; none has one inside.
        joined = lines(distinct)
        special = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        if special is not None and special.search(joined):
            # Special tokens are found before anything else; \r, which no word has, stands around them.
            parts = regex.split(f"({special.pattern})", joined)
            found = []
            for k, part in enumerate(parts):
                found += [f"\r{part}"] if k % 2 else _PIECES_AND_ENDS.findall(normalised(part))
        else:
            found = _PIECES_AND_ENDS.findall(normalised(joined))
        kinds, flat = encoded(pa.array(["\n", *found], pa.large_string()))
        ends = np.flatnonzero(flat[1:] == 0)
        count = np.diff(ends, prepend=-1) - 1
        flat_a = flat[1:][flat[1:] != 0].astype(np.int64) - 1
        pieces = kinds.slice(1)
        names = lines(pieces).split("\n")[:-1]  # of which none has a line end inside
        ranks, start, size = vocab.encode_pieces(pieces, names)
        self.ids, self.vocab, self.specials = vocab.ids[ranks], vocab, {}
        for i in np.flatnonzero(np.asarray(pc.starts_with(pieces, "\r"))).tolist():
            n = names[i]
            start[i], size[i] = len(self.ids), 1
            self.specials[len(self.ids)] = n[1:]
            self.ids = np.append(self.ids, np.uint32(vocab.special[n[1:]]))
        # Token positions of each distinct word, then of each text.
        begin = np.concatenate([[0], np.cumsum(count)])
        word_size = np.add.reduceat(np.append(size[flat_a], 0), begin[:-1]) if len(count) else np.zeros(0, np.int64)
        word_size = np.where(count > 0, word_size, 0)
        self.ranks = ranks
        self.word_tokens = ragged(start[flat_a], size[flat_a])
        self.word_begin = np.concatenate([[0], np.cumsum(word_size)])
        self.word_size, self.codes, self.word_offsets = word_size, codes, offsets
        upto = np.concatenate([[0], np.cumsum(word_size[codes])])
        self.offsets = upto[offsets]

    def tokens(self, i: int, j: int) -> np.ndarray:
        """Ids of texts i to j-1."""
        codes = self.codes[self.word_offsets[i] : self.word_offsets[j]]
        return self.ids[self.word_tokens[ragged(self.word_begin[codes], self.word_size[codes])]]

    def decoded(self) -> list[str]:
        """What the ids of each distinct word decode to: this vocabulary has no decoder, so
        its tokens as they are written, with spaces between."""
        text, own = self.vocab.text, self.word_tokens
        ranks = np.append(self.ranks, np.zeros(len(self.specials), np.int64))[own]
        names = [text[r] for r in ranks.tolist()]
        for k in np.flatnonzero(own >= len(self.ranks)).tolist():
            names[k] = self.specials[int(own[k])]
        b = self.word_begin.tolist()
        return [" ".join(names[b[i] : b[i + 1]]) for i in range(len(b) - 1)]


def encode(docs: DataFrame, *, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text, as array<int>.

    Null and empty texts have an empty array. Columns of ``docs`` stay, but for one
    named ids, which is replaced.
    """
    path = path or vocabulary_path()
    docs = docs.drop("ids")
    schema = f"{_ddl(docs)}, ids array<int>" if docs.columns else "ids array<int>"

    def run(batches):
        vocab = vocabulary(path)
        for batch in sliced(batches, text, TOGETHER):
            block = Block(batch.column(text), vocab)
            ids = block.tokens(0, batch.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(block.offsets.astype(np.int32)), pa.array(ids))], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, *, path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids; special tokens are kept."""
    path = path or vocabulary_path()
    rows = rows.drop("decoded")

    def run(batches):
        vocab = vocabulary(path)
        name = dict(zip(vocab.ids.tolist(), vocab.text, strict=True)) | {i: t for t, i in vocab.special.items()}
        for batch in batches:
            out = [" ".join(map(name.__getitem__, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{_ddl(rows)}, decoded string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text. Null texts
    count as empty; nothing but the figures leaves the worker."""
    path = path or vocabulary_path()

    def run(batches):
        vocab = vocabulary(path)
        for batch in sliced(batches, "text", TOGETHER):
            block = Block(batch.column("text"), vocab)
            words = block.decoded()
            # A word without tokens leaves no trace in the decoded text.
            empty = {k for k, w in enumerate(words) if not w}
            codes = block.codes.tolist()
            ids_sha, text_sha = [], []
            edge = block.word_offsets.tolist()
            for i in range(batch.num_rows):
                ids_sha.append(hashlib.sha256(block.tokens(i, i + 1).astype("<u4").tobytes()).hexdigest())
                own = codes[edge[i] : edge[i + 1]]
                if empty and not empty.isdisjoint(own):
                    own = [k for k in own if k not in empty]
                text_sha.append(hashlib.sha256(" ".join([words[k] for k in own]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(block.offsets)), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir):
    """All documents encoded and decoded."""
    return digests(read_table(spark, sf_dir, "documents"))
