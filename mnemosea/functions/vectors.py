"""The local hashed embedding and vector arithmetic, as column expressions.

Tokens are hashed byte by byte, which no expression does well, so the embedding is an Arrow kernel: each distinct token of a batch is
hashed once, all side by side, a pair of neighbours goes on from the state of its first token, and sums of buckets are counts
of one array. Arithmetic on vectors stays in the JVM.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemosea.functions.text import let

#: Fixed values of FNV-1a (64 bits).
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
DIMENSION, LARGEST = 8, 4096
#: Sums of buckets that are held at once.
CELLS_TOGETHER = 1 << 20


class ProviderError(Exception):
    """A provider of embeddings failed, or gave something else than vectors of the right length."""


@dataclass(frozen=True)
class Provider:
    """A service that embeds texts: ``embed`` takes a list of texts and gives a vector for each, or raises. It is called in the tasks, with ``batch``
    texts at a time, and ``retries`` times again if it raises, after ``pause`` seconds and twice as long each time."""

    embed: Callable[[list[str]], list[list[float] | None]]
    batch: int = 64
    retries: int = 2
    pause: float = 0.2

    def vectors(self, texts: DataFrame, dim: int, *, key: str = "query_id", text: str = "query", vector: str = "qv") -> DataFrame:
        """(key, vector, error) of each row of ``texts``. A batch that fails to the end, a null, and a vector that is not ``dim`` finite numbers
        fail their own rows only, whose vector is null and whose error says why."""
        embed, batch_size, retries, pause = self.embed, self.batch, self.retries, self.pause

        def called(some: list[str]) -> tuple[list, str | None]:
            for turn in range(retries + 1):
                try:
                    made = list(embed(some))
                    if len(made) != len(some):
                        raise ProviderError(f"{len(made)} vectors for {len(some)} texts")
                    return made, None
                except Exception as e:  # whatever the service raises fails these rows
                    said = f"{type(e).__name__}: {e}"
                    if turn < retries:
                        time.sleep(pause * 2**turn)
            return [None] * len(some), said

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, batch_size):
                    part = batch.slice(i, batch_size)
                    made, error = called([t or "" for t in part.column(text).to_pylist()])
                    good = [v is not None and len(v) == dim and all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) for v in made]
                    why = [None if g else error or f"the vector is not {dim} finite numbers" for g in good]
                    rows = pa.array([[float(x) for x in v] if g else None for v, g in zip(made, good, strict=True)], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column(key), rows, pa.array(why, pa.string())], names=[key, vector, "error"])

        return texts.select(key, text).mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, {vector} array<double>, error string")


def checked(provider: Callable[[DataFrame], DataFrame], queries: DataFrame, dim: int, vector: str = "qv") -> DataFrame:
    """The vectors of a provider that is a dataflow: an error of the provider, a null or a wrong length is a ProviderError."""
    try:
        made = provider(queries)
        bad = made.filter(F.col(vector).isNull() | (F.size(vector) != dim)).head(1)
    except Exception as e:
        raise ProviderError(str(e)) from e
    if bad:
        raise ProviderError(f"the provider's vectors don't have {dim} components")
    return made


def clamp_dimension(dim: int) -> int:
    return DIMENSION if dim <= 0 else min(dim, LARGEST)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins and how long it is; null counts as empty."""
    strings = pc.fill_null(strings.cast(pa.large_string()), "")
    edges = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), edges[:-1], np.diff(edges)


def _folded(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The FNV-1a states after each string's bytes, of all strings side by side, the longest first."""
    order = np.argsort(-size, kind="stable")
    out, at, left = state[order], begin[order], size[order]
    prime = np.uint64(FNV_PRIME)
    n = np.searchsorted(-left, 0)  # strings with a byte
    for k in range(int(left[0]) if len(left) else 0):
        n = np.searchsorted(-left[:n], -k)
        out[:n] = (out[:n] ^ data[at[:n] + k]) * prime
    back = np.empty_like(out)
    back[order] = out
    return back


def fnv_hashes(strings: pa.Array) -> np.ndarray:
    """Unsigned 64-bit FNV-1a of the UTF-8 bytes of each string."""
    return _folded(np.full(len(strings), FNV_OFFSET, np.uint64), *_bytes(strings))


def embed(lists: pa.Array, dim: int) -> pa.Array:
    """The embedding of each list of tokens; a null list has none."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    words, code = flat.dictionary, np.asarray(flat.indices).astype(np.int64)
    data, begin, size = _bytes(words)
    state = _folded(np.full(len(words), FNV_OFFSET, np.uint64), data, begin, size)
    weight = 1.0 + 0.25 * (size >= 6) + 0.15 * np.asarray(pc.match_substring_regex(words, r"\p{Nd}")).astype(bool)
    row = np.repeat(np.arange(len(lists)), sizes)
    first = np.flatnonzero(row[1:] == row[:-1])
    pair, pair_of = np.unique(code[first] * len(words) + code[first + 1], return_inverse=True)
    left, right = pair // max(len(words), 1), pair % max(len(words), 1)
    spaced = (state[left] ^ np.uint64(32)) * np.uint64(FNV_PRIME)
    pair_state = _folded(spaced, data, begin[right], size[right])
    bucket, pair_bucket = ((x % np.uint64(dim)).astype(np.int64) for x in (state, pair_state))
    out = np.zeros((len(lists), dim))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    step = max(1, CELLS_TOGETHER // dim)
    for i in range(0, len(lists), step):
        j = min(len(lists), i + step)
        own = slice(edges[i], edges[j])
        pairs = slice(*np.searchsorted(first, [edges[i], edges[j]]))
        slots = np.concatenate([(row[own] - i) * dim + bucket[code[own]], (row[first[pairs]] - i) * dim + pair_bucket[pair_of[pairs]]])
        weights = np.concatenate([weight[code[own]], np.full(pairs.stop - pairs.start, 0.5)])
        out[i:j] = np.bincount(slots, weights, (j - i) * dim).reshape(j - i, dim)
    total = np.cumsum(out * out, 1)[:, -1]
    with np.errstate(all="ignore"):
        root = total
        for _ in range(12):
            root = (root + total / root) * 0.5
        out = np.where(total[:, None] > 0, out * (1.0 / root)[:, None], out)
    made = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
    return pc.if_else(lists.is_null(), pa.scalar(None, made.type), made) if lists.null_count else made


def hash_bucket(token: Column, dim: int = DIMENSION) -> Column:
    """Unsigned FNV-1a of the UTF-8 bytes, modulo ``dim``."""

    @F.arrow_udf("int")
    def bucket(tokens: pa.Array) -> pa.Array:
        return pa.array((fnv_hashes(tokens) % np.uint64(dim)).astype(np.int32), mask=np.asarray(tokens.is_null()))

    return bucket(token)


def divided(a: Column, b: Column) -> Column:
    """The quotient of two doubles as IEEE 754 has it, where Spark's own raises an error: by zero it is infinite, and NaN for zero by zero."""
    return F.when(b == 0, a * float("inf")).otherwise(a / b)


def newton_root(value: Column) -> Column:
    """Twelve Newton steps from the value itself; not converged for large values, by definition, and NaN for zero."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), value, lambda x, _: (x + divided(value, x)) * 0.5)


def normalised(vector: Column) -> Column:
    def scaled(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
        factor = lambda t: let(F.lit(1.0) / newton_root(t), lambda f: F.transform(v, lambda x: x * f))
        return let(total, lambda t: F.when(t > 0, factor(t)).otherwise(v))

    return let(vector, scaled)


def local_embedding(tokens: Column, dim: int = DIMENSION) -> Column:
    """Normalised bucket sums of token weights and of half for each pair of neighbours."""

    @F.arrow_udf("array<double>")
    def embedded(lists: pa.Array) -> pa.Array:
        return embed(lists, dim)

    return embedded(tokens)


def compressed(vector: Column, dim: int) -> Column:
    """Means of the values whose places are equal modulo ``dim``, normalised."""

    def mean(k: Column) -> Column:
        own = F.filter(vector, lambda _, i: i % dim == k)
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(own)).otherwise(0.0)

    return normalised(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), mean))


def l2_distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))
