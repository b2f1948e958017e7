"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosea.functions.batches import CHUNK_BYTES, byte_lengths, give_back, joined, sliced
from mnemosea.sources.shared import shared_folder

__all__ = ["CHUNK_BYTES", "byte_lengths", "give_back", "joined", "sliced"]

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it.

    The lineage ends there: what an executor loses is read again, not computed
    again, and a table that is read twice gives the same rows both times.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def lowered_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased: all words in one
    array, and the offsets at which each text's words begin (one more than texts).
    A null text has no words."""
    data, starts = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(starts)), pa.py_buffer(np.ascontiguousarray(data)))
    split = pc.ascii_split_whitespace(whole)
    values = split.values
    offsets = np.asarray(split.offsets).astype(np.int64)
    real = np.asarray(pc.binary_length(values)) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return values.filter(pa.array(real)), before[offsets]


def encoded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in order of first appearance, and the number of each value."""
    e = values.dictionary_encode()
    return e.dictionary, np.asarray(e.indices)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
