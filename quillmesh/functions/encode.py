"""The default text encoder: a signed feature hash of words, unit length; a model can take its place."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import words

#: Dimensions of the default encoder.
DIM = 64


@lru_cache(500_000)
def _slot(word: str) -> tuple[int, float]:
    h = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:8], 16) % DIM, 1.0 if int(h[8], 16) % 2 else -1.0


def encode(items: list[list[str]]) -> np.ndarray:
    """Vectors of texts given as words: each word adds 1 or -1 at a place that its MD5 names; no words, no length."""
    out = np.zeros((len(items), DIM))
    for i, ws in enumerate(items):
        for w in ws:
            at, sign = _slot(w)
            out[i, at] += sign
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def encoded(df: DataFrame, text: Column, encoder: Callable[[list[list[str]]], np.ndarray] = encode) -> DataFrame:
    """df with its texts' vectors as `embedding`, batch by batch; the words are cut in the JVM. Null texts have the zero vector."""
    rows = df.withColumn("words_", words(F.coalesce(text, F.lit(""))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = encoder(batch.column(batch.num_columns - 1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "embedding"])

    return rows.mapInArrow(run, schema)


def dimension(encoder: Callable[[list[list[str]]], np.ndarray] = encode) -> int:
    """How many dimensions an encoder has, found by encoding one word."""
    return encoder([["probe"]]).shape[1]
