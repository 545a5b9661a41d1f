"""Raw little-endian int64 token blobs <-> arrays.

Import/export path for stores that keep tokens as raw bytes plus a shape
(the reference's key-value records).  One Arrow batch at a time through
numpy ``frombuffer``/``tobytes`` inside ``mapInPandas``.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_blobs(df: DataFrame, key: str = "key", tokens: str = "tokens", shape: str | None = None) -> DataFrame:
    """Array column -> ``(key, blob BINARY, shape ARRAY<INT>)``; shape defaults to ``[len]``."""
    cols = [F.col(key).alias("key"), F.col(tokens).alias("tokens")]
    cols.append(F.col(shape).cast("array<int>").alias("shape") if shape else F.array(F.size(tokens)).alias("shape"))

    def enc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blobs = [np.asarray(t, dtype="<i8").tobytes() for t in pdf["tokens"]]
            yield pd.DataFrame({"key": pdf["key"], "blob": blobs, "shape": pdf["shape"]})

    return df.select(*cols).mapInPandas(enc, "key string, blob binary, shape array<int>")


def decode_blobs(df: DataFrame, key: str = "key", blob: str = "blob", shape: str = "shape") -> DataFrame:
    """``(key, blob, shape)`` -> ``(key, depth, len, tokens)``; the last shape dim is the length."""

    def dec(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            toks, depth, length = [], [], []
            for b, s in zip(pdf["blob"], pdf["shape"]):
                arr = np.frombuffer(bytes(b), dtype="<i8").copy()
                dims = [int(x) for x in s]
                if int(np.prod(dims)) != arr.size:
                    raise ValueError(f"blob of {arr.size} values does not match shape {dims}")
                toks.append(arr)
                length.append(dims[-1])
                depth.append(int(np.prod(dims[:-1])) if len(dims) > 1 else 1)
            yield pd.DataFrame({"key": pdf["key"], "depth": depth, "len": length, "tokens": toks})

    staged = df.select(F.col(key).alias("key"), F.col(blob).alias("blob"), F.col(shape).alias("shape"))
    return staged.mapInPandas(dec, "key string, depth int, len int, tokens array<bigint>")
