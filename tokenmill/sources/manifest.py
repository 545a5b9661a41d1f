"""Manifest sources and sinks: list audio files (S1), write (S2) and read (S3)
path lists, and split them train/valid (P1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions import constants as K
from tokenmill.functions.hashing import uniform


def manifest_scan(spark: SparkSession, root: str, ext: str = "flac") -> DataFrame:
    """Recursive ``**/*.ext`` listing -> ``(path, length)``.

    ``binaryFile`` lists in parallel on the cluster; selecting only ``path``
    and ``length`` prunes the file contents.  Matching is a case-sensitive
    suffix glob; Spark skips ``_``/``.``-prefixed names.
    """
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{ext}")
        .load(root)
        .select("path", "length")
    )
    return df.withColumn("path", F.regexp_replace("path", "^file:", ""))


def split_train_valid(df: DataFrame, valid_percent: float = K.VALID_PERCENT, seed: int = K.SPLIT_SEED, path: str = "path") -> DataFrame:
    """``subset`` = train iff the path's draw is strictly above ``valid_percent``.

    The draw is a hash of the path, so the split does not depend on listing
    order or partitioning.
    """
    if not 0.0 <= valid_percent <= 1.0:
        raise ValueError("valid_percent must be within [0, 1]")
    if valid_percent == 0:
        return df.withColumn("subset", F.lit("train"))
    return df.withColumn(
        "subset", F.when(uniform("split", F.col(path), seed) > F.lit(float(valid_percent)), "train").otherwise("valid")
    )


def manifest_write(df: DataFrame, dest: str, path: str = "path") -> str:
    """Write one path per line; with a ``subset`` column, one folder per subset.

    The reference writes ``{name}.tsv`` and ``{name}_valid.tsv``; here the
    subsets are ``subset=train`` / ``subset=valid`` partitions of one text
    dataset, overwritten as a whole on re-run.
    """
    out = df.select(path, *(["subset"] if "subset" in df.columns else []))
    writer = out.write.mode("overwrite")
    if "subset" in out.columns:
        writer = writer.partitionBy("subset")
    writer.text(dest)
    return dest


def manifest_read(spark: SparkSession, src: str, drop_blank: bool = True) -> DataFrame:
    """S3: one path per line, surrounding whitespace stripped (blank lines optional)."""
    df = spark.read.text(src)
    stripped = F.regexp_replace(F.regexp_replace(F.col("value"), r"^\s+", ""), r"\s+$", "")
    cols = [stripped.alias("path")] + ([F.col("subset")] if "subset" in df.columns else [])
    out = df.select(*cols)
    return out.where(F.col("path") != "") if drop_blank else out


READ_BYTES = 32 << 20  # contents held at a time by a task that reads files


def manifest_files(manifest: DataFrame, path: str = "path", parts: int | None = None) -> DataFrame:
    """The files that a manifest names, as ``(key, [subset], content, error)``.

    Paths are dealt over ``parts`` tasks (by default the session's shuffle
    width), each of which opens its own files, on any file system that a path's
    scheme names; the driver never sees a path.  A file that cannot be read is
    a row with its ``error``.
    """
    subset = ["subset"] if "subset" in manifest.columns else []
    parts = parts or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = manifest.select(F.col(path).alias("key"), *subset).repartition(parts, "key")

    def read(name: str) -> bytes:
        if "://" in name or name.startswith("file:"):
            system, inner = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
        else:
            system, inner = fs.LocalFileSystem(), name
        with system.open_input_stream(inner) as f:
            return f.read()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, contents, errors = 0, 0, [], []
            for i, name in enumerate(batch.column("key").to_pylist()):
                try:
                    contents.append(read(name))
                    errors.append(None)
                except Exception as e:  # reported, not fatal
                    contents.append(None)
                    errors.append(f"read_error: {type(e).__name__}: {e}")
                size += len(contents[-1] or b"")
                if size >= READ_BYTES or i + 1 == batch.num_rows:
                    rows = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], [*rows.schema.names, "content", "error"]
                    )
                    first, size, contents, errors = i + 1, 0, [], []

    kinds = ", ".join(f"{c} string" for c in ("key", *subset))
    return named.mapInArrow(work, f"{kinds}, content binary, error string")
