"""Publishing several streams at once, and point reads of the token store.

A publication writes its streams into a new version folder and then swaps one
small pointer file.  Readers resolve every partition folder through the
pointer, so they see all streams of a publication or none of it; a run that
fails before the swap leaves the readers where they were, and its files are
never looked at.  The pointer names, for each partition folder
(``stream/bandwidth/split``), the version that holds it: publishing a few
partitions replaces these alone.

    root/versions/<id>/stream=.../bandwidth=.../split=.../*.parquet
    root/CURRENT                     the pointer (JSON)

Files of a publication are range-clustered by key, with Bloom filters on the
key, and ``root/versions/<id>/_keys`` lists each file's least and greatest
key.  A point read looks the key up in that list, opens the one file that may
hold it, and there the Bloom filter and the row groups' bounds skip the rest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.sources.store import PARTITIONS, STORE_SCHEMA, read_token_store, write_token_store

POINTER = "CURRENT"
ROWS_PER_FILE = 1 << 20
TOKENS_PER_FILE = 1 << 24


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, root: str) -> dict[str, str]:
    path, fs = _path(spark, f"{root}/{POINTER}")
    if not fs.exists(path):
        return {}
    text = "\n".join(r.value for r in spark.read.text(str(path)).collect())  # a line per partition folder
    return json.loads(text)


def _swap_pointer(spark: SparkSession, root: str, folders: dict[str, str]) -> None:
    """Write the pointer beside itself and rename it: one step on a file system."""
    jvm = spark.sparkContext._jvm
    target, _ = _path(spark, f"{root}/{POINTER}")
    beside, fs = _path(spark, f"{root}/_{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(folders, indent=0, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(option, 1)
    overwrite[0] = option.OVERWRITE
    context.rename(beside, target, overwrite)


def publish_streams(
    spark: SparkSession,
    root: str,
    streams: list[dict],
    rows_per_file: int = ROWS_PER_FILE,
    files: int | None = None,
) -> str:
    """Write all ``streams`` and make them current together; returns the version.

    A stream is the keyword arguments of ``write_token_store`` besides the
    root: ``df``, ``stream`` and, as needed, ``split``, ``bandwidth``,
    ``codebook_columns``, ``max_depth``.  Each is written in files of some
    ``rows_per_file`` rows (or in ``files``), clustered by key; in more where
    these would hold over ``TOKENS_PER_FILE`` tokens, since a file is one task's.
    """
    version = uuid.uuid4().hex
    base = f"{root}/versions/{version}"
    for stream in streams:
        options = dict(stream)
        df = options.pop("df")
        # sizes alone: the scan prunes the tokens
        depth = F.col("depth") if "depth" in df.columns else F.lit(1)
        rows, tokens = df.agg(F.count("*"), F.sum(depth.cast("bigint") * F.col("len"))).first()
        n = max(files or -(-rows // rows_per_file), -(-(tokens or 0) // TOKENS_PER_FILE), 1)
        write_token_store(df, base, files_per_partition=n, bloom=True, **options)
    written = spark.read.schema(STORE_SCHEMA).parquet(base)
    keys = written.select("key", *PARTITIONS, F.col("_metadata.file_path").alias("file"))
    spans = keys.groupBy(*PARTITIONS, "file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    spans.repartitionByRange(1, "low").write.parquet(f"{base}/_keys")  # a row per file
    folders = spark.read.parquet(f"{base}/_keys").select(*PARTITIONS).distinct().collect()  # a row per partition folder
    current = _read_pointer(spark, root)
    current.update({_folder(*f): version for f in folders})
    _swap_pointer(spark, root, current)
    return version


def _folder(stream: str, bandwidth: str, split: str) -> str:
    return f"stream={stream}/bandwidth={bandwidth}/split={split}"


def _selected(spark: SparkSession, root: str, stream=None, bandwidth=None, split=None) -> dict[str, list[str]]:
    """Partition folders of each version that the pointer holds current."""
    wanted = {"stream": stream, "bandwidth": None if bandwidth is None else _bandwidth(bandwidth), "split": split}
    out: dict[str, list[str]] = {}
    for folder, version in _read_pointer(spark, root).items():
        parts = dict(p.split("=", 1) for p in folder.split("/"))
        if all(v is None or parts[k] == v for k, v in wanted.items()):
            out.setdefault(version, []).append(folder)
    return out


def _bandwidth(value) -> str:
    b = float(value)
    return str(int(b)) if b.is_integer() else str(b)


def read_published(
    spark: SparkSession, root: str, stream: str | None = None, split: str | None = None, bandwidth: float | None = None, keep: int | None = None
) -> DataFrame:
    """The current streams, as ``read_token_store`` reads a store; filters choose partition folders."""
    out = None
    for version, folders in sorted(_selected(spark, root, stream, bandwidth, split).items()):
        base = f"{root}/versions/{version}"
        part = read_token_store(spark, base, keep=keep, paths=[f"{base}/{f}" for f in folders])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], STORE_SCHEMA).select("key", "depth", "len", "tokens", *PARTITIONS)


def point_read_published(
    spark: SparkSession, root: str, keys: list[str], stream: str, split: str | None = None, bandwidth: float | None = None
) -> DataFrame:
    """Records of a few keys: only files whose span of keys holds one of them are opened."""
    out = None
    for version, folders in sorted(_selected(spark, root, stream, bandwidth, split).items()):
        base = f"{root}/versions/{version}"
        place = F.concat(*[F.concat(F.lit(f"{'' if i == 0 else '/'}{c}="), F.col(c)) for i, c in enumerate(PARTITIONS)])
        spans = spark.read.parquet(f"{base}/_keys").where(place.isin(folders))
        near = F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: (k >= F.col("low")) & (k <= F.col("high")))
        found = [r.file for r in spans.where(near).select("file").collect()]  # at most a file per key and folder
        if found:
            part = read_token_store(spark, base, paths=found).where(F.col("key").isin(keys))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else read_published(spark, root, stream, split, bandwidth).where(F.lit(False))
