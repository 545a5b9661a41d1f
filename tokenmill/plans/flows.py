"""End-to-end plans composed from the operators.

E2 (training-data assembly) is the flagship: *how many training batches,
tokens and how much padding does this corpus yield?*
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import constants as K
from tokenmill.functions.arrays import dedupe_units, safe_slice
from tokenmill.operators.assemble import assemble_rows, crop_start, size_clip, size_filter
from tokenmill.operators.batching import batch_stats, token_budget_batches
from tokenmill.operators.collate import collate


def row_shapes(
    sem: DataFrame,
    ac: DataFrame,
    reduce: bool = True,
    max_source: int = K.MAX_SOURCE_POSITIONS,
    max_target: int = K.MAX_TARGET_POSITIONS,
    seed: int = 42,
    skip_long: bool = False,
) -> DataFrame:
    """Per paired key: batching size and the lengths of its assembled LM row.

    With ``skip_long`` samples beyond the positions of either stream are left
    out (P11 on raw sizes) instead of cropped.

    Only the semantic units are read (to crop and dedupe them); the acoustic
    side contributes its size column alone, so the scan of the largest store
    prunes every token array.
    """
    # everything semantic is known before pairing: crop offset (key, length),
    # cropped + deduped length.  The join then moves scalars only.
    s = (
        sem.select("key", F.col("len").alias("len_sem"), "units")
        .withColumn("crop_start", crop_start(F.col("key"), F.size("units"), max_source, seed))
        .withColumn("units", safe_slice("units", F.col("crop_start"), F.lit(max_source)))
    )
    n_units = F.size(dedupe_units(s, "units")) if reduce else F.size("units")
    s = s.select("key", "len_sem", "crop_start", (n_units + 1).alias("src_length"))
    a = ac.select("key", F.col("len").alias("len_ac"))
    paired = size_clip(s.join(a, "key", "inner"), max_source, max_target)
    if skip_long:
        paired = size_filter(paired, max_source, max_target).where("fits")
    a0 = F.expr(f"cast(crop_start * {max_target} div {max_source} as int)")
    n_a = F.greatest(F.lit(0), F.least(F.lit(max_target), F.col("len_ac") - a0))
    return paired.select("key", "len_s", "src_length", (n_a + 1).alias("target_length")).withColumn(
        "row_length", F.col("src_length") + F.col("target_length")
    )


def training_batches(
    sem: DataFrame,
    ac: DataFrame,
    reduce: bool = True,
    max_tokens: int = K.MAX_TOKENS,
    seed: int = 42,
) -> DataFrame:
    """E2 flagship: J1 -> P10 -> P13 -> A3 -> W1/W2 -> A4 per batch."""
    shapes = row_shapes(sem, ac, reduce=reduce, seed=seed)
    batched = token_budget_batches(shapes, "len_s", "key", max_tokens=max_tokens, seed=seed)
    return batch_stats(batched)


def collated_batches(
    sem: DataFrame,
    ac: DataFrame,
    keep: int = K.CODEC_DEPTH,
    reduce: bool = True,
    max_tokens: int = K.MAX_TOKENS,
    shuffle: bool = True,
    seed: int = 42,
    parts: int | None = None,
    max_sentences: int | None = None,
    skip_long: bool = False,
) -> DataFrame:
    """E2 in full: streams -> paired, cropped, encoded rows -> token-budget batches -> one collated row per batch.

    Batch ids come from the narrow shapes of the rows; the pairs meet them on
    their key before their rows are made, which cross one more exchange, into their batches; the
    input follows from labels and target and is interleaved behind it.  Both exchanges move packed arrays.
    """
    ids = token_budget_batches(
        row_shapes(sem, ac, reduce=reduce, seed=seed, skip_long=skip_long).select("key", "len_s"),
        max_tokens=max_tokens, shuffle=shuffle, seed=seed, max_sentences=max_sentences,
    ).select("key", "batch_id")
    last = ids.agg(F.max("batch_id")).first()[0]
    rows = assemble_rows(sem, ac, keep=keep, reduce=reduce, seed=seed, ids=ids, pack=True)
    return collate(rows, keep, 0 if last is None else last + 1, parts=parts)


def tokenize_corpus(
    spark,
    audio_root: str | None,
    encoders: dict,
    store_root: str,
    split: str = "train",
    bandwidth: float | None = None,
    ext: str = "wav",
    chunk_s: int = K.CHUNK_SECONDS,
    min_s: int = K.MIN_SECONDS,
    semantic: str = "semantic",
    acoustic: str = "acoustic",
    valid_percent: float = 0.0,
    seed: int = K.SPLIT_SEED,
    manifest: DataFrame | str | None = None,
) -> DataFrame:
    """List audio, or read a manifest -> decode + chunk -> encode every stream once -> write both stores.

    Files are those under ``audio_root``, or those that ``manifest`` names (a
    written manifest or its rows).  A manifest's ``subset`` decides the split
    of its clips; otherwise, with ``valid_percent > 0``, each clip (all of its
    chunks) goes to ``split`` or ``valid`` by the P1 draw on its path.

    Audio is read, decoded and encoded in one pass, which also gives the
    rejected clips; its output is checkpointed (reliably), because inference is
    the expensive step: both store writes and the report read it.  Returns the
    report of rejected clips and failed encodes ``(key, stage, reason)``.
    """
    from tokenmill.operators.encode import encode_job
    from tokenmill.sources.audio import decode_pieces
    from tokenmill.sources.manifest import manifest_files, manifest_read, split_train_valid
    from tokenmill.sources.store import write_token_store

    if (audio_root is None) == (manifest is None):
        raise ValueError("tokens come from the files of a folder, or of a manifest")
    if manifest is not None:
        listed = manifest_read(spark, manifest) if isinstance(manifest, str) else manifest
        if "subset" not in listed.columns:
            listed = split_train_valid(listed, valid_percent, seed)
        files = manifest_files(listed)
    else:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*.{ext}")
            .load(audio_root)
            .select(F.regexp_replace("path", "^file:", "").alias("key"), "content")
        )
        files = split_train_valid(listed, valid_percent, seed, path="key")
    pieces = decode_pieces(files, chunk_s=chunk_s, min_s=min_s, carry=["subset"])
    pieces = pieces.withColumn("__split", F.when(F.col("subset") == "train", F.lit(split)).otherwise(F.lit("valid")))
    pieces = pieces.withColumn("chunk_key", F.coalesce("chunk_key", "key"))
    encoded = encode_job(pieces, encoders, key="chunk_key", carry=["__split"], reason="reason").checkpoint(eager=True)
    stored = encoded.where(F.col("error").isNull())
    write_token_store(
        stored.where(F.col("stream") == semantic).select("key", "len", "tokens", "__split"),
        store_root,
        semantic,
        split="__split",
    )
    write_token_store(
        stored.where(F.col("stream") == acoustic).select("key", "depth", "len", "tokens", "__split"),
        store_root,
        acoustic,
        split="__split",
        bandwidth=bandwidth,
        codebook_columns=True,
    )
    stage = F.when(F.col("stream") == "decode", F.lit("decode")).otherwise(F.concat(F.lit("encode:"), F.col("stream")))
    return encoded.where(F.col("error").isNotNull()).select("key", stage.alias("stage"), F.col("error").alias("reason"))


def load_streams(spark, store_root: str, split: str, bandwidth: float, keep: int | None = None, num_shards: int = 0):
    """E2 inputs from the store: ``(semantic, acoustic)`` frames, acoustic cut to ``keep`` codebooks at read.

    A training split asked for in shards is refused, and so is a store whose
    acoustic depth is mixed or below ``keep`` (one column-pruned scan).
    """
    from tokenmill.operators.aggregates import assert_depth
    from tokenmill.operators.assemble import check_shard_request
    from tokenmill.sources.store import read_token_store

    check_shard_request(split, num_shards)
    assert_depth(read_token_store(spark, store_root, stream="acoustic", split=split, bandwidth=bandwidth).select("depth"), keep or 1)
    sem = read_token_store(spark, store_root, stream="semantic", split=split).select(
        "key", "len", F.col("tokens").alias("units")
    )
    ac = read_token_store(spark, store_root, stream="acoustic", split=split, bandwidth=bandwidth, keep=keep).select(
        "key", "depth", "len", "tokens"
    )
    return sem, ac


def score_report(scores: DataFrame, epsilon: float = K.LABEL_SMOOTHING) -> DataFrame:
    """Masked accuracy and smoothed loss from a long score table, as ``(metric, value)``.

    ``scores`` holds ``(pos, class, score, target, keep)``.  One shuffle on the
    position brings its classes together; one pass over the arrays then gives
    argmax, label probability and mask of every position.
    """
    from tokenmill.functions.numeric import round_half_up
    from tokenmill.operators.score_rows import component_metrics, to_score_rows

    rows = to_score_rows(scores.select("pos", "class", "score", "target", "keep")).withColumn("component", F.lit("word_ins"))
    whole = component_metrics(rows, epsilon=epsilon).where("component = 'total'")
    metrics = F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.when(F.col("total") > 0, 100.0 * F.col("n_correct") / F.col("total")).alias("value")),
        F.struct(F.lit("nll_loss").alias("metric"), round_half_up("nll_loss", 6).alias("value")),
        F.struct(F.lit("loss").alias("metric"), round_half_up("loss", 6).alias("value")),
    )
    return whole.select(F.explode(metrics).alias("m")).select("m.metric", "m.value")
