"""Training-row assembly: pair, size, truncate, crop, dedupe, offset, interleave.

Stores are DataFrames:
  semantic  ``(key, len INT, units ARRAY<BIGINT>)``
  acoustic  ``(key, depth INT, len INT, tokens ARRAY<BIGINT>)`` - flat,
            codebook-major (``tokens[q * len + t]``), the stored layout.
Matrices produced here are time-major ``ARRAY<ARRAY<BIGINT>>`` (outer =
position, inner = codebook), the layout of one LM row.

All work is per row, the array steps over Arrow batches (no shuffle); the only
shuffle on this path is the key join that pairs the two streams.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import constants as K, packed, ragged
from tokenmill.functions.arrays import dedupe_units, run_lengths, safe_slice
from tokenmill.functions.hashing import uniform


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- J1 / J2 / P10 / P11


def pair_streams(
    sem: DataFrame, ac: DataFrame, with_tokens: bool = True, keep: int | None = None, extra: list[str] | None = None, pack: bool = False
) -> DataFrame:
    """Inner key join of the semantic and acoustic stores.

    With ``with_tokens=False`` only ``key`` and the size columns are read, so
    the parquet scans prune the token arrays (the size index of the store).
    With ``keep`` the acoustic arrays are cut to their first ``keep``
    codebooks *before* the join, so dropped codebooks are never shuffled.
    With ``pack`` units and tokens meet, and stay, packed (``functions.packed``).
    Keys are unique per store, so the join is skew-free; both sides are
    large, so Spark plans a sort-merge join on ``key``.
    """
    units = packed.column("units").alias("units") if pack else F.col("units")
    s = sem.select("key", F.col("len").alias("len_sem"), *([units] if with_tokens else []), *(extra or []))
    toks = []
    if with_tokens:
        if pack:
            ac = ac.select("key", "depth", "len", packed.streamed(F.col("tokens")).alias("tokens"))
        t, cut = F.col("tokens"), packed.first if pack else lambda t, n: F.slice(t, 1, n)
        toks = [(t if keep is None else cut(t, F.col("len") * keep)).alias("tokens")]
    a = ac.select("key", F.col("depth").alias("depth"), F.col("len").alias("len_ac"), *toks)
    return s.join(a, "key", "inner")


def unpaired_keys(sem: DataFrame, ac: DataFrame) -> DataFrame:
    """Keys present in one stream only, with the stream they are missing from.

    One full outer join on ``key`` with presence flags: each side is
    shuffled once (two anti joins would shuffle each side twice).
    """
    s = sem.select("key", F.lit(True).alias("__in_s"))
    a = ac.select("key", F.lit(True).alias("__in_a"))
    j = s.join(a, "key", "full_outer").where(F.col("__in_s").isNull() | F.col("__in_a").isNull())
    return j.select("key", F.when(F.col("__in_a").isNull(), "acoustic").otherwise("semantic").alias("missing_from"))


def size_clip(
    df: DataFrame,
    max_source: int = K.MAX_SOURCE_POSITIONS,
    max_target: int = K.MAX_TARGET_POSITIONS,
    len_sem: str = "len_sem",
    len_ac: str = "len_ac",
) -> DataFrame:
    """P10: clipped sizes used for ordering and batching."""
    return df.withColumn("len_s", F.least(_c(len_sem), F.lit(max_source))).withColumn(
        "len_a", F.least(_c(len_ac), F.lit(max_target))
    )


def size_filter(
    df: DataFrame,
    max_source: int = K.MAX_SOURCE_POSITIONS,
    max_target: int = K.MAX_TARGET_POSITIONS,
    on_raw: bool = True,
    len_sem: str = "len_sem",
    len_ac: str = "len_ac",
) -> DataFrame:
    """Flag and keep samples within ``(max_source, max_target)``.

    On raw sizes over-long samples are skipped; on clipped sizes nothing is
    removed (the reference clips before the trainer filters).  Adds
    ``was_clipped`` and ``fits``; callers filter on ``fits``.
    """
    s = _c(len_sem) if on_raw else F.least(_c(len_sem), F.lit(max_source))
    a = _c(len_ac) if on_raw else F.least(_c(len_ac), F.lit(max_target))
    return df.withColumn(
        "was_clipped", (_c(len_sem) > max_source) | (_c(len_ac) > max_target)
    ).withColumn("fits", (s <= max_source) & (a <= max_target))


# ---------------------------------------------------------------- P12 / P13


MATRIX = "array<array<bigint>>"


def _deep_enough(tokens: Column, length: Column, keep: int, stored: Column | None = None) -> Column:
    """``tokens`` (of which there are ``stored``), or an error where fewer than ``keep`` codebooks are stored."""
    short = (F.size(tokens) if stored is None else stored) < length * keep
    return F.when(short, F.raise_error(F.lit(f"fewer than {keep} codebooks are stored"))).otherwise(tokens)


def codebook_truncate(tokens, length, keep: int = K.CODEC_DEPTH) -> Column:
    """Flat codebook-major ``[depth * L]`` -> time-major ``[L][keep]``.

    One gather of the kept cells, linear in them, which never touches the
    dropped codebooks.  Fewer stored codebooks than ``keep`` are an error.
    """
    tokens, length = _c(tokens), _c(length).cast("int")
    return ragged.column(ragged.code_rows(keep), MATRIX, _deep_enough(tokens, length, keep), length, F.lit(0), length)


def crop_start(key, len_s, max_source: int = K.MAX_SOURCE_POSITIONS, seed: int = 42) -> Column:
    """Crop offset: 0 when the semantic stream fits, else uniform in [0, len_s - max_source]."""
    len_s = _c(len_s)
    draw = F.floor(uniform("crop", key, seed) * (len_s - max_source + 1)).cast("int")
    return F.when(len_s <= max_source, F.lit(0)).otherwise(draw)


def aligned_crop(
    df: DataFrame,
    units: str = "units",
    codes: str = "codes",
    key: str = "key",
    max_source: int = K.MAX_SOURCE_POSITIONS,
    max_target: int = K.MAX_TARGET_POSITIONS,
    seed: int = 42,
) -> DataFrame:
    """P13 on time-major codes: crop both streams to the same window.

    ``sem[start : start + max_source]`` and ``codes[a : a + max_target]`` with
    ``a = start * max_target div max_source`` (exact integer form of
    ``int(start * ratio)``).
    """
    start = crop_start(F.col(key), F.size(units), max_source, seed)
    a = F.expr(f"cast(crop_start * {max_target} div {max_source} as int)")
    return (
        df.withColumn("crop_start", start)
        .withColumn("ac_start", a)
        .withColumn(units, safe_slice(units, F.col("crop_start"), F.lit(max_source)))
        .withColumn(codes, safe_slice(codes, F.col("ac_start"), F.lit(max_target)))
    )


def crop_semantic(sem: DataFrame, max_source: int = K.MAX_SOURCE_POSITIONS, seed: int = 42) -> DataFrame:
    """Semantic half of P13: ``crop_start`` and the cropped ``units``.

    Depends on the key and the semantic length only, so it runs before the
    pairing join and at most ``max_source`` units per row are shuffled.
    """
    return sem.withColumn("crop_start", crop_start(F.col("key"), F.size("units"), max_source, seed)).withColumn(
        "units", safe_slice("units", F.col("crop_start"), F.lit(max_source))
    )


def crop_pair(
    df: DataFrame,
    keep: int = K.CODEC_DEPTH,
    max_source: int = K.MAX_SOURCE_POSITIONS,
    max_target: int = K.MAX_TARGET_POSITIONS,
    seed: int = 42,
) -> DataFrame:
    """P12 + P13 fused on the stored layout of a paired row.

    Gathers only the ``keep * max_target`` cropped cells of the flat acoustic
    array instead of transposing the whole stream, and emits
    ``units`` (cropped) and time-major ``codes [n_a][keep]``.
    """
    codes = ragged.column(ragged.code_rows(keep), MATRIX, *_CELLS)
    return _placed(df, keep, max_source, max_target, seed).withColumn("codes", codes).drop("tokens", "n_a")


#: what a row's codes are cut from
_CELLS = ("tokens", "len_ac", "ac_start", "n_a")


def _placed(df: DataFrame, keep: int, max_source: int, max_target: int, seed: int) -> DataFrame:
    """Paired rows with cropped ``units`` and the frames to cut: ``ac_start`` and ``n_a``."""
    L = F.col("len_ac")
    stored = None if isinstance(df.schema["tokens"].dataType, T.ArrayType) else F.col("tokens.n")
    out = df
    if "crop_start" not in df.columns:  # not pre-cropped on the semantic side
        out = crop_semantic(out, max_source, seed)
    return (
        out.withColumn("ac_start", F.expr(f"cast(crop_start * {max_target} div {max_source} as int)"))
        .withColumn("n_a", F.greatest(F.lit(0), F.least(F.lit(max_target), L - F.col("ac_start"))).cast("int"))
        .withColumn("tokens", _deep_enough(F.col("tokens"), L, keep, stored))
    )


# ---------------------------------------------------------------- A3 (array form)


def run_length_units_array(df: DataFrame, units: str = "units", keep_durations: bool = False) -> DataFrame:
    """A3 array form: collapse consecutive equal units (``reduce``)."""
    out = df
    if keep_durations:
        out = out.withColumn("durations", run_lengths(units))
    return out.withColumn(units, dedupe_units(out, units))


# ---------------------------------------------------------------- P14 - P18


def source_encode(units, nspecial: int = K.NSPECIAL, eos: int = K.EOS) -> Column:
    """Unit + nspecial, then eos."""
    return ragged.column(ragged.unit_rows(nspecial, eos), "array<bigint>", units)


def target_encode(codes, depth: int, codec_dim: int = K.CODEC_DIM, nspecial: int = K.NSPECIAL, eos: int = K.EOS) -> Column:
    """Code + q * codec_dim + nspecial per codebook, then an all-eos row."""
    return ragged.column(ragged.target_rows(depth, codec_dim, nspecial, eos), MATRIX, codes)


def depth_tile(source, depth: int, pad: int = K.PAD) -> Column:
    """``[Ls+1] -> [Ls+1][depth]`` with columns 1.. set to pad."""
    return ragged.column(ragged.tiled_rows(depth, pad), MATRIX, source)


def lm_interleave(source2d, target2d, depth: int, shift: int = K.SOURCE_DICT_LEN, eos: int = K.EOS, pad: int = K.PAD) -> Column:
    """``[eos,pad..] + source[:-1] + (target[-1] + shift) + (target[:-1] + shift)``.

    Length ``1 + Ls + 1 + La`` - the shifted next-token input of one sample.
    """
    return ragged.column(ragged.interleaved_rows(depth, shift, eos, pad), MATRIX, source2d, target2d)


def _lm_rows(depth: int):
    """P12 and P14 to P17 of a row from its units and the cells of its codes, in one pass."""
    codes = ragged.code_rows(depth)
    source, tile = ragged.unit_rows(K.NSPECIAL, K.EOS), ragged.tiled_rows(depth, K.PAD)
    target = ragged.target_rows(depth, K.CODEC_DIM, K.NSPECIAL, K.EOS)
    interleave = ragged.interleaved_rows(depth, K.SOURCE_DICT_LEN, K.EOS, K.PAD)

    def work(units, *cells):
        return interleave(tile(source(units)), target(codes(*cells)))

    return work


def _packed_labels():
    """P14 of packed units, packed."""
    source = ragged.unit_rows(K.NSPECIAL, K.EOS)

    def row(units):
        return packed.pack(source(packed.unpack(units)).cast(pa.list_(pa.int32())))

    def work(units: pa.Array) -> pa.Array:
        return packed.in_parts(row, packed.sizes(units), units)

    return work


def _packed_target(depth: int):
    """P12 and P15 of the packed cells of a row's codes: the target, flat and packed."""
    codes, target = ragged.code_rows(depth), ragged.target_rows(depth, K.CODEC_DIM, K.NSPECIAL, K.EOS)

    def row(tokens, *cells):
        return packed.pack(ragged.flat_ints(target(codes(packed.unpack(tokens), *cells))))

    def work(tokens: pa.Array, length: pa.Array, start: pa.Array, frames: pa.Array) -> pa.Array:
        return packed.in_parts(row, packed.sizes(tokens), tokens, length, start, frames)

    return work


def encode_rows(df: DataFrame, depth: int = K.CODEC_DEPTH) -> DataFrame:
    """P14-P18 on cropped rows: ``source``, ``target``, ``src_tokens`` and labels."""
    return (
        df.withColumn("src_labels", source_encode("units"))
        .withColumn("source", depth_tile(F.col("src_labels"), depth))
        .withColumn("target", target_encode("codes", depth))
        .withColumn("src_tokens", lm_interleave(F.col("source"), F.col("target"), depth))
        .withColumn("src_length", F.size("source"))
        .withColumn("target_length", F.size("target"))
    )


def lm_labels(df: DataFrame) -> DataFrame:
    """``src_labels`` (= source column 0), ``target`` (= prev_output_tokens) and lengths."""
    return df.select(
        "key",
        ragged.column(ragged.first_values, "array<bigint>", "source").alias("src_labels"),
        F.col("target"),
        F.col("target").alias("prev_output_tokens"),
        (F.col("target_length") if "target_length" in df.columns else F.size("target")).alias("target_length"),
    )


# ---------------------------------------------------------------- composed E2 row builder


def assemble_rows(
    sem: DataFrame,
    ac: DataFrame,
    keep: int = K.CODEC_DEPTH,
    reduce: bool = True,
    max_source: int = K.MAX_SOURCE_POSITIONS,
    max_target: int = K.MAX_TARGET_POSITIONS,
    seed: int = 42,
    ids: DataFrame | None = None,
    pack: bool = False,
) -> DataFrame:
    """J1 -> P10 -> P12/P13 -> A3 -> P14-P17 for every paired key.

    ``ids`` (a key and what is to be known of it) meet the pairs before their
    rows are made, so that the join moves no assembled row.  With ``pack`` the
    streams meet packed (``functions.packed``), and of the arrays of a row only
    ``src_labels`` and ``target`` (its codes flat, as ints) are made, packed too.
    """
    sem = crop_semantic(sem.select("key", "len", "units"), max_source, seed)
    if reduce:
        sem = run_length_units_array(sem)
    paired = size_clip(pair_streams(sem, ac, keep=keep, extra=["crop_start"], pack=pack), max_source, max_target)
    if ids is not None:
        paired = paired.join(ids, "key")
    placed = _placed(paired, keep, max_source, max_target, seed)
    held = F.col("tokens").isNotNull() & F.col("len_ac").isNotNull() & F.col("ac_start").isNotNull()
    target_length = F.when(held, F.col("n_a") + 1).alias("target_length")
    if pack:
        return placed.select(
            *[c for c in placed.columns if c not in ("units", "tokens", "n_a")],
            ragged.column(_packed_labels(), packed.KIND, "units").alias("src_labels"),
            ragged.column(_packed_target(keep), packed.KIND, *_CELLS).alias("target"),
            (F.col("units.n") + 1).alias("src_length"),
            target_length,
        )
    codes = ragged.column(ragged.code_rows(keep), MATRIX, *_CELLS)
    return placed.select(
        *[c for c in placed.columns if c not in ("tokens", "n_a")],
        codes.alias("codes"),
        source_encode("units").alias("src_labels"),
        depth_tile(source_encode("units"), keep).alias("source"),
        target_encode(codes, keep).alias("target"),
        ragged.column(_lm_rows(keep), MATRIX, "units", *_CELLS).alias("src_tokens"),
        # the sizes of source and target, without making them
        (F.size("units") + 1).alias("src_length"),
        target_length,
    )


# ---------------------------------------------------------------- P23 - P26


def detokenize(ids, nspecial: int = K.NSPECIAL) -> Column:
    """Ids -> space-joined symbols; specials dropped, symbol of id i is ``str(i - nspecial)``."""
    return ragged.column(ragged.spelled(nspecial), "string", ids)


def prompt_slice(df: DataFrame, units: str = "units", codes: str = "codes", modes=(0, 1, 2, 3)) -> DataFrame:
    """Prompt of each mode, one row per (key, mode).

    0 none; 1 full semantic, no acoustic; 2 half semantic + half acoustic;
    3 half semantic only.  ``half = floor(len / 2)``.
    """
    mode = F.col("mode")
    half_s = F.floor(F.size(units) / 2).cast("int")
    half_a = F.floor(F.size(codes) / 2).cast("int")
    n_sem = F.when(mode == 0, 0).when(mode == 1, F.size(units)).otherwise(half_s)
    n_ac = F.when(mode == 2, half_a).otherwise(0)
    return (
        df.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
        .withColumn("prompt_units", safe_slice(units, F.lit(0), n_sem))
        .withColumn("prompt_codes", safe_slice(codes, F.lit(0), n_ac))
    )


def bandwidth_table(spark):
    """Codec bandwidth (kbps) -> codebook count; a fixed five-row table."""
    rows = [(float(bw), int(n)) for bw, n in sorted(K.BANDWIDTH_CODEBOOKS.items())]
    return spark.createDataFrame(rows, "bandwidth double, depth int")


def token_budget(sem: DataFrame, ac: DataFrame, src_hz: int = K.SEMANTIC_HZ, tgt_hz: int = K.ACOUSTIC_HZ) -> DataFrame:
    """P25: audit stored acoustic depth and length against bandwidth and duration.

    The depth maps to a bandwidth through the fixed codebook table (broadcast,
    five rows); the expected acoustic length is the semantic length at the
    frame-rate ratio (75 / 50 Hz).
    """
    bw = F.broadcast(bandwidth_table(ac.sparkSession))
    a = ac.select("key", "depth", F.col("len").alias("len_ac"))
    s = sem.select("key", F.col("len").alias("len_sem"))
    out = a.join(s, "key").join(bw, "depth", "left")
    expected = F.expr(f"cast(len_sem * {tgt_hz} div {src_hz} as int)")
    return out.select(
        "key",
        "depth",
        "bandwidth",
        "len_ac",
        expected.alias("expected_len_ac"),
        ((F.col("len_ac") == expected) & F.col("bandwidth").isNotNull()).alias("ok"),
    )


def subset_route(df: DataFrame, split: str = "split") -> DataFrame:
    """Splits naming a prompt go to the prompt builder; ``train*`` cannot be sharded."""
    return df.withColumn("builder", F.when(F.col(split).contains("prompt"), "prompt").otherwise("standard")).withColumn(
        "shardable", ~F.col(split).startswith("train")
    )


def check_shard_request(split: str, num_shards: int) -> None:
    """API-side validation of P26: sharded loading is refused for training splits."""
    if num_shards > 0 and split.startswith("train"):
        raise ValueError(f"sharded loading is not allowed for training split {split!r}")
