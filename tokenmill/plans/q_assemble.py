"""Registered queries for training-row assembly and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.functions.numeric import round_sql
from tokenmill.plans import fixtures as fx
from tokenmill.plans.flows import collated_batches, row_shapes, training_batches
from tokenmill.plans.oracle_views import add_view, u, with_views
from tokenmill.plans.registry import query

# ---------------------------------------------------------------- oracle building blocks

add_view(
    "ox_pair",
    ["fx_sem", "fx_ac"],
    "SELECT s.key, s.len AS len_sem, s.units, a.depth, a.len AS len_ac, a.tokens FROM fx_sem s JOIN fx_ac a USING (key)",
)
add_view(
    "ox_crop",
    ["ox_pair"],
    "SELECT *, list_slice(units, crop_start + 1, crop_start + 650) AS cu, (crop_start * 975 // 650)::INT AS ac_start, "
    "greatest(0, least(975, len_ac - (crop_start * 975 // 650)))::INT AS n_a FROM ("
    "SELECT *, least(len_sem, 650) AS len_s, least(len_ac, 975) AS len_a, "
    f"CASE WHEN len(units) <= 650 THEN 0 ELSE floor({u('crop', 'key')} * (len(units) - 650 + 1))::INT END AS crop_start "
    "FROM ox_pair)",
)
add_view(
    "ox_dedup",
    ["ox_crop"],
    "SELECT *, list_filter(cu, lambda x, i: i = 1 OR x <> cu[i - 1]) AS du FROM ox_crop",
)
add_view(
    "ox_shapes",
    ["ox_dedup"],
    "SELECT key, len_s, len(du) + 1 AS src_length, n_a + 1 AS target_length, len(du) + n_a + 2 AS row_length FROM ox_dedup",
)
add_view(
    "ox_ord",
    ["ox_shapes"],
    f"SELECT *, row_number() OVER (ORDER BY len_s, {u('shuffle', 'key')}, key) AS rn FROM ox_shapes",
)
# sequential greedy batching, one row per step: the brute-force twin of W2
add_view(
    "ox_walk",
    ["ox_ord"],
    "SELECT rn, 0::BIGINT AS batch_id, 1::BIGINT AS k FROM ox_ord WHERE rn = 1 UNION ALL "
    "SELECT o.rn, CASE WHEN (w.k + 1) * o.len_s > 6500 THEN w.batch_id + 1 ELSE w.batch_id END, "
    "CASE WHEN (w.k + 1) * o.len_s > 6500 THEN 1 ELSE w.k + 1 END FROM ox_walk w JOIN ox_ord o ON o.rn = w.rn + 1",
)
add_view("ox_batched", ["ox_walk", "ox_ord"], "SELECT o.*, w.batch_id FROM ox_ord o JOIN ox_walk w USING (rn)")


# ---------------------------------------------------------------- flagship


@query(
    "training_batches",
    with_views("ox_batched")
    + "SELECT batch_id, count(*) AS nsentences, sum(target_length)::BIGINT AS ntokens, "
    "max(src_length)::INT AS max_src_length, max(row_length)::INT AS padded_length, "
    "sum(row_length)::BIGINT AS real_cells, max(len_s)::INT AS max_len_s, "
    "(count(*) * max(len_s))::BIGINT AS budget_tokens, "
    f"{round_sql('1 - sum(row_length) / (count(*) * max(row_length))', 6)} AS padding_ratio "
    "FROM ox_batched GROUP BY batch_id",
)
def q_training_batches(spark, sf):
    return training_batches(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf))


@query(
    "batch_stats",
    with_views("ox_batched")
    + "SELECT batch_id, count(*) AS nsentences, sum(target_length)::BIGINT AS ntokens, "
    "max(src_length)::INT AS max_src_length, max(row_length)::INT AS padded_length, "
    "sum(row_length)::BIGINT AS real_cells, "
    f"{round_sql('1 - sum(row_length) / (count(*) * max(row_length))', 6)} AS padding_ratio "
    "FROM ox_batched GROUP BY batch_id",
)
def q_batch_stats(spark, sf):
    """A4 of the collated batches themselves."""
    from tokenmill.operators.collate import collated_stats

    return collated_stats(_collated(spark, sf))


@query(
    "token_budget_batches",
    with_views("ox_batched") + "SELECT key, len_s, batch_id FROM ox_batched",
)
def q_token_budget_batches(spark, sf):
    from tokenmill.operators.batching import token_budget_batches

    shapes = row_shapes(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf))
    return token_budget_batches(shapes.select("key", "len_s")).select("key", "len_s", "batch_id")


@query(
    "length_order",
    with_views("ox_ord") + "SELECT key, len_s, (rn - 1)::BIGINT AS order_rank FROM ox_ord",
)
def q_length_order(spark, sf):
    from tokenmill.operators.assemble import pair_streams, size_clip
    from tokenmill.operators.batching import length_order

    sizes = size_clip(pair_streams(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf), with_tokens=False))
    return length_order(sizes.select("key", "len_s")).select("key", "len_s", F.col("order_rank").cast("bigint"))


# ---------------------------------------------------------------- shared pieces

KEEP = 2  # stored depth 4, keep 2: the reference's 16 -> 8 ratio at test scale


def dg(list_sql: str) -> str:
    """DuckDB twin of :func:`tokenmill.functions.arrays.digest`."""
    return f"coalesce(list_sum(list_transform({list_sql}, lambda x, i: x * i)), 0)::BIGINT"


def _cropped(spark, sf, keep=KEEP):
    from tokenmill.operators.assemble import crop_pair, crop_semantic, pair_streams, size_clip

    sem = crop_semantic(fx.fx_sem(spark, sf))
    paired = pair_streams(sem, fx.fx_ac(spark, sf), keep=keep, extra=["crop_start"])
    return crop_pair(size_clip(paired), keep=keep)


def _rows(spark, sf, keep=KEEP, ids=None):
    from tokenmill.operators.assemble import assemble_rows

    return assemble_rows(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf), keep=keep, ids=ids)


def _sized(df, column: str, n: str = "n", digest: str = "digest"):
    """``key``, and the size and digest of one array column, which is made once for both."""
    from tokenmill.functions.arrays import sized_digest

    return df.select("key", sized_digest(column).alias("d")).select("key", F.col("d.n").alias(n), F.col("d.digest").alias(digest))


def _collated(spark, sf, keep=KEEP):
    # the streams meet on their key in an exchange of their own: their texts need none before
    return collated_batches(fx.fx_sem(spark, sf, spread=False), fx.fx_ac(spark, sf, spread=False), keep=keep)


# cropped codes of the first KEEP codebooks, flattened time-major, as DuckDB text
_CODES = "tokens[(j % 2) * len_ac + ac_start + j // 2 + 1]"


# ---------------------------------------------------------------- J1 / J2 / P10 / P11


@query(
    "pair_streams",
    with_views("fx_sem_gaps", "fx_ac_gaps")
    + "SELECT s.key, s.len AS len_sem, a.depth, a.len AS len_ac FROM fx_sem_gaps s JOIN fx_ac_gaps a USING (key)",
)
def q_pair_streams(spark, sf):
    from tokenmill.operators.assemble import pair_streams

    return pair_streams(fx.fx_sem_gaps(spark, sf), fx.fx_ac_gaps(spark, sf), with_tokens=False)


@query(
    "unpaired_keys",
    with_views("fx_sem_gaps", "fx_ac_gaps")
    + "SELECT key, 'acoustic' AS missing_from FROM (SELECT key FROM fx_sem_gaps EXCEPT SELECT key FROM fx_ac_gaps) "
    "UNION ALL SELECT key, 'semantic' FROM (SELECT key FROM fx_ac_gaps EXCEPT SELECT key FROM fx_sem_gaps)",
)
def q_unpaired_keys(spark, sf):
    from tokenmill.operators.assemble import unpaired_keys

    return unpaired_keys(fx.fx_sem_gaps(spark, sf), fx.fx_ac_gaps(spark, sf))


@query(
    "size_clip",
    with_views("ox_pair") + "SELECT key, least(len_sem, 650) AS len_s, least(len_ac, 975) AS len_a FROM ox_pair",
)
def q_size_clip(spark, sf):
    from tokenmill.operators.assemble import pair_streams, size_clip

    return size_clip(pair_streams(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf), with_tokens=False)).select(
        "key", "len_s", "len_a"
    )


@query(
    "size_filter",
    with_views("ox_pair")
    + "SELECT key, len_sem > 650 OR len_ac > 975 AS was_clipped, len_sem <= 650 AND len_ac <= 975 AS fits FROM ox_pair",
)
def q_size_filter(spark, sf):
    from tokenmill.operators.assemble import pair_streams, size_filter

    return size_filter(pair_streams(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf), with_tokens=False)).select(
        "key", "was_clipped", "fits"
    )


# ---------------------------------------------------------------- P12 / P13 / J5


@query(
    "codebook_truncate",
    with_views("fx_ac")
    + "SELECT key, len AS n_frames, 2 AS depth_kept, "
    "coalesce(list_sum(list_transform(range(0, len * 2), lambda j: tokens[(j % 2) * len + j // 2 + 1] * (j + 1))), 0)::BIGINT AS codes_digest "
    "FROM fx_ac",
)
def q_codebook_truncate(spark, sf):
    from tokenmill.functions.arrays import nested_digest
    from tokenmill.operators.assemble import codebook_truncate

    ac = fx.fx_ac(spark, sf).withColumn("codes", codebook_truncate("tokens", "len", KEEP))
    return ac.select(
        "key",
        F.size("codes").alias("n_frames"),
        F.size(F.get(F.col("codes"), 0)).alias("depth_kept"),
        nested_digest("codes").alias("codes_digest"),
    )


@query(
    "aligned_crop",
    with_views("ox_crop")
    + f"SELECT key, crop_start, ac_start, len(cu)::INT AS n_s, n_a, {dg('cu')} AS units_digest, "
    f"coalesce(list_sum(list_transform(range(0, n_a * 2), lambda j: {_CODES} * (j + 1))), 0)::BIGINT AS codes_digest "
    "FROM ox_crop",
)
def q_aligned_crop(spark, sf):
    from tokenmill.functions.arrays import digest, nested_digest

    return _cropped(spark, sf).select(
        "key",
        "crop_start",
        "ac_start",
        F.size("units").alias("n_s"),
        F.size("codes").alias("n_a"),
        digest("units").alias("units_digest"),
        nested_digest("codes").alias("codes_digest"),
    )


@query(
    "crop_range_join",
    with_views("ox_crop")
    + "SELECT key, count(*) AS n_cells, sum(code * ((t - ac_start) * 2 + q + 1))::BIGINT AS codes_digest FROM ("
    "SELECT key, ac_start, (p // len_ac)::INT AS q, (p % len_ac)::INT AS t, tokens[p + 1] AS code "
    "FROM (SELECT key, ac_start, len_ac, tokens, unnest(range(0, len_ac * 2)) AS p FROM ox_crop)) "
    "WHERE t >= ac_start AND t < ac_start + 975 GROUP BY key",
)
def q_crop_range_join(spark, sf):
    from tokenmill.operators.joins import crop_range_join
    from tokenmill.operators.assemble import crop_start

    paired = fx.fx_sem(spark, sf).select("key", "units").join(fx.fx_ac(spark, sf), "key")
    crops = paired.select("key", crop_start(F.col("key"), F.size("units")).alias("crop_start"))
    cells = crop_range_join(fx.fx_ac(spark, sf), crops, keep=KEEP)
    return cells.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum(F.col("code") * (F.col("t_out") * KEEP + F.col("q") + 1)).cast("bigint").alias("codes_digest"),
    )


# ---------------------------------------------------------------- A3


@query(
    "run_length_units_array",
    with_views("fx_sem")
    + "SELECT key, len(du)::INT AS n_runs, "
    + dg("du")
    + " AS units_digest, "
    + dg("dur")
    + " AS durations_digest FROM (SELECT key, list_filter(units, lambda x, i: i = 1 OR x <> units[i - 1]) AS du, "
    "list_transform(st, lambda s, j: coalesce(st[j + 1], len(units) + 1) - s) AS dur FROM ("
    "SELECT key, units, list_filter(range(1, len(units) + 1), lambda i: i = 1 OR units[i] <> units[i - 1]) AS st FROM fx_sem))",
)
def q_run_length_units_array(spark, sf):
    from tokenmill.functions.arrays import digest
    from tokenmill.operators.assemble import run_length_units_array

    df = run_length_units_array(fx.fx_sem(spark, sf), keep_durations=True)
    return df.select(
        "key", F.size("units").alias("n_runs"), digest("units").alias("units_digest"), digest("durations").alias("durations_digest")
    )


@query(
    "run_length_units",
    with_views("fx_runs")
    + "SELECT user_id, min(pos) AS run_start, any_value(unit) AS unit, count(*) AS run_len FROM ("
    "SELECT *, sum(CASE WHEN prev IS NULL OR prev <> unit THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run_id FROM ("
    "SELECT *, lag(unit) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM fx_runs)) GROUP BY user_id, run_id",
)
def q_run_length_units(spark, sf):
    from tokenmill.operators.aggregates import run_length_units

    return run_length_units(fx.fx_runs(spark, sf), ["user_id"], "pos", "unit")


# ---------------------------------------------------------------- P14 - P18


@query(
    "source_encode",
    with_views("fx_sem")
    + "SELECT key, (len(units) + 1)::INT AS n, "
    + dg("list_append(list_transform(units, lambda x: x + 4), 2)")
    + " AS digest FROM fx_sem",
)
def q_source_encode(spark, sf):
    from tokenmill.operators.assemble import source_encode

    return _sized(fx.fx_sem(spark, sf).withColumn("src", source_encode("units")), "src")


_TGT_WHOLE = (
    "coalesce(list_sum(list_transform(range(0, (len + 1) * 2), lambda j: "
    "(CASE WHEN j // 2 < len THEN tokens[(j % 2) * len + j // 2 + 1] + (j % 2) * 1024 + 4 ELSE 2 END) * (j + 1))), 0)::BIGINT"
)


@query(
    "target_encode",
    with_views("fx_ac") + f"SELECT key, (len + 1)::INT AS n_rows, {_TGT_WHOLE} AS digest FROM fx_ac",
)
def q_target_encode(spark, sf):
    from tokenmill.operators.assemble import codebook_truncate, target_encode

    ac = fx.fx_ac(spark, sf).withColumn("target", target_encode(codebook_truncate("tokens", "len", KEEP), KEEP))
    return _sized(ac, "target", "n_rows")


@query(
    "depth_tile",
    with_views("fx_sem")
    + "SELECT key, (len(units) + 1)::INT AS n_rows, coalesce(list_sum(list_transform(range(0, (len(units) + 1) * 2), lambda j: "
    "(CASE WHEN j % 2 = 1 THEN 1 WHEN j // 2 < len(units) THEN units[j // 2 + 1] + 4 ELSE 2 END) * (j + 1))), 0)::BIGINT AS digest "
    "FROM fx_sem",
)
def q_depth_tile(spark, sf):
    from tokenmill.operators.assemble import depth_tile, source_encode

    return _sized(fx.fx_sem(spark, sf).withColumn("source", depth_tile(source_encode("units"), KEEP)), "source", "n_rows")


_ROW_CELL = (
    "CASE WHEN j // 2 = 0 THEN (CASE WHEN j % 2 = 0 THEN 2 ELSE 1 END) "
    "WHEN j // 2 <= len(du) THEN (CASE WHEN j % 2 = 0 THEN du[j // 2] + 4 ELSE 1 END) "
    "WHEN j // 2 = len(du) + 1 THEN 10006 "
    "ELSE tokens[(j % 2) * len_ac + ac_start + (j // 2 - len(du) - 2) + 1] + (j % 2) * 1024 + 4 + 10004 END"
)


@query(
    "lm_interleave",
    with_views("ox_dedup")
    + "SELECT key, (len(du) + n_a + 2)::INT AS n_rows, "
    f"coalesce(list_sum(list_transform(range(0, (len(du) + n_a + 2) * 2), lambda j: ({_ROW_CELL}) * (j + 1))), 0)::BIGINT AS digest "
    "FROM ox_dedup",
)
def q_lm_interleave(spark, sf):
    return _sized(_rows(spark, sf), "src_tokens", "n_rows")


@query(
    "lm_labels",
    with_views("ox_dedup")
    + "SELECT key, (len(du) + 1)::INT AS n_labels, "
    + dg("list_append(list_transform(du, lambda x: x + 4), 2)")
    + " AS labels_digest, (n_a + 1)::INT AS target_length, "
    "coalesce(list_sum(list_transform(range(0, (n_a + 1) * 2), lambda j: "
    f"(CASE WHEN j // 2 < n_a THEN {_CODES} + (j % 2) * 1024 + 4 ELSE 2 END) * (j + 1))), 0)::BIGINT AS target_digest "
    "FROM ox_dedup",
)
def q_lm_labels(spark, sf):
    from tokenmill.functions.arrays import nested_digest, sized_digest
    from tokenmill.operators.assemble import lm_labels

    labels = lm_labels(_rows(spark, sf)).select(
        "key", sized_digest("src_labels").alias("d"), "target_length", nested_digest("prev_output_tokens").alias("target_digest")
    )
    return labels.select("key", F.col("d.n").alias("n_labels"), F.col("d.digest").alias("labels_digest"), "target_length", "target_digest")


@query(
    "target_unoffset",
    with_views("fx_ac")
    + "SELECT key, (len + 1)::INT AS n_rows, coalesce(list_sum(list_transform(range(0, (len + 1) * 2), lambda j: "
    "(CASE WHEN j // 2 < len THEN tokens[(j % 2) * len + j // 2 + 1] + 4 ELSE 2 END) * (j + 1))), 0)::BIGINT AS digest FROM fx_ac",
)
def q_target_unoffset(spark, sf):
    from tokenmill.functions.arrays import nested_digest
    from tokenmill.operators.assemble import codebook_truncate, target_encode
    from tokenmill.operators.scoring import target_unoffset

    ac = fx.fx_ac(spark, sf).withColumn("target", target_encode(codebook_truncate("tokens", "len", KEEP), KEEP))
    ac = ac.withColumn("labels", target_unoffset("target"))
    return ac.select("key", F.size("labels").alias("n_rows"), nested_digest("labels").alias("digest"))


# ---------------------------------------------------------------- P20 / P21 / P22 / W4


def _batched_rows(spark, sf):
    from tokenmill.operators.batching import token_budget_batches

    shapes = row_shapes(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf)).select("key", "len_s")
    return _rows(spark, sf, ids=token_budget_batches(shapes).select("key", "batch_id"))


@query(
    "position_class",
    with_views("ox_batched")
    + "SELECT key, batch_id, src_length::BIGINT AS n_semantic, target_length::BIGINT AS n_acoustic, "
    "(max(row_length) OVER (PARTITION BY batch_id) - row_length)::BIGINT AS n_pad FROM ox_batched",
)
def q_position_class(spark, sf):
    from tokenmill.operators.scoring import position_class_counts

    return position_class_counts(_batched_rows(spark, sf)).select("key", "batch_id", "n_semantic", "n_acoustic", "n_pad")


# every sample of a batch in order, with its arrays and where it starts
add_view(
    "ox_collate",
    ["ox_batched", "ox_dedup"],
    "SELECT b.batch_id, b.key, b.src_length, b.target_length, b.row_length, d.n_a, d.du, d.tokens, d.len_ac, d.ac_start, "
    "list_append(list_transform(d.du, lambda x: x + 4), 2) AS labels, "
    "row_number() OVER w AS i, sum(b.row_length) OVER w - b.row_length AS src_at, sum(b.target_length) OVER w - b.target_length AS target_at, "
    "sum(b.src_length) OVER w - b.src_length AS label_at "
    "FROM ox_batched b JOIN ox_dedup d USING (key) "
    "WINDOW w AS (PARTITION BY b.batch_id ORDER BY b.src_length DESC, b.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
_TARGET_CELL = f"CASE WHEN j // 2 < n_a THEN {_CODES} + (j % 2) * 1024 + 4 ELSE 2 END"


def _in_order(cells: str) -> str:
    return dg(f"flatten(list({cells} ORDER BY i))")


def _offsets(start: str, size: str) -> str:
    return dg(f"list_append(list({start} ORDER BY i), sum({size}))")


@query(
    "collated_batches",
    with_views("ox_collate")
    + "SELECT batch_id, count(*) AS nsentences, sum(target_length)::BIGINT AS ntokens, string_agg(key, ',' ORDER BY i) AS keys, "
    "md5(string_agg(array_to_string(list_transform(du, lambda x: x::VARCHAR), ' '), '|' ORDER BY i)) AS texts_md5, "
    f"{dg('list(src_length ORDER BY i)')} AS src_lengths, {dg('list(target_length ORDER BY i)')} AS target_lengths, "
    f"{_offsets('src_at', 'row_length')} AS src_offsets, "
    f"{_in_order(f'list_transform(range(0, row_length * 2), lambda j: {_ROW_CELL})')} AS src_tokens, "
    f"{_offsets('target_at', 'target_length')} AS target_offsets, "
    f"{_in_order(f'list_transform(range(0, target_length * 2), lambda j: {_TARGET_CELL})')} AS target, "
    f"{_offsets('label_at', 'src_length')} AS label_offsets, {_in_order('labels')} AS src_labels, "
    "max(row_length)::INT AS padded_length, max(target_length)::INT AS padded_target FROM ox_collate GROUP BY batch_id",
)
def q_collated_batches(spark, sf):
    """A4 with W4, P17 and P18: the arrays of every batch, one ragged row each."""
    from tokenmill.functions.arrays import digest

    arrays = ("src_lengths", "target_lengths", "src_offsets", "src_tokens", "target_offsets", "target", "label_offsets", "src_labels")
    return _collated(spark, sf).select(
        "batch_id", F.col("nsentences").cast("bigint").alias("nsentences"), "ntokens",
        F.array_join("keys", ",").alias("keys"), F.md5(F.array_join("src_texts", "|").cast("binary")).alias("texts_md5"),
        *[digest(c).alias(c) for c in arrays], "padded_length", "padded_target",
    )


@query(
    "frame_mask",
    with_views("ox_batched")
    + "SELECT batch_id, (count(*) * max(target_length))::BIGINT AS n_frames, sum(target_length)::BIGINT AS n_kept "
    "FROM ox_batched GROUP BY batch_id",
)
def q_frame_mask(spark, sf):
    from tokenmill.operators.collate import frame_mask

    return frame_mask(_collated(spark, sf))


@query(
    "kept_frames",
    with_views("ox_collate")
    + "SELECT batch_id, target_at + f AS flat, key, f::INT AS frame, "
    "CASE WHEN f < n_a THEN tokens[ac_start + f + 1] + 4 ELSE 2 END::INT AS code0, "
    "CASE WHEN f < n_a THEN tokens[len_ac + ac_start + f + 1] + 1028 ELSE 2 END::INT AS code1 "
    "FROM (SELECT *, unnest(range(0, target_length)) AS f FROM ox_collate)",
)
def q_kept_frames(spark, sf):
    """Every kept frame with its place in the flattened batch and its codes."""
    from tokenmill.operators.collate import kept_frames

    frames = kept_frames(_collated(spark, sf))
    return frames.select(
        "batch_id", "flat", "key", "frame", F.get("codes", F.lit(0)).alias("code0"), F.get("codes", F.lit(1)).alias("code1")
    )


@query(
    "local_drop",
    with_views("ox_crop")
    + "SELECT key, count(*) AS n_frames, count(*) FILTER (WHERE rk <= k) AS n_kept, "
    "coalesce(sum(t + 1) FILTER (WHERE rk <= k), 0)::BIGINT AS kept_digest FROM ("
    f"SELECT key, t, k, row_number() OVER (PARTITION BY key ORDER BY {u('drop', "key || '#' || t")}, t) AS rk FROM ("
    "SELECT key, least(n_a + 1, floor((n_a + 1) * (1 - 0.5) + 1))::BIGINT AS k, unnest(range(0, n_a + 1)) AS t FROM ox_crop)) "
    "GROUP BY key",
)
def q_local_drop(spark, sf):
    from tokenmill.operators.assemble import target_encode
    from tokenmill.operators.scoring import local_drop

    rows = _cropped(spark, sf).withColumn("target", target_encode("codes", KEEP))
    kept = local_drop(rows, "target", p=0.5)
    return kept.select(
        "key",
        F.col("n_frames").cast("bigint").alias("n_frames"),
        F.size("kept_frames").cast("bigint").alias("n_kept"),
        F.aggregate("kept_frames", F.lit(0).cast("bigint"), lambda a, t: a + t + 1).alias("kept_digest"),
    )


@query(
    "batch_row_order",
    with_views("ox_batched")
    + "SELECT key, batch_id, (row_number() OVER (PARTITION BY batch_id ORDER BY src_length DESC, key) - 1)::INT AS rank_in_batch "
    "FROM ox_batched",
)
def q_batch_row_order(spark, sf):
    from tokenmill.operators.batching import batch_row_order, token_budget_batches

    shapes = row_shapes(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf))
    return batch_row_order(token_budget_batches(shapes)).select("key", "batch_id", "rank_in_batch")


# ---------------------------------------------------------------- P23 / P24 / P25 / P26


@query(
    "detokenize",
    with_views("ox_dedup") + "SELECT key, array_to_string(list_transform(du, lambda x: CAST(x AS VARCHAR)), ' ') AS text FROM ox_dedup",
)
def q_detokenize(spark, sf):
    from tokenmill.operators.assemble import detokenize

    return _rows(spark, sf).select("key", detokenize("src_labels").alias("text"))


@query(
    "prompt_slice",
    with_views("ox_dedup")
    + "SELECT key, mode, n_sem::INT AS n_sem, n_ac::INT AS n_ac, "
    + dg("list_slice(du, 1, n_sem)")
    + f" AS sem_digest, {dg(f'list_transform(range(0, n_ac * 2), lambda j: {_CODES})')} AS ac_digest FROM (SELECT *, "
    "CASE mode WHEN 0 THEN 0 WHEN 1 THEN len(du) ELSE len(du) // 2 END AS n_sem, "
    "CASE mode WHEN 2 THEN n_a // 2 ELSE 0 END AS n_ac FROM (SELECT *, unnest([0, 1, 2, 3]) AS mode FROM ox_dedup))",
)
def q_prompt_slice(spark, sf):
    from tokenmill.functions.arrays import digest, nested_digest
    from tokenmill.operators.assemble import prompt_slice, run_length_units_array

    rows = run_length_units_array(_cropped(spark, sf))
    out = prompt_slice(rows, "units", "codes")
    return out.select(
        "key", "mode", F.size("prompt_units").alias("n_sem"), F.size("prompt_codes").alias("n_ac"), digest("prompt_units").alias("sem_digest"),
        nested_digest("prompt_codes").alias("ac_digest"),
    )


@query(
    "token_budget",
    with_views("fx_sem", "fx_ac")
    + "SELECT a.key, a.depth, CASE a.depth WHEN 2 THEN 1.5 WHEN 4 THEN 3.0 WHEN 8 THEN 6.0 WHEN 16 THEN 12.0 WHEN 32 THEN 24.0 END::DOUBLE AS bandwidth, "
    "a.len AS len_ac, (s.len * 75 // 50)::INT AS expected_len_ac, a.len = s.len * 75 // 50 AND a.depth IN (2, 4, 8, 16, 32) AS ok "
    "FROM fx_ac a JOIN fx_sem s USING (key)",
)
def q_token_budget(spark, sf):
    from tokenmill.operators.assemble import token_budget

    return token_budget(fx.fx_sem(spark, sf), fx.fx_ac(spark, sf))


@query(
    "subset_route",
    with_views("fx_clips")
    + "SELECT key, split, CASE WHEN contains(split, 'prompt') THEN 'prompt' ELSE 'standard' END AS builder, "
    "NOT starts_with(split, 'train') AS shardable FROM ("
    f"SELECT key, concat(CASE WHEN {u('split', 'key')} > 0.1 THEN 'train' ELSE 'valid' END, '-', split_part(key, '/', 2), "
    "CASE WHEN n % 2 = 0 THEN '' ELSE '_prompt' END) AS split FROM fx_clips)",
)
def q_subset_route(spark, sf):
    from tokenmill.functions.hashing import uniform
    from tokenmill.operators.assemble import subset_route

    clips = fx.fx_clips(spark, sf)
    split = F.concat(
        F.when(uniform("split", F.col("key")) > 0.1, "train").otherwise("valid"),
        F.lit("-"),
        F.split(F.col("key"), "/").getItem(1),
        F.when(F.col("n") % 2 == 0, "").otherwise("_prompt"),
    )
    return subset_route(clips.select("key", split.alias("split"))).select("key", "split", "builder", "shardable")
