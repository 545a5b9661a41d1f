"""Registered queries for encoder-side vector work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.functions.numeric import round_sql
from tokenmill.plans import fixtures as fx
from tokenmill.plans.oracle_views import add_view, with_views
from tokenmill.plans.registry import query

_DIST = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i]::DOUBLE - c[i]::DOUBLE) ** 2))"

add_view(
    "ox_j7",
    ["fx_frames", "fx_books"],
    "SELECT id, cid AS unit FROM (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS rn FROM ("
    f"SELECT f.id, b.cid, {_DIST} AS dist FROM fx_frames f, (SELECT cid, c FROM fx_books WHERE q = 0) b)) WHERE rn = 1",
)
add_view(
    "ox_res",
    ["fx_frames", "ox_j7", "fx_books"],
    "SELECT f.id, j.unit, list_transform(range(1, len(f.v) + 1), lambda i: f.v[i]::DOUBLE - b.c[i]::DOUBLE) AS r "
    "FROM fx_frames f JOIN ox_j7 j USING (id) JOIN fx_books b ON b.q = 0 AND b.cid = j.unit",
)
add_view(
    "ox_j8b",
    ["ox_res", "fx_books"],
    "SELECT id, cid AS code FROM (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS rn FROM ("
    "SELECT r0.id, b.cid, list_sum(list_transform(range(1, len(r0.r) + 1), lambda i: (r0.r[i] - b.c[i]::DOUBLE) ** 2)) AS dist "
    "FROM ox_res r0, (SELECT cid, c FROM fx_books WHERE q = 1) b)) WHERE rn = 1",
)


@query("nearest_unit", with_views("ox_j7") + "SELECT id, unit FROM ox_j7")
def q_nearest_unit(spark, sf):
    from tokenmill.operators.quantize import nearest_unit

    books = fx.fx_books(spark, sf).where("q = 0")
    return nearest_unit(fx.fx_frames(spark, sf), books)


@query(
    "residual_codes",
    with_views("ox_j7", "ox_j8b")
    + "SELECT id, 0 AS q, unit AS code FROM ox_j7 UNION ALL SELECT id, 1, code FROM ox_j8b",
)
def q_residual_codes(spark, sf):
    from tokenmill.operators.quantize import residual_codes

    return residual_codes(fx.fx_frames(spark, sf), fx.fx_books(spark, sf), n_q=2)


@query(
    "waveform_zscore",
    with_views("fx_frames")
    + f"SELECT id, (i - 1)::INT AS i, {round_sql('(v[i]::DOUBLE - m) / sqrt(var + 1e-5)', 6)} AS z FROM ("
    "SELECT id, v, list_avg(list_transform(v, lambda x: x::DOUBLE)) AS m, "
    "list_aggregate(list_transform(v, lambda x: x::DOUBLE), 'var_pop') AS var, unnest(range(1, len(v) + 1)) AS i FROM fx_frames)",
)
def q_waveform_zscore(spark, sf):
    from tokenmill.functions.numeric import round_half_up
    from tokenmill.operators.features import waveform_zscore

    z = fx.fx_frames(spark, sf).select("id", waveform_zscore("v").alias("z"))
    return z.select("id", F.posexplode("z").alias("i", "z")).select("id", "i", round_half_up("z", 6).alias("z"))


@query(
    "pad_to_multiple",
    with_views("fx_sem")
    + "SELECT key, micro_batch, target::INT AS padded_len, (target - len)::INT AS n_pad, "
    "max(target - len) OVER (PARTITION BY micro_batch) > 0 AS mask_present, "
    "(coalesce(list_sum(list_transform(units, lambda x, i: x * i)), 0) + (target * (target + 1) // 2 - len * (len + 1) // 2))::BIGINT AS pad_digest "
    "FROM (SELECT *, (ceil(max(len) OVER (PARTITION BY micro_batch) / 2) * 2)::BIGINT AS target FROM ("
    "SELECT key, len, units, ((row_number() OVER (ORDER BY key) - 1) // 128)::BIGINT AS micro_batch FROM fx_sem))",
)
def q_pad_to_multiple(spark, sf):
    from tokenmill.functions.arrays import digest
    from tokenmill.operators.features import pad_rows

    padded = pad_rows(fx.fx_sem(spark, sf).select("key", "units"), "units", size=128, multiple=2, pad=1)
    return padded.select(
        "key",
        "micro_batch",
        F.size("padded").alias("padded_len"),
        (F.size("padded") - F.size("units")).alias("n_pad"),
        F.col("padding_mask").isNotNull().alias("mask_present"),
        digest("padded").alias("pad_digest"),
    )
