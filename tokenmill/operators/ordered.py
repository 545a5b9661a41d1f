"""Skew-safe ordered scans: running sums, row numbers and run detection.

A ``Window.partitionBy(g).orderBy(o)`` puts every row of a group into one
task.  When one group holds a third of the corpus (every clip longer than
13 s clips to the same length; one speaker dominates a stream) that task is
the whole job.  The scans here split hot groups instead:

1. ``repartitionByRange`` on ``(group, order)`` - Spark samples the sort key,
   so a hot group is cut across many partitions while the global order is kept;
2. one Arrow-batched ``mapInPandas`` pass computes the scan inside each
   partition and tags rows with ``(partition id, index in partition)``;
3. the tagged data is checkpointed (reliable, in ``spark.checkpoint.dir``) so
   partition boundaries cannot move under a retried or re-planned task;
4. one aggregate returns one summary row per partition - O(#partitions),
   never O(rows) - and the driver folds these into a carry per partition;
5. the carries (again O(#partitions) rows, a proven size bound) are broadcast
   and added to the rows of the group a partition starts with.

Order columns must make the order total within a group (add a tie-break
column such as the key), otherwise results of tied rows are arbitrary.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.workers import trimmed
from tokenmill.session import checkpointed

_NULL = "\x00<null>"


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range partitions for a scan: explicit, else sized like the (materialised) input.

    Twice the input's partition count (files are split by
    ``spark.sql.files.maxPartitionBytes``), capped by
    ``spark.sql.shuffle.partitions``: a small input does not fan out into
    hundreds of empty tasks, a 100 TB input gets the cluster's full width.
    """
    if num_partitions:
        return int(num_partitions)
    cap = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(cap, 2 * df.rdd.getNumPartitions()))


def _group_ids(pdf: pd.DataFrame, group_cols: list[str]) -> np.ndarray:
    """0-based id of each run of equal group keys inside a sorted batch."""
    if not group_cols:
        return np.zeros(len(pdf), dtype=np.int64)
    g = pdf[group_cols].astype(object).where(pdf[group_cols].notna(), _NULL)
    change = (g != g.shift()).any(axis=1).to_numpy()
    change[0] = True
    return np.cumsum(change) - 1


def _key(pdf: pd.DataFrame, group_cols: list[str], i: int) -> tuple:
    return tuple(_NULL if pd.isna(v) else v for v in (pdf[c].iloc[i] for c in group_cols))


def _row_key(row, group_cols: list[str]) -> tuple:
    return tuple(_NULL if row[c] is None else row[c] for c in group_cols)


def _checkpoint(df: DataFrame) -> DataFrame:
    return checkpointed(df)


def running_sums(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list,
    values: dict[str, Column | None],
    num_partitions: int | None = None,
    materialized: bool = False,
) -> DataFrame:
    """Append running sums (inclusive) of ``values`` within ``group_cols``.

    ``values`` maps an output column to a numeric expression; ``None`` counts
    rows, i.e. yields a 1-based ``row_number``.  Integer expressions give
    ``bigint`` sums, anything else ``double``.  ``materialized=True`` says
    the input is already a checkpoint, so it is not written again.
    """
    spark = df.sparkSession
    order_exprs = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    names = list(values)
    tmp = [f"__v{j}" for j in range(len(names))]
    staged = df
    kinds = []
    for t, (name, expr) in zip(tmp, values.items()):
        e = F.lit(1).cast("bigint") if expr is None else expr
        staged = staged.withColumn(t, e)
    for t in tmp:
        dt = staged.schema[t].dataType
        kinds.append(T.LongType() if isinstance(dt, (T.IntegralType, T.BooleanType)) else T.DoubleType())
        staged = staged.withColumn(t, F.col(t).cast(kinds[-1]))

    keys = [F.col(c) for c in group_cols] + order_exprs
    # range partitioning samples its input in a separate job: materialise the
    # (narrow) input once so the sample and the scan read the same rows
    if not materialized:
        staged = _checkpoint(staged)
    n = _num_partitions(staged, num_partitions)
    ordered = staged.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    out_fields = [f for f in staged.schema.fields if f.name not in tmp]
    out_schema = T.StructType(
        out_fields
        + [T.StructField(nm, k, True) for nm, k in zip(names, kinds)]
        + [T.StructField("__scan_pid", T.IntegerType(), False), T.StructField("__scan_idx", T.LongType(), False)]
    )
    keep_cols = [f.name for f in out_fields]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        idx = 0
        carry_key = None
        carry = [0] * len(tmp)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            gid = _group_ids(pdf, group_cols)
            first_key = _key(pdf, group_cols, 0)
            out = pdf[keep_cols].copy()
            for j, (t, nm) in enumerate(zip(tmp, names)):
                v = pdf[t].fillna(0)
                cs = v.groupby(gid).cumsum().to_numpy()
                if carry_key is not None and first_key == carry_key:
                    cs = cs + np.where(gid == 0, carry[j], 0)
                out[nm] = cs
                carry[j] = cs[-1]
            out["__scan_pid"] = np.int32(pid)
            out["__scan_idx"] = np.arange(idx, idx + len(pdf), dtype=np.int64)
            idx += len(pdf)
            carry_key = _key(pdf, group_cols, len(pdf) - 1)
            yield out

    local = _checkpoint(ordered.mapInPandas(trimmed(scan), out_schema))

    gstruct = F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.lit(0)
    stats = (
        local.groupBy("__scan_pid")
        .agg(
            F.min_by(gstruct, "__scan_idx").alias("first"),
            F.max_by(gstruct, "__scan_idx").alias("last"),
            *[F.max_by(F.col(nm), "__scan_idx").alias(f"last_{j}") for j, nm in enumerate(names)],
        )
        .collect()  # one row per partition
    )
    stats.sort(key=lambda r: r["__scan_pid"])

    rows = []
    prev_last = None
    carry = [0] * len(names)
    for r in stats:
        first = _row_key(r["first"], group_cols) if group_cols else ()
        last = _row_key(r["last"], group_cols) if group_cols else ()
        off = list(carry) if (prev_last is not None and first == prev_last) else [0] * len(names)
        if any(off):
            first_vals = [r["first"][c] for c in group_cols] if group_cols else []
            rows.append((r["__scan_pid"], *first_vals, *off))
        last_vals = [r[f"last_{j}"] or 0 for j in range(len(names))]
        carry = [o + v for o, v in zip(off, last_vals)] if first == last else last_vals
        prev_last = last

    if not rows:
        return local.drop("__scan_pid", "__scan_idx")

    off_schema = T.StructType(
        [T.StructField("__scan_pid", T.IntegerType(), False)]
        + [T.StructField(f"__first_{c}", df.schema[c].dataType, True) for c in group_cols]
        + [T.StructField(f"__off{j}", k, True) for j, k in enumerate(kinds)]
    )
    # one row per partition that continues a group from earlier partitions
    offsets = spark.createDataFrame(rows, off_schema)
    joined = local.join(F.broadcast(offsets), "__scan_pid", "left")
    if group_cols:
        same = F.lit(True)
        for c in group_cols:
            same = same & F.col(c).eqNullSafe(F.col(f"__first_{c}"))
    else:
        same = F.lit(True)
    for j, nm in enumerate(names):
        joined = joined.withColumn(nm, F.col(nm) + F.when(same, F.coalesce(F.col(f"__off{j}"), F.lit(0))).otherwise(0))
    drop = ["__scan_pid", "__scan_idx"] + [f"__off{j}" for j in range(len(names))] + [f"__first_{c}" for c in group_cols]
    return joined.drop(*drop)


def row_number_within(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list,
    out: str = "rn",
    num_partitions: int | None = None,
    materialized: bool = False,
) -> DataFrame:
    """Skew-safe ``row_number() over (partition by group order by order)``, 1-based."""
    return running_sums(df, group_cols, order_cols, {out: None}, num_partitions, materialized)


def global_index(df: DataFrame, order_cols: list, out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in a total order, without a single-task sort."""
    res = running_sums(df, [], order_cols, {out: None}, num_partitions)
    return res.withColumn(out, F.col(out) - 1)


def run_starts(
    df: DataFrame,
    group_cols: list[str],
    pos_col: str,
    value_col: str,
    out: str = "run_start",
    num_partitions: int | None = None,
) -> DataFrame:
    """Tag each row with the ``pos`` where its run of equal ``value`` starts.

    A run is a maximal stretch of consecutive rows (by ``pos``) in a group
    with equal ``value``.  Grouping the result by ``(group, run_start)`` gives
    gaps-and-islands runs; that aggregate is algebraic, so even one run
    holding a third of the rows is combined map-side.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group_cols] + [F.col(pos_col)]
    staged = _checkpoint(df)
    n = _num_partitions(staged, num_partitions)
    ordered = staged.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    pos_type = df.schema[pos_col].dataType
    out_schema = T.StructType(
        list(df.schema.fields)
        + [
            T.StructField(out, pos_type, True),
            T.StructField("__scan_pid", T.IntegerType(), False),
            T.StructField("__scan_idx", T.LongType(), False),
        ]
    )
    cols = list(df.columns)
    out_name = out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        idx = 0
        prev = None  # (group key, value, run_start) of the previous row
        for pdf in batches:
            if len(pdf) == 0:
                continue
            gid = _group_ids(pdf, group_cols)
            vals = pdf[value_col].astype(object).where(pdf[value_col].notna(), _NULL).to_numpy()
            start = np.ones(len(pdf), dtype=bool)
            start[1:] = (gid[1:] != gid[:-1]) | (vals[1:] != vals[:-1])
            pos = pdf[pos_col].to_numpy()
            if prev is not None and prev[0] == _key(pdf, group_cols, 0) and prev[1] == vals[0]:
                start[0] = False
            # running "last start" via forward fill of start positions
            marks = pd.Series(pos, dtype="Int64").where(start)
            if prev is None:
                marks.iloc[0] = pd.NA  # provisional head run, resolved from partition summaries
            elif not start[0]:
                marks.iloc[0] = prev[2]
            filled = marks.ffill()
            out = pdf[cols].copy()
            out[out_name] = filled.to_numpy()
            out["__scan_pid"] = np.int32(pid)
            out["__scan_idx"] = np.arange(idx, idx + len(pdf), dtype=np.int64)
            idx += len(pdf)
            prev = (_key(pdf, group_cols, len(pdf) - 1), vals[-1], filled.iloc[-1])
            yield out

    local = _checkpoint(ordered.mapInPandas(trimmed(scan), out_schema))

    gstruct = F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.lit(0)
    stats = (
        local.groupBy("__scan_pid")
        .agg(
            F.min_by(gstruct, "__scan_idx").alias("first_g"),
            F.min_by(F.col(value_col), "__scan_idx").alias("first_v"),
            F.min_by(F.col(pos_col), "__scan_idx").alias("first_pos"),
            F.max_by(gstruct, "__scan_idx").alias("last_g"),
            F.max_by(F.col(value_col), "__scan_idx").alias("last_v"),
            F.max_by(F.col(out), "__scan_idx").alias("last_rs"),
        )
        .collect()  # one row per partition
    )
    stats.sort(key=lambda r: r["__scan_pid"])
    fix = []
    prev = None  # (group, value, resolved run start) of the previous partition's last row
    for r in stats:
        fg = _row_key(r["first_g"], group_cols) if group_cols else ()
        lg = _row_key(r["last_g"], group_cols) if group_cols else ()
        continues = prev is not None and prev[0] == fg and prev[1] == r["first_v"]
        head_start = prev[2] if continues else r["first_pos"]
        fix.append((r["__scan_pid"], head_start))
        # last row's run start: null means the partition's leading run reaches the end
        last_rs = r["last_rs"] if r["last_rs"] is not None else head_start
        prev = (lg, r["last_v"], last_rs)
    fix_df = spark.createDataFrame(
        fix, T.StructType([T.StructField("__scan_pid", T.IntegerType(), False), T.StructField("__head", pos_type, True)])
    )
    joined = local.join(F.broadcast(fix_df), "__scan_pid", "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("__head"))).drop("__scan_pid", "__scan_idx", "__head")
