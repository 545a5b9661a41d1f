"""Scoring of array rows: one row per position with the scores of all its classes.

``(pos, scores ARRAY<DOUBLE>, target, keep, ...)`` - the score of class ``c``
is element ``c``.  One Arrow pass over the scan takes everything a position
needs from its scores: the argmax, the log-sum-exp, the label's and the mean
log-probability, or the top k by partial selection.  Scores never leave the
task that reads them: no explode, no window, no exchange per position; what
follows are algebraic aggregates over narrow rows.

Rows without scores (null or empty) predict nothing and count in no sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import constants as K
from tokenmill.functions.hashing import uniform
from tokenmill.functions.numeric import LN2, round_half_up, round_significant

LOG_KEYS = ("loss", "nll_loss", "ntokens", "nsentences", "sample_size")


def to_score_rows(scores: DataFrame, pos: str = "pos", cls: str = "class", score: str = "score") -> DataFrame:
    """Long ``(pos, class, score)`` rows to array rows, by one shuffle on the position.

    A position has at most as many rows as the vocabulary has classes, which
    must be 0, 1, ... without gaps; other columns take their greatest value.
    """
    others = [c for c in scores.columns if c not in (pos, cls, score)]
    held = scores.groupBy(pos).agg(
        F.sort_array(F.collect_list(F.struct(F.col(cls).cast("int").alias("c"), F.col(score).cast("double").alias("x")))).alias("__s"),
        *[F.max(c).alias(c) for c in others],
    )
    dense = F.element_at("__s", -1)["c"] == F.size("__s") - 1
    held = held.withColumn("scores", F.when(dense, F.transform("__s", lambda s: s["x"])).otherwise(F.raise_error(F.lit("classes have gaps"))))
    return held.drop("__s")


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and score matrix of each number of classes; rows without scores are left out."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == width)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(width))


def _log_sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def position_scores(rows: DataFrame, scores: str = "scores", target: str = "target", mask: str | None = None) -> DataFrame:
    """``rows`` without their scores, with ``pred``, ``nll`` and ``mean_lprob`` of each position.

    ``pred`` is the argmax, ties to the lowest class; ``nll`` is minus the
    label's log-probability, ``mean_lprob`` the mean over all classes.  Where
    ``mask`` is not true they are null; there, a label may be any value, and
    elsewhere it must be one of the classes.
    """
    kept = [f for f in rows.schema.fields if f.name != scores]
    schema = T.StructType(
        [*kept, T.StructField("pred", T.IntegerType()), T.StructField("nll", T.DoubleType()), T.StructField("mean_lprob", T.DoubleType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, nll, mean = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
            seen = np.zeros(n, bool)
            label = np.nan_to_num(batch.column(target).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
            wanted = np.ones(n, bool) if mask is None else batch.column(mask).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for at, x in _blocks(batch.column(scores)):
                use = wanted[at]
                at, x = at[use], x[use]
                if not len(at):
                    continue
                own = label[at]
                if ((own < 0) | (own >= x.shape[1])).any():
                    raise ValueError("a label is outside the classes")
                lse = _log_sum_exp(x)
                pred[at] = x.argmax(axis=1)
                nll[at] = lse - x[np.arange(len(at)), own]
                mean[at] = x.mean(axis=1) - lse
                seen[at] = True
            out = [batch.column(f.name) for f in kept]
            out += [pa.array(pred, mask=~seen), pa.array(nll, mask=~seen), pa.array(mean, mask=~seen)]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in schema.fields])

    return rows.mapInArrow(work, schema)


def component_metrics(
    rows: DataFrame,
    by: list[str] | None = None,
    component: str = "component",
    scores: str = "scores",
    target: str = "target",
    mask: str = "keep",
    factors: dict[str, float] | None = None,
    epsilon: float | dict[str, float] = K.LABEL_SMOOTHING,
) -> DataFrame:
    """A5 and A6 of every model output ("component") in one pass, with the total.

    Per component: ``n_correct`` and ``total`` positions under the mask, the
    mean ``nll_loss``, the smoothed ``loss`` as it is logged, and its
    ``factor``.  The row ``total`` sums what is optimised: losses times their
    factors, and the nll of all components.  A component without positions
    under the mask has loss 0 and total 0.
    """
    by = by or []
    factors = factors or {}
    scored = position_scores(rows.select(*by, component, scores, target, mask), scores, target, mask)
    sums = scored.groupBy(*by, component).agg(
        F.count("pred").alias("total"),
        F.count_if(F.col("pred") == F.col(target)).alias("n_correct"),
        F.sum("nll").alias("nll"),
        F.sum("mean_lprob").alias("mean"),
    )

    def of_component(values: dict[str, float], default: float) -> Column:
        out = F.lit(float(default))
        for name, value in values.items():
            out = F.when(F.col(component) == name, F.lit(float(value))).otherwise(out)
        return out

    smooth = of_component(epsilon, 0.0) if isinstance(epsilon, dict) else F.lit(float(epsilon))
    nll = F.coalesce(F.try_divide(F.col("nll"), F.col("total")), F.lit(0.0))
    mean = F.coalesce(F.try_divide(F.col("mean"), F.col("total")), F.lit(0.0))
    each = sums.select(
        *by, component, "n_correct", "total",
        nll.alias("nll_loss"),
        (nll * (1 - smooth) - mean * smooth).alias("loss"),
        of_component(factors, 1.0).alias("factor"),
    )
    # one row per group and component: the total is an aggregate over a few rows
    both = F.explode(F.array(F.col(component), F.lit("total")))
    wide = each.select(*by, both.alias("__c"), component, "n_correct", "total", "nll_loss", "loss", "factor")
    whole = F.col("__c") == "total"
    return (
        wide.groupBy(*by, F.col("__c").alias(component))
        .agg(
            F.sum("n_correct").cast("bigint").alias("n_correct"),
            F.sum("total").cast("bigint").alias("total"),
            F.sum("nll_loss").alias("nll_loss"),
            F.sum(F.col("loss") * F.when(whole, F.col("factor")).otherwise(F.lit(1.0))).alias("loss"),
            F.max(F.when(~whole, F.col("factor"))).alias("factor"),
        )
    )


# ---------------------------------------------------------------- logs with one entry per component


def logging_output(metrics: DataFrame, by: list[str], component: str = "component", sample_size: int = 1) -> DataFrame:
    """Worker logs ``(*by, log MAP<STRING, DOUBLE>)`` from :func:`component_metrics`.

    Keys: ``loss``, ``nll_loss``, ``sample_size``, and of every component
    ``<name>-loss``, ``n_correct_<name>`` and ``total_<name>``.
    """
    name = F.col(component)
    value = lambda c: F.col(c).cast("double")
    total = F.array(
        F.struct(F.lit("loss").alias("k"), value("loss").alias("v")),
        F.struct(F.lit("nll_loss").alias("k"), value("nll_loss").alias("v")),
        F.struct(F.lit("sample_size").alias("k"), F.lit(float(sample_size)).alias("v")),
    )
    own = F.array(
        F.struct(F.concat(name, F.lit("-loss")).alias("k"), value("loss").alias("v")),
        F.struct(F.concat(F.lit("n_correct_"), name).alias("k"), value("n_correct").alias("v")),
        F.struct(F.concat(F.lit("total_"), name).alias("k"), value("total").alias("v")),
    )
    entries = metrics.select(*by, F.when(name == "total", total).otherwise(own).alias("e"))
    return entries.groupBy(*by).agg(F.map_from_entries(F.flatten(F.collect_list("e"))).alias("log"))


def sum_logs(logs: DataFrame, by: list[str], log: str = "log") -> DataFrame:
    """A8 on map logs: the sum of every key that any worker logged, as a map per group.

    Workers may log different keys; a key's sum is over those that have it.
    """
    entries = logs.select(*by, F.explode(log).alias("k", "v"))
    sums = entries.groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(log))


def reduce_metric_maps(logs: DataFrame, by: str = "update", log: str = "log", ppl_sig_digits: int | None = None) -> DataFrame:
    """A7 on map logs: ``(update, metric, value)`` of every key that any worker logged.

    ``loss`` and ``nll_loss`` in bits (3 decimals) and ``ppl`` (2 decimals);
    ``<name>-loss`` gives ``<name>``, in bits, 0 where nothing was sampled;
    ``total_<name>`` with ``n_correct_<name>`` gives ``accuracy_<name>``.
    An update whose ``sample_size`` is 0 has no loss, nll_loss and ppl rows.
    """
    entries = logs.select(by, F.explode(log).alias("k", "v"))
    # an update's sizes stand beside each of its keys after one aggregate
    sums = entries.groupBy(by, "k").agg(F.sum("v").alias("v"))
    maps = sums.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    each = maps.select(by, F.coalesce(F.col("m")["sample_size"], F.lit(0.0)).alias("ss"), "m", F.explode("m").alias("k", "v"))
    bits = F.try_divide(F.col("v"), F.col("ss")) / F.lit(LN2)
    raw = F.pow(F.lit(2.0), bits)
    ppl = round_half_up(round_significant(raw, ppl_sig_digits) if ppl_sig_digits else raw, 2)
    name = F.regexp_extract("k", "^total_(.*)$", 1)
    correct = F.col("m")[F.concat(F.lit("n_correct_"), name)]
    found = (
        F.when(F.col("k") == "loss", F.array(_metric(F.lit("loss"), round_half_up(bits, 3)), _metric(F.lit("ppl"), ppl)))
        .when(F.col("k") == "nll_loss", F.array(_metric(F.col("k"), round_half_up(bits, 3))))
        .when(
            F.col("k").endswith("-loss"),
            F.array(_metric(F.regexp_replace("k", "-loss$", ""), F.when(F.col("ss") > 0, round_half_up(bits, 3)).otherwise(F.lit(0.0)))),
        )
        .when(
            F.col("k").startswith("total_") & (F.col("v") > 0),
            F.array(_metric(F.concat(F.lit("accuracy_"), name), round_half_up(100.0 * F.coalesce(correct, F.lit(0.0)) / F.col("v"), 3))),
        )
    )
    return each.select(by, F.explode(found).alias("x")).select(by, "x.metric", "x.value").where(F.col("value").isNotNull())


def _metric(name: Column, value: Column) -> Column:
    return F.struct(name.alias("metric"), value.alias("value"))


# ---------------------------------------------------------------- O2 / O3


def _select(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns of its k greatest finite values, ties to the lower column, best first: (rows, columns)."""
    width = x.shape[1]
    if width > k:
        least = np.partition(x, width - k, axis=1)[:, width - k]
        above, equal = x > least[:, None], x == least[:, None]
        equal &= np.cumsum(equal, axis=1) <= (k - above.sum(axis=1))[:, None]
        row, col = np.nonzero((above | equal) & (x > -np.inf))
    else:
        row, col = np.nonzero(x > -np.inf)
    order = np.lexsort((col, -x[row, col], row))
    return row[order], col[order]


def _ranked(batch: pa.RecordBatch, scores: str, k: int, temperature: float, banned: tuple[int, ...]):
    """Of all rows of a batch: row, rank from 1, class and log-probability of the candidates."""
    parts = []
    for at, x in _blocks(batch.column(scores)):
        x = x / temperature
        lprob = x - _log_sum_exp(x)[:, None]
        lprob[:, [c for c in banned if c < x.shape[1]]] = -np.inf
        row, col = _select(lprob, k)
        parts.append((at[row], col, lprob[row, col]))
    row, col, lprob = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(row, kind="stable")
    row, col, lprob = row[order].astype(np.int64), col[order].astype(np.int32), lprob[order].astype(np.float64)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
    return row, rank.astype(np.int32), col, lprob


def top_classes(
    rows: DataFrame,
    k: int,
    temperature: float = 1.0,
    banned: tuple[int, ...] = (K.PAD, K.UNK, K.EOS),
    pos: str = "pos",
    scores: str = "scores",
) -> DataFrame:
    """O2: the k likeliest classes of each row, without the banned ones: ``(pos, class, lprob, rank)``."""
    kind = rows.schema[pos].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rank, col, lprob = _ranked(batch, scores, k, temperature, banned)
            yield pa.RecordBatch.from_arrays(
                [batch.column(pos).take(pa.array(row)), pa.array(col), pa.array(lprob), pa.array(rank)], ["pos", "class", "lprob", "rank"]
            )

    return rows.select(pos, scores).mapInArrow(work, f"pos {kind}, class int, lprob double, rank int").withColumnRenamed("pos", pos)


def sample_classes(
    rows: DataFrame,
    k: int,
    temperature: float = 1.0,
    banned: tuple[int, ...] = (K.PAD, K.UNK, K.EOS),
    codebook: Column | None = None,
    codec_dim: int = K.CODEC_DIM,
    pos: str = "pos",
    scores: str = "scores",
    seed: int = 42,
) -> DataFrame:
    """O3: one of the k likeliest classes of each row, drawn by renormalised probability (inverse CDF).

    The draw is ``u("sample", pos)``; ``token_id`` is the class plus the
    codebook's offset ``q * codec_dim``.
    """
    kind = rows.schema[pos].dataType.simpleString()
    q = codebook if codebook is not None else F.lit(0)
    ready = rows.select(pos, scores, uniform("sample", F.col(pos), seed).alias("__u"), q.cast("bigint").alias("__q"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, col, lprob = _ranked(batch, scores, k, temperature, banned)
            p = np.exp(lprob)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            size = np.diff(np.append(first, len(row)))
            # running sums inside each row's few candidates, rank by rank
            mass = np.zeros(len(first))
            chosen = np.full(len(first), -1, np.int64)
            total = np.add.reduceat(p, first) if len(first) else mass
            draw = batch.column("__u").to_numpy(zero_copy_only=False)[row[first]]
            for step in range(int(size.max(initial=0))):
                on = np.flatnonzero(size > step)
                mass[on] += p[first[on] + step]
                hit = on[(chosen[on] < 0) & (mass[on] / total[on] > draw[on])]
                chosen[hit] = first[hit] + step
            held = np.flatnonzero(chosen >= 0)
            at = pa.array(row[first][held])
            picked = col[chosen[held]]
            offset = batch.column("__q").to_numpy(zero_copy_only=False)[row[first][held]].astype(np.int64) * codec_dim
            yield pa.RecordBatch.from_arrays(
                [batch.column(pos).take(at), pa.array(picked), pa.array(picked.astype(np.int64) + offset)], ["pos", "class", "token_id"]
            )

    return ready.mapInArrow(work, f"pos {kind}, class int, token_id bigint").withColumnRenamed("pos", pos)
