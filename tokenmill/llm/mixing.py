"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

A source's expected copies of each of its documents are ``target / source
size``.  Documents stand in a fixed order within their source (by size, so
that any stretch of the order holds its share of words), the expected copies
are summed along it, one offset is added per source, and a document is
emitted once for each integer that its step crosses.

The prefix sums are split: sizes fall into classes of an eighth of a power of
two and ids into hashed blocks, so a source that holds a third of all rows is
ranked in many small groups whose offsets come from two short running sums.

Defined results: null text has size 0 and takes nothing; a null source is a
source of its own, last in order; a source of size 0 has target 0; a null
doc_id ranks before other ids; repeated rows are documents of their own;
empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import cut, table
from tokenmill.llm.registry import query

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
ROWS_PER_BLOCK = 50_000
SEED = 42


def unit_hash(*parts):
    """A number in [0, 2**32) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(skey, source_size)`` to ``(skey, source_size, target)``.

    Water filling: a source takes ``weight * level`` words, at most
    ``max_repeats`` times its size; the level is such that the targets add up
    to all sizes.  In order of cap per weight the full sources come first, so
    the level follows from running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("skey").startswith("=").desc(), "skey")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), place + 1)).withColumn(
        "cap", F.col("source_size") * F.lit(max_repeats)
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(after)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") >= F.col("level"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), F.col("level")))).over(
        everything
    )
    return levels.withColumn("final", first.getField("level")).select(
        "skey",
        "source_size",
        F.when(
            F.col("final").isNull() | (F.col("cap") < F.col("weight") * F.col("final")), F.col("cap").cast("double")
        )
        .otherwise(F.col("weight") * F.col("final"))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    rows_per_block: int = ROWS_PER_BLOCK,
    rows: int | None = None,
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with ``_size, _source_size, _target, _copies``.

    Every input row comes back once; ``_copies`` is how often the mix emits it.
    """
    rows = docs.count() if rows is None else rows
    blocks = max(1, -(-rows // rows_per_block))
    sized = (
        docs.withColumn("_size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint"))
        .withColumn("_fp", F.xxhash64("text"))
        .withColumn("_skey", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")))
        .withColumn(
            "_class",
            F.when(F.col("_size") == 0, 0).otherwise(F.floor(F.log2(F.col("_size").cast("double")) * 8).cast("int") + 1),
        )
        .withColumn(
            "_block", F.pmod(unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(blocks)).cast("int")
        )
    )
    keys = ["_skey", "_class", "_block"]
    groups = cut(sized.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")))
    classes = groups.groupBy("_skey", "_class").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    below = Window.partitionBy("_skey").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("_skey", "_class", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base"), "_words")
    targets = source_targets(
        classes.groupBy(F.col("_skey").alias("skey")).agg(F.sum("_words").alias("source_size")), weights, max_repeats
    ).select(F.col("skey").alias("_skey"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    inside = Window.partitionBy("_skey", "_class").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        groups.select(*keys, F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_in_class"))
        .join(classes.select("_skey", "_class", "_base"), ["_skey", "_class"])
        .join(targets, "_skey")
        .select(*keys, (F.col("_base") + F.col("_in_class")).alias("_start"), "_source_size", "_target")
    )
    order = Window.partitionBy(*keys).orderBy("_size", F.col("doc_id").asc_nulls_first(), "_fp")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    offset = unit_hash(F.lit(str(seed)), F.col("_skey")) / F.lit(4294967296.0)
    rank = F.col("_start") + F.row_number().over(order)
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return (
        sized.join(starts, keys)
        .withColumn("_copies", F.least(crossed, F.lit(max_repeats)).cast("int"))
        .drop("_class", "_block", "_start", "_skey", "_fp")
    )


_ORACLE = f"""
with sized as (
  select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         coalesce('=' || source, '~') as skey
  from documents),
blocks as (select greatest(1, (count(*) + {ROWS_PER_BLOCK - 1}) // {ROWS_PER_BLOCK}) as b from documents),
placed as (
  select s.*, case when size = 0 then 0 else floor(log2(size::double) * 8)::int + 1 end as class,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % b)::int as block
  from sized s, blocks),
ranked as (
  select *, row_number() over (partition by skey order by class, block, size, doc_id nulls first) as r from placed),
sources as (
  select skey, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][1 + (row_number() over (order by skey[1] = '=' desc, skey) - 1) % 3]::double as weight
  from sized group by skey),
levels as (
  select *, {MAX_REPEATS} * source_size as cap,
    (sum(source_size) over () - coalesce(sum({MAX_REPEATS} * source_size) over (
        order by {MAX_REPEATS} * source_size / weight, skey rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by {MAX_REPEATS} * source_size / weight, skey
        rows between current row and unbounded following) as level
  from sources),
final as (
  select *, (select level from levels where cap / weight >= level order by cap / weight, skey limit 1) as lv
  from levels),
targets as (
  select skey, source_size, case when lv is null or cap < weight * lv then cap::double else weight * lv end as target,
         ('0x' || substr(md5('{SEED}:' || skey), 1, 8))::bigint / 4294967296.0::double as u
  from final),
rated as (
  select r.*, source_size, target, u,
         case when source_size > 0 then target / source_size::double else 0.0::double end as rate
  from ranked r join targets using (skey))
select doc_id, size, source_size, target,
       least({MAX_REPEATS}, floor(r * rate + u) - floor((r - 1) * rate + u))::bigint * size as taken
from rated
"""


@query("op9_mixing", _ORACLE)
def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )
