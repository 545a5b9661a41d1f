"""Write the executed physical plans of key operators over a Parquet token store to PLANS.md.

usage: python tools/explain_plans.py [sf_dir]   (default /root/testdata/sf0.01)
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tokenmill.operators.aggregates import run_length_units  # noqa: E402
from tokenmill.operators.assemble import pair_streams, unpaired_keys  # noqa: E402
from tokenmill.operators.shards import shard_merge  # noqa: E402
from tokenmill.plans import fixtures as fx  # noqa: E402
from tokenmill.operators.score_rows import component_metrics, top_classes  # noqa: E402
from tokenmill.plans.flows import collated_batches, training_batches  # noqa: E402
from tokenmill.session import local_session, scratch_path  # noqa: E402
from tokenmill.sources.store import point_read, read_token_store, write_token_store  # noqa: E402


def plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # run it, so AQE shows the final plan
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"file:/\S+", "<path>", text)
    return "\n".join(line[:220] for line in text.splitlines())


def _paired_encode(spark, sf):
    from tokenmill.operators.encode import encode_job, toy_acoustic, toy_semantic
    from tokenmill.plans.q_corpus import wav_clips
    from tokenmill.sources.audio import decode_pieces

    pieces = decode_pieces(wav_clips(spark, sf)).where(F.col("reason").isNull())
    return encode_job(pieces, {"semantic": toy_semantic(2), "acoustic": toy_acoustic(4, 3)}, paired=("semantic", "acoustic"))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8)
    root = scratch_path(spark, "plans-store")
    write_token_store(fx.fx_sem(spark, sf).select("key", "len", F.col("units").alias("tokens")), root, "semantic", split="train")
    write_token_store(fx.fx_ac(spark, sf), root, "acoustic", split="train", bandwidth=3.0)
    sem = read_token_store(spark, root, stream="semantic", split="train").withColumnRenamed("tokens", "units")
    ac = read_token_store(spark, root, stream="acoustic", split="train", bandwidth=3.0)
    cases = [
        ("J1 pair_streams, sizes only (token arrays pruned, partition filters)", pair_streams(sem, ac, with_tokens=False)),
        ("J1 pair_streams keeping 2 codebooks (cut before the exchange)", pair_streams(sem, ac, keep=2)),
        ("E2 flagship training_batches over the store", training_batches(sem, ac)),
        ("A4 collated_batches over the store (one exchange by range of batch ids)", collated_batches(sem, ac, keep=2)),
        ("A5, A6 component_metrics (one pass over score arrays, one aggregate)", component_metrics(fx.fx_components(spark, sf))),
        ("O2 top_classes (no exchange)", top_classes(fx.fx_score_rows(spark, sf), 5)),
        ("S6 point read (key pushed to Parquet)", point_read(ac, ac.select("key").first()[0])),
        ("J2 unpaired_keys (one full outer join)", unpaired_keys(sem, ac)),
        ("U1 shard_merge (max_by, partial aggregation)", shard_merge(fx.fx_shards(spark, sf))),
        ("A3 run_length_units long form (skew-safe scan + algebraic aggregate)", run_length_units(fx.fx_runs(spark, sf), ["user_id"], "pos", "unit")),
        ("D1 encode_job with paired output (J1 without any exchange)", _paired_encode(spark, sf)),
    ]
    out = ["# Physical plans of key operators", "", f"Generated by `tools/explain_plans.py` on `{sf}` (store written as Parquet first).", ""]
    for title, df in cases:
        out += [f"## {title}", "", "```", plan(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
