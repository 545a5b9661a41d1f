"""Registered queries for scoring, metrics, vocabularies and key-value stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.functions.numeric import round_significant_sql, round_sql
from tokenmill.plans import fixtures as fx
from tokenmill.plans.oracle_views import add_view, u, with_views
from tokenmill.plans.registry import query

add_view(
    "ox_argmax",
    ["fx_scores"],
    "SELECT pos, class AS pred, target, keep FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, class) AS rn "
    "FROM fx_scores) WHERE rn = 1",
)
add_view(
    "ox_lp",
    ["fx_scores"],
    "SELECT pos, class, target, keep, x - (m + ln(sum(exp(x - m)) OVER (PARTITION BY pos))) AS lprob FROM ("
    "SELECT *, score AS x, max(score) OVER (PARTITION BY pos) AS m FROM fx_scores)",
)
add_view(
    "ox_lp7",
    ["fx_scores"],
    "SELECT pos, class, x - (m + ln(sum(exp(x - m)) OVER (PARTITION BY pos))) AS lprob FROM ("
    "SELECT *, score / 0.7 AS x, max(score / 0.7) OVER (PARTITION BY pos) AS m FROM fx_scores)",
)
add_view(
    "ox_topk",
    ["ox_lp7"],
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY lprob DESC, class) AS rank "
    "FROM ox_lp7 WHERE class NOT IN (1, 3, 2)) WHERE rank <= 5",
)
add_view(
    "ox_logsum",
    ["fx_log"],
    "SELECT update, sum(loss) AS l, sum(nll_loss) AS nl, sum(sample_size)::BIGINT AS ss, sum(ntokens)::BIGINT AS nt, "
    "sum(n_correct_acoustic)::BIGINT AS nc, sum(total_acoustic)::BIGINT AS tt FROM fx_log GROUP BY update",
)


add_view(
    "ox_complp",
    ["fx_components"],
    "SELECT pos, update, worker, component, class, target, keep, score - (m + ln(sum(exp(score - m)) OVER (PARTITION BY component, pos))) AS lprob, "
    "row_number() OVER (PARTITION BY component, pos ORDER BY score DESC, class) AS rn FROM ("
    "SELECT *, max(score) OVER (PARTITION BY component, pos) AS m FROM fx_components)",
)
_OX_EACH = (
    "count(*) FILTER (WHERE rn = 1 AND class = target) AS n_correct, count(*) FILTER (WHERE rn = 1) AS total, "
    "-avg(lprob) FILTER (WHERE class = target) AS nll, "
    "-avg(lprob) FILTER (WHERE class = target) * 0.9 - avg(lprob) * 0.1 AS loss, "
    "CASE component WHEN 'word_ins_semantic' THEN 0.5 ELSE 1.0 END::DOUBLE AS factor"
)
add_view("ox_comp", ["ox_complp"], f"SELECT component, {_OX_EACH} FROM ox_complp WHERE keep GROUP BY component")
add_view(
    "ox_complog",
    ["ox_complp"],
    "SELECT update, sum(l) AS l, sum(nl) AS nl, count(*)::DOUBLE AS ss, sum(la) AS la, sum(ls) AS ls, sum(ca) AS ca, sum(ta) AS ta, "
    "sum(cs) AS cs, sum(ts) AS ts FROM (SELECT update, worker, sum(loss * factor) AS l, sum(nll) AS nl, "
    "sum(loss) FILTER (WHERE component = 'word_ins_acoustic') AS la, sum(loss) FILTER (WHERE component = 'word_ins_semantic') AS ls, "
    "sum(n_correct) FILTER (WHERE component = 'word_ins_acoustic') AS ca, sum(total) FILTER (WHERE component = 'word_ins_acoustic') AS ta, "
    "sum(n_correct) FILTER (WHERE component = 'word_ins_semantic') AS cs, sum(total) FILTER (WHERE component = 'word_ins_semantic') AS ts "
    f"FROM (SELECT update, worker, component, {_OX_EACH} FROM ox_complp WHERE keep GROUP BY update, worker, component) GROUP BY update, worker) "
    "GROUP BY update",
)
FACTORS = {"word_ins_semantic": 0.5}


@query(
    "prediction_align",
    with_views("ox_argmax") + "SELECT pos, pred, target FROM ox_argmax WHERE keep",
)
def q_prediction_align(spark, sf):
    from tokenmill.operators.score_rows import position_scores

    return position_scores(fx.fx_score_rows(spark, sf), mask="keep").where("keep").select("pos", "pred", "target")


@query(
    "masked_accuracy",
    with_views("ox_argmax")
    + "SELECT 'masked' AS scope, count(*) FILTER (WHERE pred = target) AS n_correct, count(*) AS total FROM ox_argmax WHERE keep "
    "UNION ALL SELECT 'all', count(*) FILTER (WHERE pred = target), count(*) FROM ox_argmax",
)
def q_masked_accuracy(spark, sf):
    from tokenmill.operators.score_rows import position_scores

    scored = position_scores(fx.fx_score_rows(spark, sf))
    right = F.col("pred") == F.col("target")
    both = scored.agg(
        F.array(
            F.struct(F.lit("masked").alias("scope"), F.count_if(right & F.col("keep")).alias("n_correct"), F.count_if("keep").alias("total")),
            F.struct(F.lit("all").alias("scope"), F.count_if(right).alias("n_correct"), F.count(F.lit(1)).alias("total")),
        ).alias("r")
    )
    return both.select(F.explode("r").alias("r")).select("r.scope", "r.n_correct", "r.total")


@query(
    "smoothed_nll",
    with_views("ox_lp")
    + "SELECT count(DISTINCT pos) AS n_positions, "
    + round_sql("coalesce(-avg(lprob) FILTER (WHERE class = target), 0)", 6)
    + " AS nll_loss, "
    + round_sql("coalesce(-avg(lprob) FILTER (WHERE class = target), 0) * (1 - 0.1) - coalesce(avg(lprob), 0) * 0.1", 6)
    + " AS loss FROM ox_lp WHERE keep",
)
def q_smoothed_nll(spark, sf):
    from tokenmill.functions.numeric import round_half_up
    from tokenmill.operators.score_rows import component_metrics

    one = component_metrics(fx.fx_score_rows(spark, sf).withColumn("component", F.lit("word_ins")), epsilon=0.1)
    return one.where("component = 'total'").select(
        F.col("total").alias("n_positions"), round_half_up("nll_loss", 6).alias("nll_loss"), round_half_up("loss", 6).alias("loss")
    )


@query(
    "component_metrics",
    with_views("ox_comp")
    + f"SELECT component, n_correct, total, {round_sql('nll', 6)} AS nll_loss, {round_sql('loss', 6)} AS loss, factor FROM ox_comp UNION ALL "
    f"SELECT 'total', sum(n_correct)::BIGINT, sum(total)::BIGINT, {round_sql('sum(nll)', 6)}, {round_sql('sum(loss * factor)', 6)}, NULL FROM ox_comp",
)
def q_component_metrics(spark, sf):
    """A5 and A6 of two model outputs and their total, one scan."""
    from tokenmill.functions.numeric import round_half_up
    from tokenmill.operators.score_rows import component_metrics

    found = component_metrics(fx.fx_components(spark, sf), factors=FACTORS)
    return found.select(
        "component", "n_correct", "total", round_half_up("nll_loss", 6).alias("nll_loss"), round_half_up("loss", 6).alias("loss"), "factor"
    )


@query(
    "component_logs",
    with_views("ox_complog")
    + f"SELECT update, 'loss' AS metric, {round_sql('l / ss / ln(2)', 3)} AS value FROM ox_complog UNION ALL "
    f"SELECT update, 'nll_loss', {round_sql('nl / ss / ln(2)', 3)} FROM ox_complog UNION ALL "
    f"SELECT update, 'ppl', {round_sql(round_significant_sql('pow(2.0, l / ss / ln(2))', 6), 2)} FROM ox_complog UNION ALL "
    f"SELECT update, 'word_ins_acoustic', {round_sql('la / ss / ln(2)', 3)} FROM ox_complog WHERE la IS NOT NULL UNION ALL "
    f"SELECT update, 'word_ins_semantic', {round_sql('ls / ss / ln(2)', 3)} FROM ox_complog WHERE ls IS NOT NULL UNION ALL "
    f"SELECT update, 'accuracy_word_ins_acoustic', {round_sql('100.0::DOUBLE * ca / ta', 3)} FROM ox_complog WHERE ta > 0 UNION ALL "
    f"SELECT update, 'accuracy_word_ins_semantic', {round_sql('100.0::DOUBLE * cs / ts', 3)} FROM ox_complog WHERE ts > 0",
)
def q_component_logs(spark, sf):
    """A7 and A8 on the maps that workers log, whose components differ: per update the union of their keys."""
    from tokenmill.operators.score_rows import component_metrics, logging_output, reduce_metric_maps

    found = component_metrics(fx.fx_components(spark, sf), by=["update", "worker"], factors=FACTORS)
    return reduce_metric_maps(logging_output(found, ["update", "worker"]), ppl_sig_digits=6)


@query(
    "reduce_metrics",
    with_views("ox_logsum")
    + f"SELECT update, 'loss' AS metric, {round_sql('l / ss / ln(2)', 3)} AS value FROM ox_logsum UNION ALL "
    f"SELECT update, 'nll_loss', {round_sql('nl / ss / ln(2)', 3)} FROM ox_logsum UNION ALL "
    f"SELECT update, 'ppl', {round_sql(round_significant_sql('pow(2.0, l / ss / ln(2))', 6), 2)} FROM ox_logsum UNION ALL "
    f"SELECT update, 'accuracy_acoustic', {round_sql('(100.0::DOUBLE * nc::DOUBLE) / tt::DOUBLE', 3)} FROM ox_logsum WHERE tt > 0",
)
def q_reduce_metrics(spark, sf):
    from tokenmill.operators.scoring import reduce_metrics

    return reduce_metrics(fx.fx_log(spark, sf), ppl_sig_digits=6)


@query(
    "log_partial_sum",
    with_views("ox_logsum")
    + f"SELECT update, {round_sql('l', 7)} AS loss, {round_sql('nl', 7)} AS nll_loss, ss AS sample_size, nt AS ntokens, "
    "nc AS n_correct_acoustic, tt AS total_acoustic FROM ox_logsum",
)
def q_log_partial_sum(spark, sf):
    from tokenmill.functions.numeric import round_half_up
    from tokenmill.operators.scoring import log_partial_sum

    s = log_partial_sum(fx.fx_log(spark, sf))
    return s.select(
        "update",
        round_half_up("loss", 7).alias("loss"),
        round_half_up("nll_loss", 7).alias("nll_loss"),
        F.col("sample_size").cast("bigint").alias("sample_size"),
        F.col("ntokens").cast("bigint").alias("ntokens"),
        F.col("n_correct_acoustic").cast("bigint").alias("n_correct_acoustic"),
        F.col("total_acoustic").cast("bigint").alias("total_acoustic"),
    )


@query(
    "weighted_meter",
    with_views("ox_logsum")
    + "SELECT update, "
    + round_sql(
        "sum(l) OVER (ORDER BY update ROWS UNBOUNDED PRECEDING) / sum(ss) OVER (ORDER BY update ROWS UNBOUNDED PRECEDING) / ln(2)", 6
    )
    + " AS loss_avg FROM ox_logsum",
)
def q_weighted_meter(spark, sf):
    from tokenmill.operators.scoring import weighted_meter

    return weighted_meter(fx.fx_log(spark, sf))


@query(
    "topk_candidates",
    with_views("ox_topk") + f"SELECT pos, class, {round_sql('lprob', 6)} AS lprob, rank::INT AS rank FROM ox_topk",
)
def q_topk_candidates(spark, sf):
    from tokenmill.functions.numeric import round_half_up
    from tokenmill.operators.score_rows import top_classes

    c = top_classes(fx.fx_score_rows(spark, sf), k=5, temperature=0.7)
    return c.select("pos", "class", round_half_up("lprob", 6).alias("lprob"), "rank")


@query(
    "topk_sample",
    with_views("ox_topk")
    + "SELECT pos, arg_min(class, rank) AS class, (arg_min(class, rank) + (pos % 2) * 1024)::BIGINT AS token_id FROM ("
    "SELECT *, sum(exp(lprob)) OVER (PARTITION BY pos ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(exp(lprob)) OVER (PARTITION BY pos) AS cp "
    f"FROM ox_topk) WHERE cp > {u('sample', 'pos')} GROUP BY pos",
)
def q_topk_sample(spark, sf):
    from tokenmill.operators.score_rows import sample_classes

    return sample_classes(fx.fx_score_rows(spark, sf), k=5, temperature=0.7, codebook=F.col("pos") % 2)


# ---------------------------------------------------------------- key-value, vocabulary, order, merge


@query(
    "size_join",
    with_views("fx_kv")
    + "SELECT d.k AS key, d.len, s.len AS size_len FROM fx_kv d JOIN fx_kv s ON s.k = d.k || '_size' "
    "WHERE NOT ends_with(d.k, '_size')",
)
def q_size_join(spark, sf):
    from tokenmill.operators.joins import size_join

    return size_join(fx.fx_kv(spark, sf))


@query(
    "vocab_lookup",
    with_views("fx_sem")
    + "SELECT key, len(units)::BIGINT AS n, coalesce(list_sum(list_transform(units, lambda x, i: (x + 4) * i)), 0)::BIGINT AS id_digest "
    "FROM fx_sem",
)
def q_vocab_lookup(spark, sf):
    from tokenmill.functions.arrays import digest
    from tokenmill.operators.joins import build_vocab, vocab_lookup_arrays

    named = fx.fx_sem(spark, sf).select("key", F.col("units").cast("array<string>").alias("symbols"))
    ids = vocab_lookup_arrays(named, build_vocab(spark, 10000))
    return ids.select("key", F.size("ids").cast("bigint").alias("n"), digest("ids").alias("id_digest"))


@query(
    "vocab_sizing",
    with_views("fx_sem", "fx_ac")
    + "SELECT 'source' AS dictionary, 10000::BIGINT AS n_symbols, 10004::BIGINT AS vocab_size, "
    "(SELECT max(list_max(units)) FROM fx_sem)::BIGINT AS max_seen, (SELECT max(list_max(units)) FROM fx_sem) < 10000 AS fits, "
    "12056::BIGINT AS combined_size UNION ALL "
    "SELECT 'target', 2048, 2052, (SELECT max(list_max(list_transform(range(0, 2 * len), lambda j: tokens[j + 1] + (j // len) * 1024))) FROM fx_ac), "
    "(SELECT max(list_max(list_transform(range(0, 2 * len), lambda j: tokens[j + 1] + (j // len) * 1024))) FROM fx_ac) < 2048, 12056",
)
def q_vocab_sizing(spark, sf):
    from tokenmill.operators.aggregates import vocab_sizing

    return vocab_sizing(spark, fx.fx_sem(spark, sf), fx.fx_ac(spark, sf), source_symbols=10000, codec_depth=2, codec_dim=1024)


@query(
    "key_order_scan",
    with_views("fx_kv") + "SELECT k, (row_number() OVER (ORDER BY k) - 1)::BIGINT AS ord FROM fx_kv",
)
def q_key_order_scan(spark, sf):
    from tokenmill.operators.ordered import global_index

    return global_index(fx.fx_kv(spark, sf).select("k"), [F.col("k")], out="ord")


@query(
    "shard_merge",
    with_views("fx_shards") + "SELECT key, max(worker) AS worker, arg_max(len, worker) AS len FROM fx_shards GROUP BY key",
)
def q_shard_merge(spark, sf):
    from tokenmill.operators.shards import shard_merge

    return shard_merge(fx.fx_shards(spark, sf))
