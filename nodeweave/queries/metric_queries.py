"""Evaluation queries over all ranking cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeweave.operators import metrics as M
from nodeweave.operators.scorers import edge_targets
from nodeweave.queries.sqlx import CANDIDATES
from nodeweave.sources.tables import latest, table


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Each ranking case once, as last delivered."""
    cols = ["ingested_at", "query", "current_summary", "path", "candidates", "split", "source"]
    return latest(table(spark, d, "traversal_ranking").filter("id is not null"), ["id"], ["ingested_at"], cols)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row for each candidate of each case; a null confidence counts as 0."""
    rows = cases(spark, d).select(F.col("id").alias("case_id"), "query", "current_summary", "path", F.posexplode("candidates").alias("idx", "c")).filter("c is not null")
    names = ["kind", "rank_target", "result_label", "result_rank_target", "weight", "dst_summary", "edge", "hop", "oracle"]
    return rows.select("case_id", "idx", "query", "current_summary", "path", F.col("c.id").alias("candidate_id"), F.col("c.label").alias("label0"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), *[F.col(f"c.{n}").alias(n) for n in names])


def action_target(action: int):
    """The target of one action by the ladder of fields a candidate may carry; null where none does."""
    oracle = F.col("oracle")
    at = F.when(F.size(oracle) > action, F.get(oracle, F.lit(action)))
    if action == 5:
        third = F.when(F.size(oracle) > 2, F.get(oracle, F.lit(2)))
        return F.coalesce("result_rank_target", at, third, F.col("result_label").cast("double"), F.col("label0").cast("double"))
    return F.coalesce(at, "rank_target", F.col("label0").cast("double")) if action == 0 else at


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """case_id, idx, kind, score, label, oracle, weight of every candidate."""
    t = edge_targets(candidates(spark, d)).withColumn("target", action_target(5))
    label = F.coalesce("result_label", (F.col("target") >= 0.65).cast("int"), "label0", F.lit(0))
    return t.select("case_id", "idx", "kind", F.round(F.coalesce("follow", F.lit(0.0)), 6).alias("score"), label.cast("int").alias("label"), F.col("target").alias("oracle"), "weight")


def eval_targets(spark: SparkSession, d: str) -> DataFrame:
    return metric_rows(spark, d).select("case_id", "idx", "kind", "score", "label", F.round("oracle", 6).alias("oracle"))


def synthetic_targets(spark: SparkSession, d: str) -> DataFrame:
    t = edge_targets(candidates(spark, d))
    return t.select("case_id", "idx", *[F.round(c, 6).alias(c) for c in ("follow", "read_full", "include", "expand", "stop")])


def rank_case(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_cases(metric_rows(spark, d)).select("case_id", "idx", F.col("rank").cast("bigint").alias("rank"), "label")


def eval_actions(spark: SparkSession, d: str) -> DataFrame:
    """Mean target and mean absolute error of each action's score against it."""
    t = edge_targets(candidates(spark, d)).withColumn("result", F.col("include"))
    heads = ("follow", "read_full", "include", "expand", "stop", "result")
    long = t.select(F.explode(F.array(*[F.struct(F.lit(h).alias("action"), F.col(h).alias("score"), action_target(i).alias("target")) for i, h in enumerate(heads)])).alias("x")).select("x.*").filter("target is not null")
    return long.groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("mean_target"), F.round(F.avg(F.abs(F.col("score") - F.col("target"))), 6).alias("mean_error"))


def eval_target_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a case whose targets differ by 0.05 or more, and those the scores order alike."""
    return M.target_pairwise(metric_rows(spark, d).withColumn("target", F.col("oracle")))


def label_weight(spark: SparkSession, d: str) -> DataFrame:
    """Hard label and rank weight of a soft target."""
    m = metric_rows(spark, d).filter("oracle is not null")
    return m.select("case_id", "idx", (F.col("oracle") >= 0.65).cast("int").alias("hard_label"), F.round(0.5 + F.abs(F.col("oracle") - 0.5) * 2.0, 5).alias("rank_weight"))


def metric_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = metric_rows(spark, d)
    one = M.mrr(rows).select(F.lit("mrr").alias("metric"), F.col("mrr").alias("value"))
    ap = M.average_precision(rows).select(F.lit("average_precision").alias("metric"), F.col("average_precision").alias("value"))
    return M.gates(one.unionByName(ap), {"mrr": 0.4, "average_precision": 0.9})


def eval_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return M.percentiles(metric_rows(spark, d), "score", ["kind"])


def eval_purity(spark: SparkSession, d: str) -> DataFrame:
    """Share of right candidates among each case's first three."""
    top = M.rank_cases(metric_rows(spark, d)).filter("rank <= 3")
    return top.groupBy("case_id").agg(F.round(F.coalesce(F.avg("label"), F.lit(0.0)), 6).alias("purity"))


def loss_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return M.pairwise_loss(metric_rows(spark, d).filter("oracle is not null").withColumn("target", F.col("oracle")))


def loss_listwise(spark: SparkSession, d: str) -> DataFrame:
    return M.listwise_loss(metric_rows(spark, d).filter("oracle is not null").withColumn("target", F.col("oracle")))


def shard_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of shard 3 of 8 in id order; the order number is counted in ranges, not in one task."""
    ids = cases(spark, d).select("id")
    bucket = F.substring("id", 1, 17)
    counts = ids.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ids.withColumn("b", bucket).join(counts.select("b", "before"), "b").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1)
    return placed.filter(F.pmod("i", F.lit(8)) == 3).select("id", F.col("i").cast("bigint").alias("i"))


def shard_status(spark: SparkSession, d: str) -> DataFrame:
    """Per source: cases delivered, candidates with a teacher label, and the status that follows."""
    rows = candidates(spark, d).join(cases(spark, d).select(F.col("id").alias("case_id"), F.coalesce("source", F.lit("none")).alias("source")), "case_id")
    c = rows.groupBy("source").agg(F.count("*").alias("candidates"), F.count("rank_target").alias("labelled"))
    return c.withColumn("status", F.when(F.col("labelled") == F.col("candidates"), "complete").when(F.col("labelled") > 0, "partial").otherwise("missing"))


def _over(f):
    return lambda spark, d: f(metric_rows(spark, d))


def queries() -> dict:
    return {
        "eval_targets": eval_targets, "synthetic_targets": synthetic_targets, "rank_case": rank_case, "eval_top1": _over(M.top1), "eval_mrr": _over(M.mrr), "eval_pr_at_k": _over(M.at_k),
        "eval_ndcg": _over(M.ndcg), "eval_pairwise": _over(M.pairwise), "eval_threshold": _over(M.at_threshold), "eval_best_f1": _over(M.best_f1), "eval_ap": _over(M.average_precision),
        "eval_pr_curve": _over(M.pr_curve), "eval_pr_summary": _over(M.pr_summary), "eval_calibration": _over(M.calibration), "eval_score_stats": _over(M.score_stats), "eval_by_kind": _over(M.by_kind),
        "eval_actions": eval_actions, "eval_target_pairwise": eval_target_pairwise, "eval_percentiles": eval_percentiles, "eval_purity": eval_purity, "label_weight": label_weight, "metric_gates": metric_gates,
        "loss_pairwise": loss_pairwise, "loss_listwise": loss_listwise, "shard_filter": shard_filter, "shard_status": shard_status,
    }


def oracle_sql() -> dict[str, str]:
    def w(tail: str) -> str:
        return f"WITH {CANDIDATES} {tail}"

    up = "SELECT s, count(*) n, sum(label) p FROM m GROUP BY s"
    curve = f"c0 AS ({up}), c1 AS (SELECT s / 1000000 AS score, sum(p) OVER (ORDER BY s DESC) cp, sum(n) OVER (ORDER BY s DESC) cn, sum(p) OVER () ap FROM c0), curve AS (SELECT score, round(cp / cn, 6) AS precision, round(CASE WHEN ap = 0 THEN 0 ELSE cp / ap END, 6) AS recall FROM c1)"
    ap = "SELECT count(*)::BIGINT AS positives, round(coalesce(avg(cp / j), 0), 6) AS average_precision FROM (SELECT label, row_number() OVER w j, sum(label) OVER (ORDER BY s DESC, case_id, idx ROWS UNBOUNDED PRECEDING) cp FROM m WINDOW w AS (ORDER BY s DESC, case_id, idx)) WHERE label = 1"
    mrr = "SELECT count(*)::BIGINT AS cases, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM (SELECT case_id, min(rank) FILTER (label = 1) f FROM r GROUP BY case_id)"
    heads = "UNION ALL ".join(
        f"SELECT '{h}' AS action, {s} AS score, {t} AS target FROM act "
        for h, s, t in (
            ("follow", "follow", "coalesce(oracle[1], rank_target, label0)"), ("read_full", "rf", "oracle[2]"), ("include", "include", "oracle[3]"), ("expand", "ex", "oracle[4]"), ("stop", "greatest(0, least(1, 1 - ex))", "oracle[5]"), ("result", "include", "result_target"),
        )
    )
    act = "act AS (SELECT *, greatest(0, least(1, 0.75 * include + 0.25 * follow)) rf, greatest(0, least(1, 0.8 * follow + 0.2 * c2d - 0.05 * hop)) ex FROM tgt)"
    pairs = "p AS (SELECT a.case_id, a.s sa, b.s sb, a.score ca, b.score cb, a.oracle ta, b.oracle tb, coalesce(a.weight, 1.0) wa, coalesce(b.weight, 1.0) wb FROM m a JOIN m b ON a.case_id = b.case_id AND a.oracle - b.oracle >= 0.05)"
    return {
        "eval_targets": w("SELECT case_id, idx, kind, score, label, round(oracle, 6) AS oracle FROM m"),
        "synthetic_targets": w(f", {act} SELECT case_id, idx, round(follow, 6) AS follow, round(rf, 6) AS read_full, round(include, 6) AS include, round(ex, 6) AS expand, round(greatest(0, least(1, 1 - ex)), 6) AS stop FROM act"),
        "rank_case": w("SELECT case_id, idx, rank::BIGINT AS rank, label FROM r"),
        "eval_top1": w("SELECT kind, count(*)::BIGINT AS cases, sum(label)::BIGINT AS right FROM r WHERE rank = 1 GROUP BY kind").replace("AS right", 'AS "right"'),
        "eval_mrr": w(mrr),
        "eval_pr_at_k": w("SELECT k, round(avg(h / least(k, n)), 6) AS precision, round(avg(h / greatest(p, 1)), 6) AS recall FROM (SELECT k::INT AS k, case_id, count(*) n, sum(label) p, coalesce(sum(label) FILTER (rank <= k), 0) h FROM r, (VALUES (1), (3), (5)) v(k) GROUP BY k, case_id) GROUP BY k"),
        "eval_ndcg": w(", i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY label DESC, idx) ideal FROM r), g AS (SELECT case_id, "
                       + ", ".join(f"coalesce(sum(label / log2(rank + 1)) FILTER (rank <= {k}), 0) g{k}, coalesce(sum(label / log2(ideal + 1)) FILTER (ideal <= {k}), 0) b{k}" for k in (3, 5))
                       + " FROM i GROUP BY case_id) SELECT " + ", ".join(f"round(avg(CASE WHEN b{k} = 0 THEN 0 ELSE g{k} / b{k} END), 6) AS ndcg{k}" for k in (3, 5)) + " FROM g"),
        "eval_pairwise": w("SELECT n.kind, count(*)::BIGINT AS pairs, sum((p.s > n.s)::INT)::BIGINT AS won, bool_or(regexp_matches(lower(n.kind), 'hard|adversarial|wrong_topic|negative')) AS hard, bool_or(starts_with(n.kind, 'hard') OR starts_with(n.kind, 'adversarial')) AS adversarial, round(avg(n.s / 1000000), 6) AS mean_negative FROM m p JOIN m n ON p.case_id = n.case_id AND p.label = 1 AND n.label = 0 GROUP BY n.kind"),
        "eval_threshold": w(", t AS (SELECT count(*) FILTER (s >= 500000 AND label = 1) tp, count(*) FILTER (s >= 500000 AND label = 0) fp, count(*) FILTER (s < 500000 AND label = 1) fn FROM m), q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END r FROM t) SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM q"),
        "eval_best_f1": w(", g AS (SELECT k, count(*) FILTER (s >= k * 10000 AND label = 1) tp, count(*) FILTER (s >= k * 10000) hit, sum(label) ap FROM m, range(0, 101) v(k) GROUP BY k), f AS (SELECT k, round(CASE WHEN hit + ap = 0 THEN 0 ELSE 2 * tp / (hit + ap) END, 12) f1 FROM g) SELECT round(f1, 6) AS f1, CASE WHEN f1 = 0 THEN 0.0 ELSE round(k / 100, 2) END AS threshold FROM f ORDER BY f.f1 DESC, k LIMIT 1"),
        "eval_ap": w(ap),
        "eval_pr_curve": w(f", {curve} SELECT * FROM curve"),
        "eval_pr_summary": w(f", {curve} SELECT l::DOUBLE AS level, coalesce(max(precision) FILTER (recall >= l), 0) AS precision_at_recall, coalesce(max(recall) FILTER (precision >= l), 0) AS recall_at_precision FROM curve, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) v(l) GROUP BY l"),
        "eval_calibration": w(", b AS (SELECT least(9, floor(s / 100000)) bin, sum(s) c, sum(label) p, sum((s / 1000000 - label) ** 2) sq, count(*) n FROM m GROUP BY 1) SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(c / 1000000 - p)) / sum(n), 6) AS ece FROM b"),
        "eval_score_stats": w("SELECT label, count(*)::BIGINT AS n, round(avg(s / 1000000), 6) AS mean, round(coalesce(stddev_pop(s / 1000000), 0), 6) AS deviation FROM m GROUP BY label"),
        "eval_by_kind": w("SELECT kind, count(*)::BIGINT AS n, sum(label)::BIGINT AS positives, round(avg(s / 1000000), 6) AS mean_score FROM m GROUP BY kind"),
        "eval_actions": w(f", {act}, l AS ({heads}) SELECT action, count(*)::BIGINT AS n, round(avg(target), 6) AS mean_target, round(avg(abs(score - target)), 6) AS mean_error FROM l WHERE target IS NOT NULL GROUP BY action"),
        "eval_target_pairwise": w(f", {pairs} SELECT count(*)::BIGINT AS pairs, sum((ca > cb)::INT)::BIGINT AS alike FROM p"),
        "eval_percentiles": w("SELECT kind, round(avg(score), 6) AS mean, round(quantile_disc(score, 0.5), 6) AS p50, round(quantile_disc(score, 0.95), 6) AS p95, round(quantile_disc(score, 0.99), 6) AS p99 FROM m GROUP BY kind"),
        "eval_purity": w("SELECT case_id, round(avg(label), 6) AS purity FROM r WHERE rank <= 3 GROUP BY case_id"),
        "label_weight": w("SELECT case_id, idx, (oracle >= 0.65)::INT AS hard_label, round(0.5 + abs(oracle - 0.5) * 2.0, 5) AS rank_weight FROM m WHERE oracle IS NOT NULL"),
        "metric_gates": w(f", a AS ({ap}), b AS ({mrr}) SELECT 'mrr' AS metric, mrr AS value, 0.4::DOUBLE AS least, mrr >= 0.4 AS passed FROM b UNION ALL SELECT 'average_precision', average_precision, 0.9::DOUBLE, average_precision >= 0.9 FROM a").replace("AS least", 'AS "least"'),
        "loss_pairwise": w(f", {pairs}, c AS (SELECT case_id, sum(sqrt(wa * wb) * greatest(0, 0.2 * (ta - tb) - (ca - cb))) l, sum(sqrt(wa * wb)) w FROM p GROUP BY case_id) SELECT count(*)::BIGINT AS cases, round(avg(l / greatest(w, 1e-12)), 6) AS loss FROM c"),
        "loss_listwise": w(", a AS (SELECT *, sum(oracle) OVER c mass, exp((oracle - max(oracle) OVER c) / 0.15) te, score - max(score) OVER c z FROM m WHERE oracle IS NOT NULL WINDOW c AS (PARTITION BY case_id)), b AS (SELECT *, sum(te) OVER c ts, ln(sum(exp(z)) OVER c) ls FROM a WHERE mass > 0 WINDOW c AS (PARTITION BY case_id)), l AS (SELECT case_id, -sum(te / ts * (z - ls)) l FROM b GROUP BY case_id) SELECT count(*)::BIGINT AS cases, round(avg(l), 6) AS loss FROM l"),
        "shard_filter": "WITH o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT DISTINCT id FROM traversal_ranking WHERE id IS NOT NULL)) SELECT id, i::BIGINT AS i FROM o WHERE i % 8 = 3",
        "shard_status": w(", s AS (SELECT coalesce(c.source, 'none') AS source, count(*)::BIGINT AS candidates, count(f.rank_target)::BIGINT AS labelled FROM flat f JOIN cases c ON c.id = f.case_id GROUP BY 1) SELECT *, CASE WHEN labelled = candidates THEN 'complete' WHEN labelled > 0 THEN 'partial' ELSE 'missing' END AS status FROM s"),
    }
