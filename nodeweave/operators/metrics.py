"""Ranking, precision-recall and calibration metrics over long rows.

Input is one row for each candidate: case_id, idx, score, label (0 or 1), kind,
oracle. Scores are first brought to whole millionths (``s``), so equal scores are
equal everywhere and a global ranking needs at most a million and one distinct
values: candidates are counted by value before anything global is ordered, and
no task ever sorts all candidates. A null score counts as 0, a null label as 0.
Cases without candidates have no rows and so take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeweave.session import settled

MILLION = 1_000_000


def in_case():
    return Window.partitionBy("case_id")


def prepared(rows: DataFrame) -> DataFrame:
    s = F.round(F.coalesce("score", F.lit(0.0)) * MILLION).cast("long")
    return rows.withColumn("s", s).withColumn("label", F.coalesce("label", F.lit(0)).cast("int"))


def rank_cases(rows: DataFrame) -> DataFrame:
    """rows with ``rank`` in the case: score descending, then input order."""
    return prepared(rows).withColumn("rank", F.row_number().over(in_case().orderBy(F.desc("s"), "idx")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def top1(rows: DataFrame) -> DataFrame:
    """By kind of the first candidate: cases, and how many of them are right."""
    return rank_cases(rows).filter("rank = 1").groupBy("kind").agg(F.count("*").alias("cases"), F.sum("label").alias("right"))


def mrr(rows: DataFrame) -> DataFrame:
    first = rank_cases(rows).groupBy("case_id").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("r"))
    return first.agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def at_k(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(k, precision, recall): hits over min(k, candidates) and over positives, meaned over cases."""
    ranked = rank_cases(rows)
    per = ranked.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("label").alias("p"), *[F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias(f"h{k}") for k in ks])
    each = per.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / F.least(F.lit(k), F.col("n"))).alias("p"), (F.col(f"h{k}") / F.greatest(F.col("p"), F.lit(1))).alias("r")) for k in ks
    ])).alias("x"))
    return each.groupBy(F.col("x.k").alias("k")).agg(F.round(F.avg("x.p"), 6).alias("precision"), F.round(F.avg("x.r"), 6).alias("recall"))


def ndcg(rows: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Binary gain over log2(rank + 1), against the best order; 0 where nothing is positive."""
    ranked = rank_cases(rows).withColumn("ideal", F.row_number().over(in_case().orderBy(F.desc("label"), "idx")))
    gain, best = F.col("label") / F.log2(F.col("rank") + 1.0), F.col("label") / F.log2(F.col("ideal") + 1.0)
    per = ranked.groupBy("case_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"g{k}") for k in ks], *[F.sum(F.when(F.col("ideal") <= k, best).otherwise(0.0)).alias(f"b{k}") for k in ks]
    )
    return per.agg(*[F.round(F.avg(_ratio(F.col(f"g{k}"), F.col(f"b{k}"))), 6).alias(f"ndcg{k}") for k in ks])


def is_hard(kind: Column) -> Column:
    """Any kind that names a hard, adversarial, wrong-topic or negative candidate."""
    return F.lower(kind).rlike("hard|adversarial|wrong_topic|negative")


def is_adversarial(kind: Column) -> Column:
    return kind.startswith("hard") | kind.startswith("adversarial")


def pairwise(rows: DataFrame) -> DataFrame:
    """By kind of the negative: pairs with a positive of the same case, and those the positive wins outright.

    Counted with running sums inside the case; no pair is ever made. mean_negative
    weighs a negative once for each of its pairs.
    """
    above = in_case().orderBy("s").rangeBetween(1, Window.unboundedFollowing)
    m = prepared(rows).withColumn("wins", F.coalesce(F.sum("label").over(above), F.lit(0))).withColumn("positives", F.sum("label").over(in_case()))
    neg = m.filter("label = 0 and positives > 0")
    return neg.groupBy("kind").agg(
        F.sum("positives").alias("pairs"), F.sum("wins").alias("won"), F.max(is_hard(F.col("kind"))).alias("hard"), F.max(is_adversarial(F.col("kind"))).alias("adversarial"),
        F.round(F.sum(F.col("s") * F.col("positives")) / (F.sum("positives") * MILLION), 6).alias("mean_negative"),
    )


def by_oracle(rows: DataFrame) -> DataFrame:
    """(cases, right, mrr) if candidates were ranked by their oracle score: first candidates that are right, and reciprocal rank of the first right one; a missing oracle score counts as 0."""
    order = in_case().orderBy(F.desc(F.coalesce("oracle", F.lit(0.0))), "idx")
    r = prepared(rows).withColumn("rank", F.row_number().over(order)).groupBy("case_id").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("r"))
    return r.agg(F.count("*").alias("cases"), F.count_if(F.col("r") == 1).alias("right"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def pairwise_by_oracle(rows: DataFrame) -> DataFrame:
    """By kind of the negative: pairs with a positive of the case that the oracle puts above it, and those the score puts above it too."""
    m = prepared(rows).withColumn("oracle", F.coalesce("oracle", F.lit(0.0)))
    width = m.groupBy("case_id").agg(F.ceil(F.count("*") / CASE_ROWS).cast("int").alias("width"))
    m = m.join(width, "case_id")
    pos = m.filter("label = 1").select("case_id", F.pmod(F.xxhash64("idx"), F.col("width")).cast("int").alias("salt"), F.col("s").alias("sp"), F.col("oracle").alias("op"))
    neg = m.filter("label = 0").select("case_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("salt"), "kind", "s", "oracle")
    pairs = neg.join(pos, ["case_id", "salt"]).filter("op > oracle")
    return pairs.groupBy("kind").agg(F.count("*").alias("pairs"), F.count_if(F.col("sp") > F.col("s")).alias("won"))


def actions(rows: DataFrame, positive: float = 0.65) -> DataFrame:
    """One row for each action that has a target for every candidate: rows has action, case_id, idx, score, target.

    Precision, recall and F1 at 0.5, average precision (equal scores merged), Brier score and
    calibration error over ten bins, and the scores' means, range and deviation.
    """
    m = rows.withColumn("s", F.round(F.coalesce("score", F.lit(0.0)) * MILLION).cast("long")).withColumn("label", (F.col("target") >= positive).cast("int"))
    whole = m.groupBy("action").agg(F.count_if(F.col("target").isNull()).alias("gaps")).filter("gaps = 0").select("action")
    # whatever the number of rows, at most a million and one scores an action go on
    values = m.join(F.broadcast(whole), "action").groupBy("action", "s").agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.sum("target").alias("t"))
    down = Window.partitionBy("action").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    v = values.withColumn("cn", F.sum("n").over(down)).withColumn("cp", F.sum("p").over(down)).withColumn("x", F.col("s") / MILLION)
    v = v.withColumn("c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x")))).withColumn("bin", F.least(F.lit(9), F.floor(F.greatest(F.lit(0), F.least(F.lit(MILLION), F.col("s"))) / 100_000)))
    bins = v.groupBy("action", "bin").agg(F.abs(F.sum(F.col("c") * F.col("n")) - F.sum("p")).alias("gap")).groupBy("action").agg(F.sum("gap").alias("gap"))
    hit = F.col("s") >= MILLION // 2
    tp, fp = F.sum(F.when(hit, F.col("p")).otherwise(0)), F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0))
    n, p = F.sum("n"), F.sum("p")
    mean = F.sum(F.col("x") * F.col("n")) / n
    one = v.groupBy("action").agg(
        n.alias("candidates"), p.alias("positives"), F.sum("t").alias("t"), tp.alias("tp"), fp.alias("fp"), F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("ap"),
        F.sum(F.col("x") * F.col("p")).alias("xp"), F.sum(F.col("x") * (F.col("n") - F.col("p"))).alias("xn"), F.min("x").alias("low"), F.max("x").alias("high"), mean.alias("mean"), (F.sum(F.col("x") * F.col("x") * F.col("n")) / n).alias("square"),
        (F.sum(F.col("c") * F.col("c") * (F.col("n") - F.col("p")) + (1 - F.col("c")) * (1 - F.col("c")) * F.col("p")) / n).alias("brier"),
    ).join(bins, "action")
    c = F.col
    precision, recall = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("positives"))
    made = {
        "positive_rate": c("positives") / c("candidates"), "average_precision": _ratio(c("ap"), c("positives")), "precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall),
        "mean_positive": _ratio(c("xp"), c("positives")), "mean_negative": _ratio(c("xn"), c("candidates") - c("positives")), "low": c("low"), "high": c("high"), "deviation": F.sqrt(F.greatest(F.lit(0.0), c("square") - c("mean") * c("mean"))),
        "brier": c("brier"), "ece": c("gap") / c("candidates"), "mean_target": c("t") / c("candidates"),
    }
    return one.select("action", "candidates", "positives", *[F.round(x, 6).alias(k) for k, x in made.items()])


def latency(seconds: float, candidates: int, cases: int) -> dict[str, float]:
    """Milliseconds in all and a case, and candidates a second, of a timed scoring."""
    return {"ms": seconds * 1000.0, "ms_per_case": seconds * 1000.0 / max(1, cases), "candidates_per_second": candidates / max(seconds, 1e-12)}


def hits_at(returned: DataFrame, relevant: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(method, k, precision, hit_rate, mrr): of ranked lists (method, query_id, node_id, rank) against relevant (query_id, node_id), meaned over all queries of ``relevant``.

    Precision is over k whatever a method returned; a query it returned nothing for counts as 0.
    """
    if min(ks) < 1:
        raise ValueError("ks must be positive")
    good = returned.join(relevant.select("query_id", "node_id").distinct(), ["query_id", "node_id"]).groupBy("method", "query_id").agg(F.collect_list("rank").alias("ranks"))
    asked = relevant.select("query_id").distinct().count()
    each = good.select("method", "query_id", "ranks", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).withColumn("hits", F.size(F.filter("ranks", lambda r: r <= F.col("k"))))
    per = each.groupBy("method", "k").agg(F.sum("hits").alias("h"), F.count_if(F.col("hits") > 0).alias("some"), F.sum(F.when(F.array_min("ranks") <= F.col("k"), 1.0 / F.array_min("ranks")).otherwise(0.0)).alias("rr"))
    methods = returned.select("method").distinct().select("method", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    n = F.lit(max(1, asked))
    none = F.lit(0.0)
    return methods.join(per, ["method", "k"], "left").select(
        "method", "k", F.round(F.coalesce(F.col("h") / (F.col("k") * n), none), 6).alias("precision"), F.round(F.coalesce(F.col("some") / n, none), 6).alias("hit_rate"), F.round(F.coalesce(F.col("rr") / n, none), 6).alias("mrr")
    )


def at_threshold(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("s") >= round(threshold * MILLION)
    c = prepared(rows).agg(F.sum((hit & (F.col("label") == 1)).cast("long")).alias("tp"), F.sum((hit & (F.col("label") == 0)).cast("long")).alias("fp"), F.sum((~hit & (F.col("label") == 1)).cast("long")).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_ratio(2 * p * r, p + r), 6).alias("f1"))


def best_f1(rows: DataFrame) -> DataFrame:
    """The lowest of the thresholds 0.00 to 1.00 with the greatest F1; 0 if none is positive."""
    step = F.least(F.lit(100), F.greatest(F.lit(-1), F.floor(F.col("s") / 10_000)))
    counts = prepared(rows).groupBy(step.cast("int").alias("step")).agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    grid = rows.sparkSession.range(-1, 101).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").fillna(0)
    up = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    runs = grid.withColumn("tp", F.sum("p").over(up)).withColumn("hit", F.sum("n").over(up)).withColumn("all_p", F.sum("p").over(Window.partitionBy(F.lit(1))))
    f1 = F.round(_ratio(2.0 * F.col("tp"), F.col("hit") + F.col("all_p")), 12)
    best = runs.filter("step >= 0").agg(F.max(F.struct(f1.alias("f1"), (-F.col("step")).alias("t"))).alias("b"))
    return best.select(F.round("b.f1", 6).alias("f1"), F.when(F.col("b.f1") == 0, 0.0).otherwise(F.round(-F.col("b.t") / 100.0, 2)).alias("threshold"))


def by_score(rows: DataFrame) -> DataFrame:
    """One row for each distinct score, best first: its candidates and positives and those up to it."""
    values = prepared(rows).groupBy("s").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    down = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("cn", F.sum("n").over(down)).withColumn("cp", F.sum("p").over(down))


#: Ranges of cases in which candidates of one score are counted by themselves.
RANGES = 64


def average_precision(rows: DataFrame) -> DataFrame:
    """Over all candidates; equal scores stay in input order (case_id, idx).

    A score that very many candidates share (0, where scores are missing) is not
    ordered by one task: candidates are counted by score and range of cases first,
    and ordered only within both. The ranges are cut at a sample of the case ids,
    which decides nothing but the sizes.
    """
    m = settled(prepared(rows).select("case_id", "idx", "s", "label", "score"), "scored")
    ids = m.select(F.col("case_id").cast("string").alias("c")).distinct()
    drawn = ids.select(F.struct(F.xxhash64("c").alias("h"), "c").alias("x")).orderBy("x").limit(RANGES * 8).select("x.c")
    cuts = sorted(r["c"] for r in drawn.collect())[4::8]
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    m = m.withColumn("range", F.size(F.filter(bounds, lambda c: c <= F.col("case_id").cast("string"))))
    cells = m.groupBy("s", "range").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("s", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n1"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p1"))
    runs = by_score(m).select("s", (F.col("cn") - F.col("n")).alias("n0"), (F.col("cp") - F.col("p")).alias("p0"))
    tie = Window.partitionBy("s", "range").orderBy("case_id", "idx")
    placed = m.withColumn("j", F.row_number().over(tie)).withColumn("pj", F.sum("label").over(tie.rowsBetween(Window.unboundedPreceding, 0)))
    hits = placed.filter("label = 1").join(cells, ["s", "range"]).join(runs, "s")
    hits = hits.select(((F.col("p0") + F.col("p1") + F.col("pj")) / (F.col("n0") + F.col("n1") + F.col("j"))).alias("precision"))
    return hits.agg(F.count("*").alias("positives"), F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 6).alias("average_precision"))


def pr_curve(rows: DataFrame) -> DataFrame:
    """A point for each distinct score."""
    total = F.sum("p").over(Window.partitionBy(F.lit(1)))
    return by_score(rows).select((F.col("s") / MILLION).alias("score"), F.round(F.col("cp") / F.col("cn"), 6).alias("precision"), F.round(_ratio(F.col("cp"), total), 6).alias("recall"))


def pr_summary(rows: DataFrame, levels: tuple[float, ...] = (0.80, 0.90, 0.95)) -> DataFrame:
    """(level, precision_at_recall, recall_at_precision): the best of the curve, 0 where it never gets there."""
    curve = pr_curve(rows)
    picks = [f(F.when(F.col(a) >= x, F.col(b))).alias(f"{n}{i}") for i, x in enumerate(levels) for n, a, b, f in (("p", "recall", "precision", F.max), ("r", "precision", "recall", F.max))]
    one = curve.agg(*picks)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("level"), F.coalesce(f"p{i}", F.lit(0.0)).alias("precision_at_recall"), F.coalesce(f"r{i}", F.lit(0.0)).alias("recall_at_precision")) for i, x in enumerate(levels)
    ])).alias("x")).select("x.*")


def calibration(rows: DataFrame) -> DataFrame:
    """Brier score and expected calibration error over ten bins, the last one closed."""
    m = prepared(rows).withColumn("c", F.greatest(F.lit(0), F.least(F.lit(MILLION), F.col("s"))))
    bins = m.groupBy(F.least(F.lit(9), F.floor(F.col("c") / 100_000)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("label").alias("p"), F.sum(F.pow(F.col("c") / MILLION - F.col("label"), F.lit(2.0))).alias("sq")
    )
    total = F.sum("n")
    return bins.agg(F.round(F.sum("sq") / total, 6).alias("brier"), F.round(F.sum(F.abs(F.col("c") / MILLION - F.col("p"))) / total, 6).alias("ece"))


def score_stats(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of scores by label; a single score deviates by 0."""
    x = F.col("s") / MILLION
    return prepared(rows).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 6).alias("deviation"))


def by_kind(rows: DataFrame) -> DataFrame:
    return prepared(rows).groupBy("kind").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.round(F.avg(F.col("s") / MILLION), 6).alias("mean_score"))


def percentiles(values: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Mean and nearest-rank percentiles."""
    def nearest(p: float) -> Column:
        return F.expr(f"percentile_disc({p}) within group (order by {value})")
    return values.groupBy(*group).agg(F.round(F.avg(value), 6).alias("mean"), F.round(nearest(0.5), 6).alias("p50"), F.round(nearest(0.95), 6).alias("p95"), F.round(nearest(0.99), 6).alias("p99"))


def retrieval(returned: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: precision (always over k), recall, hit and reciprocal rank of a ranked list against a set.

    returned is (query_id, node_id, rank), relevant (query_id, node_id). A query
    that returned nothing scores 0; a query with nothing relevant has recall 0.
    """
    good = relevant.withColumn("good", F.lit(1))
    hits = returned.filter(F.col("rank") <= k).join(good, ["query_id", "node_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("returned"), F.coalesce(F.sum("good"), F.lit(0)).alias("hits"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first")
    )
    want = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    both = want.join(hits, "query_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return both.select("query_id", F.coalesce("returned", F.lit(0)).alias("returned"), F.round(h / k, 6).alias("precision"), F.round(h / F.col("relevant"), 6).alias("recall"), (h > 0).cast("int").alias("hit"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def gates(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """(metric, value, least, passed) for long metrics (metric, value)."""
    wanted = metrics.sparkSession.createDataFrame(sorted(least.items()), "metric string, least double")
    got = F.broadcast(wanted).join(metrics, "metric", "left")
    return got.select("metric", "value", "least", (F.coalesce("value", F.lit(0.0)) >= F.col("least")).alias("passed"))


#: Candidates of one case that one task holds against the others of the case, about.
CASE_ROWS = 512


def target_pairs(rows: DataFrame, min_delta: float = 0.05) -> DataFrame:
    """Pairs of a case whose targets differ by ``min_delta`` or more, the greater first: case_id and score, target, weight of both (1 and 2).

    rows has case_id, score, target, weight (null counts as 1). The pairs go
    straight into an aggregate; a large case is dealt over salts, so that no task holds it alone.
    """
    m = rows.filter("target is not null").select("case_id", "idx", "score", "target", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    width = m.groupBy("case_id").agg(F.ceil(F.count("*") / CASE_ROWS).cast("int").alias("width"))
    m = m.join(width, "case_id")
    one = m.select("case_id", F.pmod(F.xxhash64("idx"), F.col("width")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}1") for c in ("score", "target", "weight")])
    two = m.select("case_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("salt"), *[F.col(c).alias(f"{c}2") for c in ("score", "target", "weight")])
    return one.join(two, ["case_id", "salt"]).filter(F.col("target1") - F.col("target2") >= min_delta)


def target_pairwise(rows: DataFrame, min_delta: float = 0.05) -> DataFrame:
    """(pairs, alike): pairs of all cases with clearly different targets, and those that the scores order the same way."""
    p = target_pairs(rows, min_delta)
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.col("score1") > F.col("score2")).alias("alike"))


def target_pairwise_sampled(rows: DataFrame, pairs: int = 200_000, min_delta: float = 0.05, seed: int = 0) -> DataFrame:
    """(pairs, alike) over about ``pairs`` pairs drawn from all candidates, whatever their case.

    Every candidate draws partners by hash(seed, candidate, draw); a pair drawn twice
    counts once, one of nearly equal targets not at all. Nothing is collected. The
    draws are the same wherever the rows stand. All pairs of a small table are drawn
    by none of this: take target_pairwise there.
    """
    if pairs < 1:
        raise ValueError("pairs must be positive")
    m = rows.filter("target is not null").select("case_id", "idx", "score", "target")
    # numbers are counted in hash buckets: the order is any fixed one
    b = m.withColumn("b", F.pmod(F.xxhash64("case_id", "idx"), F.lit(4096)).cast("int"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = b.groupBy("b").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("b").orderBy("case_id", "idx"))
    numbered = settled(b.join(sizes.select("b", "first"), "b").select((F.col("first") + place - 1).alias("i"), "score", "target"), "numbered")
    each = -(-pairs // max(1, n))
    share = pairs / max(1, n * each)
    drawn = numbered.select("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k")).filter(F.pmod(F.xxhash64(F.lit(seed), "i", "k", F.lit("keep")), F.lit(1 << 30)) < int(share * (1 << 30)))
    other = F.pmod(F.col("i") + 1 + F.pmod(F.xxhash64(F.lit(seed), "i", "k"), F.lit(max(1, n - 1))), F.lit(max(1, n)))
    drawn = drawn.withColumn("j", other).filter("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    both = drawn.join(numbered, "i").join(numbered.select(F.col("i").alias("j"), F.col("score").alias("s2"), F.col("target").alias("t2")), "j")
    p = both.filter(F.abs(F.col("target") - F.col("t2")) >= min_delta)
    return p.agg(F.count("*").alias("pairs"), F.count_if((F.col("target") - F.col("t2")) * (F.col("score") - F.col("s2")) > 0).alias("alike"))


def pairwise_loss(rows: DataFrame, margin: float = 0.2, min_delta: float = 0.05) -> DataFrame:
    """Margin loss over the pairs of a case whose targets differ by ``min_delta``; the margin grows with the gap.

    rows has score, target and weight (null weights count as 1). Pairs are made and summed by
    many tasks and never kept.
    """
    weight = F.sqrt(F.greatest("weight1", F.lit(0.0)) * F.greatest("weight2", F.lit(0.0)))
    loss = F.greatest(F.lit(0.0), margin * (F.col("target1") - F.col("target2")) - (F.col("score1") - F.col("score2")))
    per = target_pairs(rows, min_delta).groupBy("case_id").agg(F.sum(weight * loss).alias("l"), F.sum(weight).alias("w"))
    return per.agg(F.count("*").alias("cases"), F.round(F.coalesce(F.avg(F.col("l") / F.greatest("w", F.lit(1e-12))), F.lit(0.0)), 6).alias("loss"))


def listwise_loss(rows: DataFrame, temperature: float = 0.15) -> DataFrame:
    """Cross entropy of the case's score softmax against its target softmax (temperature on targets only); cases of no target mass are left out."""
    m = rows.withColumn("mass", F.sum("target").over(in_case())).filter("mass > 0")
    m = m.withColumn("te", F.exp((F.col("target") - F.max("target").over(in_case())) / max(temperature, 1e-6))).withColumn("top", F.max("score").over(in_case()))
    m = m.withColumn("ts", F.sum("te").over(in_case())).withColumn("ls", F.log(F.sum(F.exp(F.col("score") - F.col("top"))).over(in_case())))
    per = m.groupBy("case_id").agg((-F.sum(F.col("te") / F.col("ts") * (F.col("score") - F.col("top") - F.col("ls")))).alias("l"))
    return per.agg(F.count("*").alias("cases"), F.round(F.coalesce(F.avg("l"), F.lit(0.0)), 6).alias("loss"))
