"""Thresholds at a false-positive budget, and what they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LeakageError
from .ordered import running_totals

TARGET_FPR = 0.001
LEAST_POSITIVES = 25
#: Scenario order of the robustness curve.
SCENARIOS = ("sloppy", "moderate", "sophisticated", "drift")


def threshold_at_fpr(scored: DataFrame, fpr: float = TARGET_FPR, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """L4: the lowest score at which the share of negatives at or above it stays within the budget; infinity if none does.
    Counts per distinct score first; their running sum goes over ranges of scores, so that many scores are no one task."""
    levels = scored.groupBy(*by, F.col(score).alias("_s")).agg(F.sum((F.col(y) == 0).cast("long")).alias("_neg"))
    held = running_totals(levels, "_s", {"_below": "_neg"}, by)
    total = levels.groupBy(*by).agg(F.sum("_neg").alias("_all"))
    met = held.join(total, list(by)) if by else held.crossJoin(F.broadcast(total))  # one row
    return met.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_all") - F.col("_below") <= fpr * F.col("_all"), F.col("_s"))), F.lit(float("inf"))).alias("threshold"))


def rank_auc(scored: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the curve with ties at half, from counts per distinct score."""
    levels = scored.groupBy(F.col(score).alias("_s")).agg(F.sum((F.col(y) == 1).cast("double")).alias("p"), F.sum((F.col(y) == 0).cast("double")).alias("n"))
    ranked = running_totals(levels, "_s", {"_below": "n"})
    return ranked.withColumn("u", F.col("p") * (F.col("_below") + F.col("n") / 2)).agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc"))


def at_threshold(scored: DataFrame, threshold: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Detection, precision, realised rate at the (single-row) threshold."""
    hit = F.col(score) >= F.col("threshold")
    n = lambda c: F.sum(c.cast("double"))
    pos, neg = F.col(y) == 1, F.col(y) == 0
    return scored.crossJoin(F.broadcast(threshold)).agg(  # one row
        F.max("threshold").alias("threshold"), F.try_divide(n(hit & pos), n(pos)).alias("detection_rate"), F.try_divide(n(hit & pos), n(hit)).alias("precision"), F.try_divide(n(hit & neg), n(neg)).alias("false_positive_rate"),
    )


def evaluate(scored: DataFrame, fpr: float = TARGET_FPR) -> DataFrame:
    return at_threshold(scored, threshold_at_fpr(scored, fpr)).crossJoin(rank_auc(scored))  # one row each


def false_decline(scored: DataFrame, threshold: DataFrame, cohort: Column) -> DataFrame:
    """False declines of legitimate events by cohort."""
    legit = scored.filter("y = 0").crossJoin(F.broadcast(threshold))  # one row
    return legit.groupBy(cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") >= F.col("threshold")).cast("long")).alias("declined"), (F.sum((F.col("score") >= F.col("threshold")).cast("double")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("rate"))


def attempts_to_detection(scored: DataFrame, threshold: DataFrame, account: str = "account", order: str = "doc_id") -> DataFrame:
    """Of accounts with fraud, how many were caught and after how many attempts (over the caught only)."""
    nth = F.row_number().over(Window.partitionBy(account).orderBy(order))
    each = scored.filter("y = 1").withColumn("nth", nth).crossJoin(F.broadcast(threshold)).groupBy(account).agg(F.min(F.when(F.col("score") >= F.col("threshold"), F.col("nth"))).alias("at"))
    return each.agg(
        F.count(F.lit(1)).alias("accounts_with_fraud"), F.count("at").alias("accounts_caught"), (F.count(F.lit(1)) - F.count("at")).alias("accounts_never_caught"),
        F.percentile("at", 0.5).alias("median_attempts"), F.percentile("at", 0.9).alias("p90_attempts"), F.avg("at").alias("mean_attempts"),
    )


def ring_recall(truth: DataFrame, flagged: DataFrame) -> DataFrame:
    """E5: of ring members that never acted, how many were flagged; a row a ring and one over all (null ring)."""
    met = truth.filter("is_synthetic AND ring IS NOT NULL").join(flagged.select("identity").distinct().withColumn("_f", F.lit(1)), "identity", "left")
    never = F.col("first_fraud").isNull()
    out = met.rollup("ring").agg(F.count(F.lit(1)).alias("size"), F.sum(never.cast("long")).alias("never_transacted"), F.sum((never & F.col("_f").isNotNull()).cast("long")).alias("flagged"))
    return out.withColumn("recall", F.col("flagged") / F.greatest(F.lit(1), F.col("never_transacted")))


def propagation_precision(truth: DataFrame, flagged: DataFrame, seeds: DataFrame) -> DataFrame:
    """E6"""
    out = flagged.select("identity").distinct().join(seeds.select("identity"), "identity", "left_anti")
    rings = truth.join(seeds.select("identity"), "identity", "left_semi").filter("ring IS NOT NULL").select("ring").distinct().withColumn("_r", F.lit(1))
    met = out.join(truth, "identity", "left").join(rings, "ring", "left")
    total = truth.agg(F.count(F.lit(1)).alias("identities_total"))
    syn = F.coalesce(F.col("is_synthetic"), F.lit(False))
    n = met.agg(F.count(F.lit(1)).alias("flagged"), F.sum(syn.cast("long")).alias("tp"), F.sum((syn & F.col("_r").isNotNull()).cast("long")).alias("same"))
    return n.crossJoin(total).select("identities_total", "flagged", (F.col("flagged") / F.greatest(F.lit(1), "identities_total")).alias("flagged_share"), F.try_divide("tp", "flagged").alias("precision_synthetic"), F.try_divide("same", "flagged").alias("precision_same_ring"), (F.col("flagged") - F.col("tp")).alias("false_flags"))


def view_delta(scored: DataFrame, group: str, fpr: float = TARGET_FPR, least: int = 500, most: int = 40) -> DataFrame:
    """The same events scored with the whole network's windows (score) and a group's own (scoped), both thresholded
    once over the pooled groups: those with enough events and some fraud, the most fraud first."""
    sizes = scored.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_f")).filter((F.col("_n") >= least) & (F.col("_f") > 0))
    top = sizes.orderBy(F.desc("_f"), group).limit(most).select(group)
    pooled = scored.join(F.broadcast(top), group)  # at most ``most`` rows
    net, own = threshold_at_fpr(pooled, fpr).withColumnRenamed("threshold", "_net"), threshold_at_fpr(pooled, fpr, score="scoped").withColumnRenamed("threshold", "_own")
    rate = lambda s, t: F.sum(((F.col("y") == 1) & (F.col(s) >= F.col(t))).cast("double")) / F.greatest(F.lit(1), F.sum("y"))
    return pooled.crossJoin(F.broadcast(net)).crossJoin(F.broadcast(own)).agg(  # one row each
        F.countDistinct(group).alias("groups_compared"), F.count(F.lit(1)).alias("events"), F.sum("y").alias("fraud"), rate("scoped", "_own").alias("scoped_rate"), rate("score", "_net").alias("network_rate"),
        (rate("score", "_net") - rate("scoped", "_own")).alias("delta"),
    )


def point_in_time(labels: DataFrame, cutoff: Column, strict: bool = False) -> DataFrame:
    """Labels available by the cutoff; ``strict`` raises if any is not."""
    late = F.col("label_available_at") > cutoff
    if strict and labels.filter(late).limit(1).count():
        raise LeakageError("labels that were not available at the cutoff")
    return labels.filter(~late)


def out_of_time(features: DataFrame, split: Column, ts: str = "ts") -> DataFrame:
    """Only what comes after the split is scored; apply after the windows are built."""
    return features.filter(F.col(ts) > split)


def enough_positives(rows: DataFrame, y: str = "y", least: int = LEAST_POSITIVES) -> DataFrame:
    """L9"""
    n = rows.filter(F.col(y) == 1).limit(least).count()
    if n < least:
        raise ValueError(f"{n} positives; at least {least} are needed")
    return rows


def curve(scored: DataFrame, recall: DataFrame, fpr: float = TARGET_FPR) -> DataFrame:
    """The eleven figures of every scenario, all in grouped passes. scored: scenario, y, score, scoped, account, doc_id,
    lookalike; recall: scenario, recall (of ring members before they transact)."""
    by = ("scenario",)
    net = threshold_at_fpr(scored, fpr, by=by).withColumnRenamed("threshold", "_t")
    own = threshold_at_fpr(scored, fpr, score="scoped", by=by).withColumnRenamed("threshold", "_o")
    levels = scored.groupBy(*by, F.col("score").alias("_s")).agg(F.sum((F.col("y") == 1).cast("double")).alias("p"), F.sum((F.col("y") == 0).cast("double")).alias("n"))
    area = running_totals(levels, "_s", {"_below": "n"}, by).withColumn("u", F.col("p") * (F.col("_below") + F.col("n") / 2)).groupBy(*by).agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc"))
    met = scored.join(net, list(by)).join(own, list(by))
    n = lambda c: F.sum(c.cast("double"))
    bad, good, hit = F.col("y") == 1, F.col("y") == 0, F.col("score") >= F.col("_t")
    rates = met.groupBy(*by).agg(
        F.try_divide(n(hit & good), n(good)).alias("realised_fpr"), F.try_divide(n(hit & bad), n(bad)).alias("detection_rate"), F.try_divide(n(hit & good & F.col("lookalike")), n(good & F.col("lookalike"))).alias("lookalike_false_decline"),
        F.try_divide(n((F.col("scoped") >= F.col("_o")) & bad), n(bad)).alias("merchant_view_detection_rate"),
    )
    nth = F.row_number().over(Window.partitionBy(*by, "account").orderBy("doc_id"))
    caught = met.filter(bad).withColumn("nth", nth).groupBy(*by, "account").agg(F.min(F.when(hit, F.col("nth"))).alias("at"))
    tries = caught.groupBy(*by).agg(F.percentile("at", 0.5).alias("median_attempts_to_detection"), (F.count(F.lit(1)) - F.count("at")).alias("accounts_never_caught"))
    out = rates.join(area, list(by), "left").join(tries, list(by), "left").join(recall, list(by), "left")
    return out.select(
        "scenario", F.lit(fpr).alias("target_fpr"), "realised_fpr", "auc", "detection_rate", "median_attempts_to_detection", "accounts_never_caught", F.col("recall").alias("ring_recall_before_transacting"), "lookalike_false_decline",
        "merchant_view_detection_rate", F.col("detection_rate").alias("network_view_detection_rate"),
    )


def robustness_curve(reports: DataFrame) -> DataFrame:
    """Reports (scenario and figures) in the order of difficulty, others last by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in SCENARIOS]), F.col("scenario"))
    return reports.withColumn("_p", F.when(place > 0, place).otherwise(len(SCENARIOS) + 1)).orderBy("_p", "scenario").drop("_p")
