"""Identity rollups, cohort aggregates and onboarding features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as M

#: Metric -> (stage, direction).
METRICS = {
    "spectral_peak_ratio": ("manufacture", "higher"), "residual_kurtosis": ("manufacture", "higher"), "color_corr_anomaly": ("manufacture", "higher"),
    "saturation_clip_ratio": ("manufacture", "higher"), "template_match_score": ("manufacture", "lower"), "exif_consistency": ("manufacture", "lower"), "liveness_score": ("manufacture", "lower"),
    "thin_file_share": ("onboard", "higher"), "credit_age_ratio": ("onboard", "lower"), "declared_age": ("onboard", "neutral"), "address_shared_count": ("onboard", "higher"),
    "pii_recombination_share": ("onboard", "higher"), "shared_device_share": ("onboard", "higher"), "shared_address_share": ("onboard", "higher"), "shared_phone_share": ("onboard", "higher"),
    "accounts_transacting": ("weaponise", "count"), "attempts": ("weaponise", "count"), "distinct_pans_per_account": ("weaponise", "higher"), "decline_ratio": ("weaponise", "higher"),
    "cvv_mismatch_rate": ("weaponise", "higher"), "avs_mismatch_rate": ("weaponise", "higher"), "zero_auth_ratio": ("weaponise", "higher"), "low_ticket_ratio": ("weaponise", "higher"),
    "pan_digit_entropy": ("weaponise", "lower"), "merchants_per_account": ("weaponise", "neutral"), "peak_attempts_per_hour": ("weaponise", "higher"),
}
SIGNALS = [m for m, (stage, _) in METRICS.items() if stage == "manufacture"]
SUFFIXES = 400


def first_suffixes(auth: DataFrame, key: str) -> DataFrame:
    """M3: each key's first 400 suffixes by time, as ``_s``. The rank is limited before the shuffle, so that a key with
    very many attempts sends 400 a partition."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ts", "seq"))
    first = auth.select(key, "ts", "seq", "suffix").withColumn("_n", nth).filter(F.col("_n") <= SUFFIXES)
    return first.groupBy(key).agg(F.collect_list("suffix").alias("_s"))


def rollup(auth: DataFrame, key: str = "identity") -> DataFrame:
    """A1: sums over the attempts of each identity; the first 400 suffixes by time feed the digit entropy."""
    one = lambda c: F.sum(c.cast("long"))
    g = auth.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), one(M.declined(F.col("response_code"))).alias("declines"), one(M.cvv_bad(F.col("cvv_result"))).alias("cvv_mismatch"), one(M.avs_mismatch(F.col("avs_result"))).alias("avs_mismatch"),
        one(F.col("zero_auth")).alias("zero_auth"), one(M.low_ticket(F.col("amount"))).alias("low_ticket"), F.countDistinct("card").alias("cards"), F.countDistinct("merchant").alias("merchants"), F.countDistinct("device").alias("devices"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return g.join(first_suffixes(auth, key), key).withColumn("digit_entropy", M.digit_entropy(F.col("_s"))).withColumn("peak_per_hour", M.peak_hourly_rate(F.col("attempts"), F.col("first_ts"), F.col("last_ts"))).drop("_s")


def token_counts(people: DataFrame, tokens: tuple[str, ...] = ("device", "address", "phone", "dob", "ip")) -> DataFrame:
    """Applicants per token over everybody, by grouped counts joined back, so that a common token is counted
    map-side first."""
    out = people
    for t in tokens:
        out = out.join(people.groupBy(t).agg(F.count(F.lit(1)).alias(f"shared_{t}_count")), t, "left")
    return out


def name_variety(people: DataFrame, tokens: tuple[str, ...] = ("dob", "phone", "address")) -> DataFrame:
    """Distinct names per token."""
    out = people
    for t in tokens:
        out = out.join(people.groupBy(t).agg(F.countDistinct("name").alias(f"{t}_name_variety")), t, "left")
    return out


def cohort_rows(people: DataFrame, rollups: DataFrame) -> DataFrame:
    """A row a member with all it adds to any cohort's aggregate; signals that ``people`` lacks are left out."""
    rows = name_variety(token_counts(people)).join(rollups, "identity", "left")
    return rows.withColumns({
        "_thin": M.thin_file(F.col("credit_months")).cast("double"), "_ratio": M.credit_age_ratio(F.col("credit_months"), F.col("age")),
        "_pii": ((F.col("dob_name_variety") > 1) | (F.col("phone_name_variety") > 1) | (F.col("address_name_variety") > 1)).cast("double"),
        **{f"_{t}": (F.col(f"shared_{t}_count") > 1).cast("double") for t in ("device", "address", "phone")},
    })


def aggregate(rows: DataFrame, cohort: str) -> DataFrame:
    """A2: means of members, sums over sums for attempts, means over transacting members only. Without one, the weaponise
    figures but the two counts are null."""
    have = {"liveness": "liveness_score", "kurtosis": "residual_kurtosis"}
    signals = [F.avg(c).alias(have.get(c, c)) for c in rows.columns if c in have or c in SIGNALS]
    share = lambda c: F.sum(c) / F.sum("attempts")
    return rows.groupBy(cohort).agg(
        *signals, F.avg("_thin").alias("thin_file_share"), F.avg("_ratio").alias("credit_age_ratio"), F.avg("age").alias("declared_age"), F.avg("shared_address_count").alias("address_shared_count"),
        F.avg("_pii").alias("pii_recombination_share"), *[F.avg(f"_{t}").alias(f"shared_{t}_share") for t in ("device", "address", "phone")],
        F.count("attempts").cast("double").alias("accounts_transacting"), F.coalesce(F.sum("attempts"), F.lit(0)).cast("double").alias("attempts"), F.avg("cards").alias("distinct_pans_per_account"),
        share("declines").alias("decline_ratio"), share("cvv_mismatch").alias("cvv_mismatch_rate"), share("avs_mismatch").alias("avs_mismatch_rate"), share("zero_auth").alias("zero_auth_ratio"), share("low_ticket").alias("low_ticket_ratio"),
        F.avg("digit_entropy").alias("pan_digit_entropy"), F.avg("merchants").alias("merchants_per_account"), F.avg("peak_per_hour").alias("peak_attempts_per_hour"),
    )


def unpivot(wide: DataFrame, cohort: str) -> DataFrame:
    metrics = [m for m in METRICS if m in wide.columns]
    return wide.select(cohort, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(cohort, "x.*")


def compare(ring: Column, rest: Column, direction: Column) -> tuple[Column, Column]:
    """A5: (ratio, elevated): no ratio for counts or against 0 or nothing; a strict comparison in the metric's direction."""
    ratio = F.when((direction != "count") & (rest != 0), ring / rest)
    return ratio, F.when(rest.isNotNull() & (direction == "higher"), ring > rest).when(rest.isNotNull() & (direction == "lower"), ring < rest)


def ring_evidence(pivoted: DataFrame) -> DataFrame:
    """pivoted: ring, metric, value, baseline."""
    meta = lambda k: F.element_at(F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[k])]), F.col("metric"))
    out = pivoted.withColumn("stage", meta(0)).withColumn("direction", meta(1)).filter("value IS NOT NULL")
    ratio, up = compare(F.col("value"), F.col("baseline"), F.col("direction"))
    return out.withColumn("ratio", ratio).withColumn("elevated", up)


def for_rings(people: DataFrame, rollups: DataFrame, rings: list) -> DataFrame:
    """A5 for the named rings: ring, stage, metric, direction, value, baseline, ratio, elevated. The baseline is everybody
    but the ring (J5): each row is dealt to one cohort a ring, which costs rows times rings asked for."""
    rows = cohort_rows(people, rollups).withColumn("_r", F.explode(F.array(*[F.lit(r) for r in rings]))).withColumn("cohort", F.struct(F.col("_r").alias("ring"), F.col("ring").eqNullSafe(F.col("_r")).alias("inside")))
    long = unpivot(aggregate(rows, "cohort"), "cohort")
    return ring_evidence(long.groupBy(F.col("cohort.ring").alias("ring"), "metric").agg(F.max(F.when(F.col("cohort.inside"), F.col("value"))).alias("value"), F.max(F.when(~F.col("cohort.inside"), F.col("value"))).alias("baseline")))


def for_every_ring(people: DataFrame, rollups: DataFrame) -> DataFrame:
    """A5 for every ring that occurs. Each row is read once: a metric is a sum over a sum, and the baseline's sums are
    everybody's less the ring's own."""
    have = {"liveness": "liveness_score", "kurtosis": "residual_kurtosis"}
    means = {have.get(c, c): c for c in people.columns if c in have or c in SIGNALS} | {
        "thin_file_share": "_thin", "credit_age_ratio": "_ratio", "declared_age": "age", "address_shared_count": "shared_address_count", "pii_recombination_share": "_pii", **{f"shared_{t}_share": f"_{t}" for t in ("device", "address", "phone")},
        "distinct_pans_per_account": "cards", "pan_digit_entropy": "digit_entropy", "merchants_per_account": "merchants", "peak_attempts_per_hour": "peak_per_hour",
    }
    shares = {"decline_ratio": "declines", "cvv_mismatch_rate": "cvv_mismatch", "avs_mismatch_rate": "avs_mismatch", "zero_auth_ratio": "zero_auth", "low_ticket_ratio": "low_ticket"}
    one = F.lit(1)
    parts = {m: (F.sum(c), F.count(c)) for m, c in means.items()} | {m: (F.sum(c), F.sum("attempts")) for m, c in shares.items()} | {"accounts_transacting": (F.count("attempts"), F.max(one)), "attempts": (F.sum("attempts"), F.max(one))}
    sums = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(a.cast("double"), F.lit(0.0)).alias("a"), F.coalesce(b.cast("double"), F.lit(0.0)).alias("b")) for m, (a, b) in parts.items()])
    long = cohort_rows(people, rollups).groupBy("ring").agg(sums.alias("x"), F.count(one).alias("rows")).select("ring", "rows", F.explode("x").alias("x")).select("ring", "rows", "x.*")
    counted = F.col("metric").isin("accounts_transacting", "attempts")
    total = long.groupBy("metric").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.sum("rows").alias("all"))
    both = long.filter("ring IS NOT NULL").join(F.broadcast(total), "metric")  # a row a metric
    rest = F.when(counted, F.when(F.col("all") > F.col("rows"), F.col("ta") - F.col("a"))).otherwise(F.try_divide(F.col("ta") - F.col("a"), F.col("tb") - F.col("b")))
    value = F.when(counted, F.col("a")).otherwise(F.try_divide("a", "b"))
    return ring_evidence(both.select("ring", "metric", value.alias("value"), rest.alias("baseline")))


def top_signals(evidence: DataFrame, least: float = 1.5, limit: int = 3) -> DataFrame:
    """Each ring and stage's strongest elevated metrics, with the phrase that the narrative uses."""
    strong = evidence.filter("elevated AND ratio IS NOT NULL AND ratio <> 0").withColumn("severity", M.severity(F.col("ratio"))).filter(F.col("severity") >= least)
    shown = F.when(F.col("severity") >= 10, F.format_string("%.0f", "severity")).otherwise(F.format_string("%.1f", "severity"))
    text = F.concat(F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(" "), shown, F.lit("x "), F.when(F.col("direction") == "higher", "above").otherwise("below"))
    w = Window.partitionBy("ring", "stage").orderBy(F.desc("severity"), F.desc("metric"))
    return strong.withColumn("text", text).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def onboarding_features(people: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """A9. near (A8): identity, kind, n of near-duplicate tags."""
    shaped = people.withColumn("_shape", M.handle_shape(F.col("handle")))
    out = name_variety(token_counts(shaped), ("dob", "phone")).join(shaped.groupBy("_shape").agg(F.count(F.lit(1)).alias("email_shape_frequency")), "_shape")
    if near is not None:
        kinds = ("face", "doc_template", "hypervector")
        wide = near.groupBy("identity").pivot("kind", list(kinds)).agg(F.sum("n"))
        out = out.join(wide.select("identity", *[F.col(k).alias(f"near_dup_{k}_count") for k in kinds]), "identity", "left").fillna(0, [f"near_dup_{k}_count" for k in kinds])
    return out.withColumns({"credit_age_ratio": M.credit_age_ratio(F.col("credit_months"), F.col("age")), "is_thin_file": M.thin_file(F.col("credit_months")).cast("double")}).drop("_shape")


def tag_degree(pairs: DataFrame) -> DataFrame:
    """Near-duplicate partners of each identity by kind. pairs: left, right, kind."""
    ends = pairs.select(F.col("left").alias("identity"), "kind").union(pairs.select(F.col("right").alias("identity"), "kind"))
    return ends.groupBy("identity", "kind").agg(F.count(F.lit(1)).alias("n"))


def ring_visibility(people: DataFrame) -> DataFrame:
    """Of each ring, its size, institutions, and the share the largest institution sees."""
    by = people.filter("ring IS NOT NULL").groupBy("ring", "institution").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("ring").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("institutions"), (F.max("n") / F.sum("n")).alias("largest_share"))


def intervention_rate(decisions: DataFrame) -> DataFrame:
    """A18"""
    return decisions.agg(F.avg((F.col("action") != "allow").cast("double")).alias("rate"))
