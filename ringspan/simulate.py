"""Seeded scenarios as Spark tables (D1-D13): worlds, people, rings, traffic, labels, telemetry.

Every draw is a hash of (seed, name, ids), so tables are the same whatever the partitioning. numpy's streams can't be
had in Spark; distributions and invariants are kept instead (:func:`verify`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as M
from .functions import sketches as H

DAY_US = 86_400_000_000


class Draws:
    def __init__(self, seed: int):
        self.seed = seed

    def u(self, name: str, *ids) -> Column:
        """Uniform in (0, 1)."""
        h = F.xxhash64(F.lit(self.seed), F.lit(name), *[F.col(i) if isinstance(i, str) else i for i in ids])
        return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def n(self, name: str, *ids) -> Column:
        """Standard normal, Box-Muller."""
        return F.sqrt(-2 * F.log(self.u(f"{name}:a", *ids))) * F.cos(2 * 3.141592653589793 * self.u(f"{name}:b", *ids))

    def pick(self, name: str, low, high, *ids) -> Column:
        """Whole number in [low, high]."""
        low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
        return (low + F.floor(self.u(name, *ids) * (high - low + 1))).cast("long")

    def gamma(self, name: str, shape: float, *ids) -> Column:
        """Gamma of a shape of 1 or more, by the cube of a normal (Wilson and Hilferty)."""
        return shape * F.pow(F.greatest(F.lit(1e-3), 1 - 1 / (9.0 * shape) + self.n(name, *ids) / (3.0 * shape**0.5)), F.lit(3.0))

    def beta(self, name: str, a: float, b: float, *ids) -> Column:
        """Two gammas, one over their sum."""
        x, y = self.gamma(f"{name}:x", a, *ids), self.gamma(f"{name}:y", b, *ids)
        return x / (x + y)


def token(kind: str, *parts) -> Column:
    return M.opaque_token(kind, F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


#: Fixed value: share of customers whose cards are reissued.
REISSUED = 0.08


def people(spark: SparkSession, cfg: dict) -> DataFrame:
    """Customers, look-alikes and ring members, one row each with all they were given."""
    d, p, r, look, days = Draws(cfg["seed"]), cfg["population"], cfg["ring"], cfg["lookalikes"], cfg["days"]
    kinds = [("small_business", look["n_small_business"]), ("traveller", look["n_travellers"]), ("new_device", look["n_new_device"])]
    rings = spark.range(r["n_rings"]).select(F.col("id").alias("ring")).withColumn("size", d.pick("size", r["ring_size_min"], r["ring_size_max"], "ring"))
    members = rings.select("ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("slot")).select((F.lit(10_000_000) + F.col("ring") * 100_000 + F.col("slot")).alias("id"), F.lit("ring").alias("cohort"), "ring")
    plain = spark.range(p["n_customers"]).select("id", F.lit("customer").alias("cohort"), F.lit(None).cast("long").alias("ring"))
    for i, (kind, n) in enumerate(kinds):
        plain = plain.union(spark.range(n).select((F.col("id") + 1_000_000 * (i + 1)).alias("id"), F.lit(kind).alias("cohort"), F.lit(None).cast("long").alias("ring")))
    all_ = plain.union(members)
    bad = F.col("ring").isNotNull()
    born = F.when(bad, d.u("born", "id") * days * r["onboard_window_fraction"]).when(d.u("old", "id") < 0.85, -d.u("ago", "id") * 3650).otherwise(d.u("born", "id") * days)
    # Members who begin after the drift share devices less
    late = F.lit(bool(cfg["drift"]["enabled"])) & (born + d.pick("wait", r["dormancy_days_min"], r["dormancy_days_max"], "id") >= cfg["drift"]["at_fraction"] * days)
    reuse = F.when(late, r["device_reuse_rate"] * cfg["drift"]["device_reuse_mult"]).otherwise(F.lit(float(r["device_reuse_rate"])))
    # a ring member shares a thing of its ring at the profile's rate, or has its own
    share = lambda name, rate, spread: F.when(bad & (d.u(f"share:{name}", "id") < rate), F.concat(F.lit("r"), F.col("ring").cast("string"), F.lit("_"), d.pick(f"which:{name}", 0, spread - 1, "id").cast("string"))).otherwise(F.concat(F.lit("i"), F.col("id").cast("string")))
    made = all_.withColumns({
        "institution": d.pick("inst", 0, p["n_institutions"] - 1, "id"), "born_day": born, "device": share("device", reuse, 3), "subnet": share("ip", r["subnet_concentration"], 2), "dob": share("dob", r["pii_recombination_rate"], 4),
        "phone": share("phone", r["pii_recombination_rate"], 4), "address": share("address", r["pii_recombination_rate"], 3), "template": share("doc", r["doc_template_reuse"], 1), "face": share("face", r["face_reuse_rate"], 2),
        "age": d.pick("age", 18, 80, "id"), "dormant": bad & (d.u("dormant", "id") < r["dormant_share"]), "start": d.pick("wait", r["dormancy_days_min"], r["dormancy_days_max"], "id"),
    })
    # What changes in a life; travellers travel and new devices come for sure in those cohorts
    always = lambda cohort, rate: F.when(F.col("cohort") == cohort, 1.0).otherwise(F.lit(float(rate)))
    event = lambda name, rate, span=days: F.when(~bad & (d.u(f"{name}?", "id") < rate), d.u(f"{name} day", "id") * span)
    made = made.withColumns({
        "devices": F.when(bad, F.lit(1).cast("long")).otherwise(d.pick("devices", p["devices_min"], p["devices_max"], "id")), "cards": F.when(bad, F.lit(1).cast("long")).otherwise(d.pick("cards", 1, 3, "id")),
        "changed_device": event("device change", always("new_device", p["p_device_change"])), "moved": event("move", F.lit(float(p["p_move"]))), "reissued": event("reissue", F.lit(REISSUED)),
        "left": event("travel", always("traveller", p["p_travel"]), max(1.0, days - 14.0)),
    }).withColumn("back", F.col("left") + 3 + 13 * d.u("travel length", "id"))
    months = F.when(bad, d.pick("file", 0, 18, "id")).otherwise(F.floor(d.u("file", "id") * F.greatest(F.lit(6), (F.col("age") - 18) * 12)).cast("long"))
    # every ring has a dormant and an active member
    nth = F.row_number().over(Window.partitionBy("ring").orderBy("id"))
    return made.withColumn("credit_months", months).withColumn("_n", F.when(bad, nth)).withColumn("dormant", F.when(F.col("_n") == 1, True).when(F.col("_n") == 2, False).otherwise(F.col("dormant"))).drop("_n")


PORTRAIT = "id bigint, face_tag struct<dim:int,indices:array<int>,seed_id:string>, doc_template_tag struct<dim:int,indices:array<int>,seed_id:string>, spectral_peak_ratio double, residual_kurtosis double, color_corr_anomaly double, saturation_clip_ratio double"


def portraits(folk: DataFrame, cfg: dict) -> DataFrame:
    """Of each applicant a rendered portrait and page: their tags, and the portrait's measured statistics. Those who
    share a face differ by the jitter; a shared template is the same but for its rendering."""
    jitter, strength, seed = cfg["ring"]["face_jitter"], cfg["ring"]["artifact_strength"], str(cfg["seed"])

    def run(batches):
        import pandas as pd

        from .functions import images as I
        from .functions.sketches import FlyHash, seeded

        face_tags, page_tags = FlyHash(99, seed_id=seed), FlyHash(160, seed_id=seed)
        for pdf in batches:
            out, faces, pages = [], [], []
            for one, face, template, ring in zip(pdf["id"], pdf["face"], pdf["template"], pdf["ring"], strict=True):
                rng = seeded(seed, "portrait", str(one))
                picture = I.face(seeded(seed, "face", face).normal(size=64) + jitter * rng.normal(size=64), rng, not pd.isna(ring), strength)
                page = I.layout(int(seeded(seed, "template", template).integers(1 << 40)), rng)
                faces.append(I.descriptor(picture))
                pages.append(I.ink_grid(page))
                out.append(I.artifacts(picture))
            if out:
                tags = [[{"dim": h.dim, "indices": t, "seed_id": h.seed_id} for t in h.tags(x)] for h, x in ((face_tags, faces), (page_tags, pages))]
                yield pd.DataFrame({"id": pdf["id"], "face_tag": tags[0], "doc_template_tag": tags[1], **{k: [s[k] for s in out] for k in out[0]}})

    return folk.select("id", "face", "template", "ring").mapInPandas(run, PORTRAIT)


def onboarding(folk: DataFrame, cfg: dict) -> DataFrame:
    d = Draws(cfg["seed"])
    bad = F.col("ring").isNotNull()
    start = F.lit(cfg["start_date"]).cast("timestamp")
    vendor = lambda name, genuine, fake: F.when(bad, d.beta(name, *fake, "id")).otherwise(d.beta(name, *genuine, "id"))
    seen = portraits(folk, cfg)
    vector = H.identity_hypervector({"face": F.col("face_tag.indices"), "doc_template": F.col("doc_template_tag.indices")}, 4096, 205)
    shared = folk.groupBy("address").agg(F.count(F.lit(1)).alias("_shared"))
    handle = F.concat(F.lit("user"), F.when(bad, F.lit(".")).otherwise(F.lit("")), d.pick("handle", 1, 9999, "id").cast("string"))
    return folk.join(shared, "address").join(seen, "id").select(
        token("evt", F.lit("onb"), "id").alias("event_id"), F.timestamp_micros(F.unix_micros(start) + (F.col("born_day") * DAY_US).cast("long")).alias("ts"), F.concat(F.lit(f"{cfg['institution_prefix']}_"), F.col("institution")).alias("institution_id"),
        token("app", "id").alias("application_id"), token("idn", "id").alias("identity_id"), token("acc", "id").alias("account_id"), token("nam", "id").alias("name_token"), token("dob", "dob").alias("dob_token"), token("adr", "address").alias("address_token"),
        token("eml", "id").alias("email_token"), token("phn", "phone").alias("phone_token"), M.handle_shape(handle).alias("email_handle_shape"), token("dev", "device").alias("device_id"), token("ip", "subnet").alias("ip_id"),
        d.pick("asn", 1000, 1400, "subnet").cast("int").alias("asn"), F.col("age").cast("int").alias("declared_age"), F.col("credit_months").cast("int").alias("credit_file_age_months"), F.col("_shared").cast("int").alias("address_shared_count"),
        "face_tag", "doc_template_tag", F.struct(F.lit(4096).alias("dim"), vector.alias("indices"), F.lit(str(cfg["seed"])).alias("seed_id")).alias("identity_hypervector"),
        F.struct(
            vendor("tmpl", (8.0, 1.6), (6.0, 2.2)).alias("template_match_score"), vendor("exif", (6.0, 1.8), (1.8, 4.0)).alias("exif_consistency"), vendor("live", (9.0, 1.5), (4.5, 2.5)).alias("liveness_score"),
            "spectral_peak_ratio", "residual_kurtosis", "color_corr_anomaly", "saturation_clip_ratio",
        ).alias("signals"),
    )


def traffic(folk: DataFrame, cfg: dict) -> DataFrame:
    """Attempts of everybody: id, k, day, kind and what was tried."""
    d, p, r, days, drift = Draws(cfg["seed"]), cfg["population"], cfg["ring"], cfg["days"], cfg["drift"]
    peak = max(M.HOURLY) * max(M.DAILY)
    rate = p["daily_rate_mean"] * F.exp(p["daily_rate_sigma"] * d.n("rate", "id") - p["daily_rate_sigma"] ** 2 / 2)
    rate = F.when(F.col("cohort") == "small_business", F.lit(cfg["lookalikes"]["small_business_daily_rate"])).otherwise(rate)
    # candidates at the peak rate, thinned by the season
    tries = folk.filter("ring IS NULL").withColumn("_m", F.ceil(rate * peak * days).cast("int")).filter("_m > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("k"))
    legit = tries.withColumn("day", d.u("when", "id", "k") * days).filter((F.col("day") >= F.col("born_day")) & (d.u("thin", "id", "k") < season(F.col("day")) / peak)).withColumn("kind", F.lit("legit"))
    # warm-up purchases of active members, legitimate
    active = folk.filter("ring IS NOT NULL AND NOT dormant").withColumn("begin", F.col("born_day") + F.col("start"))
    warm = active.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).withColumn("day", F.col("born_day") + d.u("warm", "id", "k") * F.col("start")).filter(F.col("day") < days).withColumn("kind", F.lit("warmup"))
    late = F.lit(bool(drift["enabled"])) & (F.col("begin") >= drift["at_fraction"] * days)
    turn = lambda value, mult: F.when(late, value * mult).otherwise(F.lit(float(value)))
    attempts = F.greatest(F.lit(1), F.round(turn(r["burst_intensity"], drift["burst_intensity_mult"]) * r["burst_hours"] * (1 + 0.1 * d.n("burst", "id")))).cast("int")
    # An account's bursts lie a dormancy apart; attempts of one are numbered on from those of the one before
    nth = active.withColumn("_m", attempts).select("*", F.explode(F.sequence(F.lit(0), F.lit(int(r["n_bursts_per_account"]) - 1))).alias("_nth"))
    nth = nth.withColumn("begin", F.col("begin") + F.col("_nth") * float(r["dormancy_days_min"]))
    burst = nth.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.col("_m")), lambda i: i + F.col("_nth") * 100_000)).alias("k"))
    gap = r["burst_hours"] / 24.0 / F.col("_m") * F.greatest(F.lit(0.02), 1 + turn(r["inter_arrival_jitter"], drift["inter_arrival_jitter_mult"]) * d.n("gap", "id", "k"))
    order = Window.partitionBy("id", "_nth").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    burst = burst.withColumn("day", F.col("begin") + F.sum(gap).over(order)).withColumn("kind", F.lit("test")).filter((F.col("day") < days) & (d.u("busy", "id", "k") < F.least(F.lit(1.0), season(F.col("day")) / 1.6)))
    spread = F.greatest(F.lit(1.0), turn(r["merchant_spread"], drift["merchant_spread_mult"]))
    keep = [c for c in folk.columns] + ["k", "day", "kind"]
    rows = legit.select(keep).union(warm.select(keep)).unionByName(burst.withColumn("_spread", spread).select(*keep, "_spread"), allowMissingColumns=True)
    test = F.col("kind") == "test"
    merchant = F.when(test, F.pmod(F.col("ring") * 7 + d.pick("m", 0, F.coalesce(F.col("_spread"), F.lit(1.0)) - 1, "id", "k"), F.lit(p["n_merchants"]))).otherwise(d.pick("m", 0, p["n_merchants"] - 1, "id", d.pick("fav", 0, 5, "id", "k")))
    number = F.row_number().over(Window.partitionBy("ring", "kind").orderBy("day", "id"))
    suffix = F.when(test, F.pmod(F.col("ring") * 99_991 + number * 3, F.lit(1_000_000))).otherwise(d.pick("pan", 0, 999_999, "id", d.pick("card", 0, F.col("cards") - 1, "id", "k"), F.coalesce(F.col("day") >= F.col("reissued"), F.lit(False))))
    zero = test & (d.u("zero", "id", "k") < 0.35)
    amount = F.when(zero, 0.0).when(test, F.greatest(F.lit(0.2), F.least(F.lit(40.0), -1.4 * (F.log(d.u("g1", "id", "k")) + 0.6 * F.log(d.u("g2", "id", "k")))))).otherwise(F.exp(F.when(F.col("cohort") == "small_business", cfg["lookalikes"]["small_business_amount_mu"]).otherwise(p["amount_mu"]) + p["amount_sigma"] * d.n("amount", "id", "k")))
    yes = F.when(test, d.u("ok", "id", "k") < 0.06).otherwise(d.u("ok", "id", "k") >= p["base_decline_rate"])
    v = d.u("code", "id", "k")
    code = F.when(yes, "approved").when(~test, "declined_insufficient_funds").when(v < 0.45, "declined_invalid_card").when(v < 0.73, "declined_cvv").when(v < 0.90, "declined_do_not_honor").otherwise("declined_expired")
    own = F.col("ring").isNull()
    nth_device = d.pick("which device", 0, F.col("devices") - 1, "id", "k")
    device = F.when(own & (F.col("day") >= F.col("changed_device")), F.concat("device", F.lit("_new"))).when(own & (nth_device > 0), F.concat("device", F.lit("_"), nth_device.cast("string"))).otherwise(F.col("device"))
    away = own & (F.col("day") >= F.col("left")) & (F.col("day") < F.col("back"))
    subnet = F.when(away, F.concat("subnet", F.lit("_away"))).when(own & (F.col("day") >= F.col("moved")), F.concat("subnet", F.lit("_moved"))).otherwise(F.col("subnet"))
    return rows.withColumns({
        "device": device, "subnet": subnet, "merchant": merchant, "suffix": F.lpad(suffix.cast("string"), 6, "0"), "zero": zero, "amount": F.bround(amount, 2), "code": code,
        "cvv": F.when(yes | ~test, F.when(yes | (d.u("cvv", "id", "k") < 0.9), "match").otherwise("no_match")).when(d.u("cvv", "id", "k") < 0.7, "no_match").otherwise("not_provided"),
        "avs": F.when(~test, F.when(d.u("avs", "id", "k") < 0.93, "match").otherwise("partial")).when(yes, F.when(d.u("avs", "id", "k") < 0.5, "match").otherwise("partial")).when(d.u("avs", "id", "k") < 0.75, "no_match").otherwise("unavailable"),
    })


def season(day: Column) -> Column:
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.get(lits(M.HOURLY), F.pmod(F.floor((day - F.floor(day)) * 24), F.lit(24)).cast("int")) * F.get(lits(M.DAILY), F.pmod(F.floor(day), F.lit(7)).cast("int"))


def generate(spark: SparkSession, cfg: dict) -> dict[str, DataFrame]:
    """The five streams of a scenario."""
    d, lab, start = Draws(cfg["seed"]), cfg["labels"], F.unix_micros(F.lit(cfg["start_date"]).cast("timestamp"))
    folk = people(spark, cfg)
    at = lambda day: F.timestamp_micros(start + (day * DAY_US).cast("long"))
    inst = F.concat(F.lit(f"{cfg['institution_prefix']}_"), F.col("institution"))
    tries = traffic(folk, cfg).withColumn("_session", F.floor(F.col("day") / 0.05).cast("long"))
    auth = tries.select(
        token("evt", "kind", "id", "k").alias("event_id"), at(F.col("day")).alias("ts"), inst.alias("institution_id"), token("mer", "merchant").alias("merchant_id"), F.concat(F.lit("mcc_"), (F.col("merchant") % 12).cast("string")).alias("merchant_category"),
        token("acc", "id").alias("account_id"), token("idn", "id").alias("identity_id"), token("crd", "suffix").alias("card_token"), F.col("suffix").alias("pan_suffix6"), "amount", F.lit("USD").alias("currency"), F.col("zero").alias("is_zero_auth"),
        F.col("code").alias("response_code"), F.col("avs").alias("avs_result"), F.col("cvv").alias("cvv_result"), token("dev", "device").alias("device_id"), token("ip", "subnet").alias("ip_id"), d.pick("asn", 1000, 1400, "subnet").cast("int").alias("asn"),
        token("ses", "id", "_session").alias("session_id"), (F.col("kind") == "test").alias("_fraud"), F.col("id").alias("_id"), F.col("k").alias("_k"),
    )
    bot = F.col("_fraud")
    opened = auth.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id"))).filter("_n = 1")
    telemetry = opened.select(
        token("evt", F.lit("tel"), "event_id").alias("event_id"), "ts", "institution_id", "session_id", "account_id", "device_id", "ip_id", token("ua", "device_id").alias("user_agent_hash"), F.lit("1920x1080").alias("screen_res"), "asn",
        (d.pick("tz", -8, 3, "_id") * 60).cast("int").alias("tz_offset_min"), (d.u("type", "_id", "_k") * F.when(bot, 0.1).otherwise(0.6)).alias("typing_cadence_cv"), (d.u("mouse", "_id", "_k") * F.when(bot, 0.8).otherwise(4.0)).alias("mouse_entropy"),
        (200 + d.u("dwell", "_id", "_k") * F.when(bot, 800).otherwise(30_000)).alias("page_dwell_ms"), F.when(bot, 0.5 + 0.5 * d.u("auto", "_id", "_k")).otherwise(0.4 * d.u("auto", "_id", "_k")).alias("automation_score"),
    )
    wait = lab["chargeback_delay_min_days"] + d.u("delay", "event_id") * (lab["chargeback_delay_max_days"] - lab["chargeback_delay_min_days"])
    u = d.u("label", "event_id")
    source = F.when(bot & (u < lab["chargeback_coverage"]), "chargeback").when(bot & (u < lab["chargeback_coverage"] + lab["analyst_review_share"]), "analyst").when(~bot & (u < lab["false_chargeback_rate"]), "chargeback")
    told = auth.withColumn("source", source).filter("source IS NOT NULL").withColumn("event_ts", F.col("ts"))
    told = told.withColumn("label_available_at", F.timestamp_micros(F.unix_micros("event_ts") + (F.when(F.col("source") == "analyst", float(lab["analyst_delay_days"])).otherwise(wait) * DAY_US).cast("long")))
    labels = told.select(token("evt", F.lit("lab"), "event_id").alias("event_id"), F.col("label_available_at").alias("ts"), "institution_id", F.lit("auth_event").alias("subject_type"), F.col("event_id").alias("subject_id"), ((F.col("source") == "chargeback") | bot).alias("is_fraud"), "source", "event_ts", "label_available_at")
    acted = auth.filter("_fraud").groupBy("identity_id").agg(F.min("ts").alias("first_fraud_ts"))
    truth = folk.select(token("idn", "id").alias("identity_id"), token("acc", "id").alias("account_id"), F.col("ring").isNotNull().alias("is_synthetic"), F.concat(F.lit("ring_"), F.col("ring")).alias("ring_id"), F.when(F.col("ring").isNotNull(), cfg["ring"]["name"]).alias("ring_preset"), F.col("cohort").isin("small_business", "traveller", "new_device").alias("is_lookalike"), at(F.col("born_day")).alias("onboarded_ts"))
    return {"onboarding_events": onboarding(folk, cfg), "auth_events": auth.drop("_fraud", "_id", "_k"), "session_telemetry": telemetry, "labels": labels, "ground_truth": truth.join(acted, "identity_id", "left")}


def verify(data: dict[str, DataFrame], cfg: dict) -> DataFrame:
    """The ten invariants of generated data, a row each: check, ok."""
    auth, truth, labels = data["auth_events"], data["ground_truth"], data["labels"]
    joined = auth.join(truth.select("account_id", "is_synthetic", "first_fraud_ts"), "account_id")
    fraud = F.col("is_synthetic") & (F.col("ts") >= F.col("first_fraud_ts"))
    a = joined.agg(F.avg(F.coalesce(fraud, F.lit(False)).cast("double")).alias("rate"), F.sum(F.coalesce(fraud, F.lit(False)).cast("long")).alias("n"), F.avg(F.when(F.col("is_synthetic"), (F.col("response_code") != "approved").cast("double"))).alias("syn"), F.avg(F.when(~F.col("is_synthetic"), (F.col("response_code") != "approved").cast("double"))).alias("leg"), F.max((~F.col("pan_suffix6").rlike("^[0-9]{6}$")).cast("int")).alias("bad")).first()
    delay = M.label_delay_days(F.col("label_available_at"), F.col("event_ts"))
    b = labels.agg(F.min(delay).alias("low"), F.min(F.when(F.col("source") == "chargeback", delay)).alias("cl"), F.max(F.when(F.col("source") == "chargeback", delay)).alias("ch"), F.sum(F.col("is_fraud").cast("long")).alias("n")).first()
    rings = truth.filter("ring_id IS NOT NULL").groupBy("ring_id").agg(F.sum(F.col("first_fraud_ts").isNull().cast("long")).alias("dormant")).agg(F.min("dormant")).first()[0]
    t = truth.agg(F.sum((F.col("is_synthetic") & F.col("first_fraud_ts").isNull()).cast("long")), F.sum(F.col("is_lookalike").cast("long"))).first()
    h = auth.groupBy(F.hour("ts").alias("h")).count().agg(F.max("count"), F.min("count")).first()
    checks = [
        ("fraud rate on target", cfg["target_fraud_rate_min"] <= a["rate"] <= cfg["target_fraud_rate_max"]), ("chargebacks 20 to 60 days late", b["cl"] is not None and b["cl"] >= 20 and b["ch"] <= 60.5), ("fewer labels than fraud", b["n"] < a["n"]),
        ("no label before its event", b["low"] >= 0), ("every ring has dormant members", rings > 0), ("some never acted", t[0] > 0), ("look-alikes exist", t[1] > 0), ("suffixes well formed", a["bad"] == 0),
        ("synthetic declines above legitimate", a["syn"] > a["leg"]), ("peak hour above 2.5 troughs", h[0] > 2.5 * max(1, h[1])),
    ]
    return auth.sparkSession.createDataFrame([(c, bool(ok)) for c, ok in checks], "check string, ok boolean")


#: Knobs that take whole numbers only.
WHOLE = {"merchant_spread", "dormancy_days_min"}


def moves(spark: SparkSession, rounds: int, seed: int) -> DataFrame:
    """A table of draws: round, knob, step. Each round moves the two to four knobs that come first in a random order
    of its own, by a normal step whose deviation is a quarter of the knob's range."""
    d = Draws(seed)
    knobs = spark.createDataFrame([(k, float(high - low)) for k, (low, high) in M.KNOBS.items()], "knob string, span double")
    drawn = spark.range(rounds).select(F.col("id").alias("round")).join(F.broadcast(knobs))
    place = F.row_number().over(Window.partitionBy("round").orderBy(d.u("order", "round", "knob"), "knob"))
    return drawn.withColumn("_p", place).filter(F.col("_p") <= d.pick("how many", 2, 4, "round")).select("round", "knob", (d.n("step", "round", "knob") * F.col("span") / 4).alias("step"))


def moved(params: dict[str, float], steps: dict[str, float]) -> dict[str, float]:
    """Parameters after a round's steps, kept within their ranges."""
    bounded = {k: sorted((*M.KNOBS[k], params[k] + step))[1] for k, step in steps.items()}
    return params | {k: float(round(v)) if k in WHOLE else v for k, v in bounded.items()}


def cost_of(params: dict[str, float]) -> float:
    """The operator's cost, 0 to 1: how near each knob is to its dear end, weighted."""
    ends = {k: M.KNOBS[k] if way > 0 else M.KNOBS[k][::-1] for k, way in M.KNOB_COST.items()}
    near = {k: abs(params[k] - cheap) / abs(dear - cheap) for k, (cheap, dear) in ends.items()}
    return sum(abs(M.KNOB_COST[k]) * v for k, v in near.items()) / sum(map(abs, M.KNOB_COST.values()))


def red_team(spark: SparkSession, start: dict[str, float], detection, rounds: int = 8, seed: int = 11) -> list[dict]:
    """Hill climb of the operator: least detection + 0.35 cost. ``detection`` (params -> rate) runs one job a round."""

    def tried(params: dict[str, float]) -> dict:
        rate, dear = detection(params), cost_of(params)
        return {"params": params, "detection": rate, "cost": dear, "objective": rate + 0.35 * dear}

    steps: dict[int, dict[str, float]] = {}
    for r in moves(spark, rounds, seed).collect():  # four rows a round at most
        steps.setdefault(r["round"], {})[r["knob"]] = r["step"]
    found = [tried(start)]
    for i in range(rounds):
        best = min(found, key=lambda x: x["objective"])
        found.append(tried(moved(best["params"], steps[i])))
    return found
