"""The offline report (section 3.3 of the survey): from events to figures, over a model trained before the split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from .. import simulate as Z
from ..operators import graph as G
from ..operators import metrics as E
from ..operators import pairs as P
from ..operators.models import FEATURES, TrainedModel, behaviour_dataset, train
from ..operators.storage import discard, written
from ..sources import config


def features(auth: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """Windows over all rows, the features as doubles, once written."""
    rows = behaviour_dataset(auth, truth, keys)
    return written(rows.select("seq", "ts", "account", "merchant", "y", *[F.col(n).cast("double").alias(n) for n in FEATURES]), "features")


def scored_views(auth: DataFrame, truth: DataFrame, model: TrainedModel, split) -> DataFrame:
    """The holdout with ``score``, from the network's windows, and ``scoped``, by the same model from windows rebuilt from
    what each merchant sees."""
    network, own = (model.predict(E.out_of_time(features(auth, truth, keys), F.lit(split))) for keys in (("account",), ("account", "merchant")))
    return network.select("seq", "ts", "account", "merchant", "y", "score").join(own.select("seq", F.col("score").alias("scoped")), "seq")


def report(scored: DataFrame, fpr: float = E.TARGET_FPR, order: str = "seq") -> dict:
    """scored: y, score, account and optionally lookalike, thin. A dict of a few numbers."""
    threshold = E.threshold_at_fpr(scored, fpr)
    out = {"metrics": E.evaluate(scored, fpr).first().asDict(), "attempts": E.attempts_to_detection(scored, threshold, order=order).first().asDict()}
    for cohort in ("lookalike", "thin"):
        if cohort in scored.columns:
            out[cohort] = [r.asDict() for r in E.false_decline(scored, threshold, F.col(cohort)).collect()]
    return out


def reached(auth: DataFrame, truth: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, identities flagged) when of each ring the member with the earliest fraud is confirmed and the evidence is
    propagated over the graph. people: tokens, handle and ring of each identity."""
    acted = people.filter("ring IS NOT NULL").join(truth.filter("first_fraud IS NOT NULL").select("account", "first_fraud"), "account")
    seeds = acted.groupBy("ring").agg(F.min_by("identity", F.struct("first_fraud", "identity")).alias("identity"))
    edges = written(G.build(people, auth, links=P.merged(P.resolve(P.shared_tokens(people), P.recombined(people)))), "report-graph")
    start = seeds.select(F.concat(F.lit("identity:"), "identity").alias("node"), F.lit(1.0).alias("score"))
    found = G.propagate(edges, start).filter(F.col("node").startswith("identity:"))
    return seeds, found.select(F.substring("node", len("identity:") + 1, 1 << 20).alias("identity"))


def offline_report(auth: DataFrame, truth: DataFrame, people: DataFrame, share: float = 0.7, fpr: float = 0.01, least: int = 500) -> tuple[dict, TrainedModel]:
    """Trains up to ``share`` of the time and judges what comes after. auth: as :func:`adapters.from_stream`; truth: account,
    is_synthetic, first_fraud; people: account, identity, ring, lookalike, thin and tokens. Sections: metrics, attempts,
    lookalike, thin, view_delta, ring_recall and propagation (from one confirmed member a ring)."""
    low, high = auth.agg(F.min("ts"), F.max("ts")).first()
    split = low + share * (high - low)
    known = features(auth, truth)
    model = train(known, split_ts=split, fpr=fpr)
    views = written(scored_views(auth, truth, model, split), "views")
    scored = views.join(people.select("account", "lookalike", "thin"), "account")
    out = report(scored, fpr, "ts")
    out["view_delta"] = E.view_delta(views, "merchant", fpr, least).first().asDict()
    members = people.join(truth.select("account", "is_synthetic", "first_fraud"), "account").select("identity", "ring", "is_synthetic", "first_fraud")
    seeds, flagged = reached(auth, truth, people)
    out["ring_recall"] = [r.asDict() for r in E.ring_recall(members, flagged).collect()]  # a row a ring
    out["propagation"] = E.propagation_precision(members, flagged, seeds).first().asDict()
    out["target_fpr"], out["n_holdout"] = fpr, views.count()
    discard(known)
    return out, model


def flat(found: dict) -> list[tuple[str, str, float]]:
    """(section, figure, value) of every number."""
    rows = []
    for section, part in found.items():
        for i, one in enumerate(part if isinstance(part, list) else [part]):
            for name, value in (one if isinstance(one, dict) else {"value": one}).items():
                if isinstance(value, (int, float)) and not isinstance(value, bool):
                    rows.append((section, f"{name}[{i}]" if isinstance(part, list) else name, float(value)))
    return rows


def world(spark: SparkSession, cfg: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(auth, truth, people) of a generated scenario, written once."""
    data = Z.generate(spark, cfg)
    auth = written(A.from_stream(data["auth_events"]), "world-auth")
    told = written(data["ground_truth"].select(F.col("account_id").alias("account"), F.col("identity_id").alias("identity"), "is_synthetic", F.col("ring_id").alias("ring"), F.col("first_fraud_ts").alias("first_fraud"), F.col("is_lookalike").alias("lookalike")), "world-truth")
    onb, token = data["onboarding_events"], lambda *names: [F.col(f"{n}_token").alias(n) for n in names]
    held = onb.select(F.col("account_id").alias("account"), (F.col("credit_file_age_months") < 12).alias("thin"), F.col("institution_id").alias("institution"), F.col("device_id").alias("device"), F.col("ip_id").alias("ip"), *token("name", "dob", "address", "email", "phone"))
    return auth, told.select("account", "is_synthetic", "first_fraud"), written(told.join(held, "account").drop("is_synthetic", "first_fraud"), "world-people")


def red_team(spark: SparkSession, cfg: dict, model: TrainedModel, rounds: int = 8, seed: int = 11) -> list[dict]:
    """Each round generates the scenario anew with the operator's knobs and lets the frozen model score its fraud."""

    def detection(params: dict[str, float]) -> float:
        ring = {k: int(v) if isinstance(cfg["ring"][k], int) else v for k, v in params.items() if k in cfg["ring"]}
        ring["dormancy_days_max"] = max(cfg["ring"]["dormancy_days_max"], ring.get("dormancy_days_min", 0))
        auth, truth, _ = world(spark, config.merged(cfg, {"ring": ring}))
        rows = features(auth, truth).filter("y = 1")
        hit = model.predict(rows).agg(F.avg((F.col("score") >= model.threshold_at_target_fpr).cast("double"))).first()[0]
        discard(auth, truth)
        return float(hit or 0.0)

    start = {k: float(min(high, max(low, cfg["ring"].get(k, low)))) for k, (low, high) in Z.M.KNOBS.items()}
    return Z.red_team(spark, start, detection, rounds, seed)
