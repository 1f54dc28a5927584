"""Queries and SQL for sources, streaming, simulation, models and narratives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from .. import simulate as Z
from ..functions import images as I
from ..functions.scalars import SPANS
from ..operators import narrative as N
from ..operators.storage import shared_folder
from ..sources import config, streams
from ..streaming import features as T

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def auth_stream(spark, d):
    """The events in the schema of auth_events."""
    a = A.auth_events(spark, d)
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return a.select(
        s("evt_", "seq").alias("event_id"), "ts", s("inst_", "institution").alias("institution_id"), F.col("merchant").alias("merchant_id"), F.lit("mcc").alias("merchant_category"), s("acc_", "account").alias("account_id"), s("idn_", "account").alias("identity_id"),
        s("crd_", "card").alias("card_token"), F.col("suffix").alias("pan_suffix6"), "amount", F.lit("USD").alias("currency"), F.col("zero_auth").alias("is_zero_auth"), "response_code", "avs_result", "cvv_result", s("dev_", "device").alias("device_id"), s("ip_", "ip").alias("ip_id"), F.lit(1).alias("asn"), s("ses_", "seq").alias("session_id"),
    )


_AUTH = f"{A.AUTH_SQL}, e AS (SELECT 'inst_' || institution AS institution_id, 'acc_' || account AS account_id, * FROM auth)"


@query("S1_S5_jsonl_round_trip", f"WITH {_AUTH} SELECT institution_id, response_code, count(*)::BIGINT AS n, round(sum(amount), 4) AS amount, epoch_us(max(ts))::BIGINT AS last_us FROM e GROUP BY ALL")
def s1(spark, d):
    streams.write_stream(auth_stream(spark, d), root := folder(spark, "jsonl"), "auth_events")
    back = streams.read_stream(spark, root, "auth_events")
    return back.groupBy("institution_id", "response_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("S2_S3_scoped_view", f"WITH {_AUTH} SELECT institution_id, count(*)::BIGINT AS n, count(DISTINCT account_id)::BIGINT AS accounts FROM e WHERE institution_id = 'inst_2' GROUP BY 1")
def s2(spark, d):
    streams.write_stream(auth_stream(spark, d), root := folder(spark, "jsonl"), "auth_events")
    known = streams.institutions_in(spark, root)
    rows = streams.read_stream(spark, root, "auth_events").filter("institution_id = 'inst_2'").join(F.broadcast(known), "institution_id", "left_semi")  # a row an institution
    return rows.groupBy("institution_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("account_id").alias("accounts"))


@query("S4_summary_counts", "SELECT 'auth_events' AS stream, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'ground_truth', count(*) FROM customer")
def s4(spark, d):
    return streams.Dataset("network", None, {"auth_events": A.table(spark, d, "events"), "ground_truth": A.table(spark, d, "customer")}).summary()


def _staged(spark, d, parts: int = 4):
    """The events in time-ordered files, so that a replay has several batches."""
    auth = A.auth_events(spark, d).select("account", "seq", "us", "ts", (F.col("response_code") != "approved").cast("double").alias("declined"), "card", "merchant", "amount")
    low, high = auth.agg(F.min("us"), F.max("us")).first()
    root, step = folder(spark, "replay"), ((high or 0) - (low or 0)) // parts + 1
    for i in range(parts):
        auth.filter(F.col("us").between((low or 0) + i * step, (low or 0) + (i + 1) * step - 1)).coalesce(1).write.mode("append").parquet(root)
    return streams.replay(spark, root, auth.schema)


def _w(seconds: int) -> str:
    return f"(PARTITION BY account ORDER BY us RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND 1 PRECEDING)"


_ONLINE = ", ".join(
    f"count(*) OVER {_w(s)}::BIGINT AS acct_n_{n}, round(coalesce(avg((response_code <> 'approved')::INTEGER::DOUBLE) OVER {_w(s)}, 0), 6) AS acct_decline_ratio_{n}, count(DISTINCT card) OVER {_w(s)}::BIGINT AS acct_distinct_pans_{n}, count(DISTINCT merchant) OVER {_w(s)}::BIGINT AS acct_distinct_merchants_{n}, round(coalesce(avg(amount) OVER {_w(s)}, 0), 6) AS acct_mean_amount_{n}"
    for n, s in SPANS.items()
)


@query("T1_T2_T9_T10_online_features", f"WITH {A.AUTH_SQL} SELECT seq, {_ONLINE} FROM auth")
def t1(spark, d):
    out = folder(spark, "online")
    T.run_to_end(T.online_features(_staged(spark, d)), out, f"{out}-checkpoint")
    found = spark.read.parquet(out)
    return found.select("seq", *[F.round(c, 6).alias(c) if t == "double" else c for c, t in found.dtypes if c.startswith("acct_")])


@query("T3_late_labels", "SELECT count(*)::BIGINT AS usable, count(*) FILTER (l_returnflag = 'R')::BIGINT AS fraud FROM lineitem WHERE l_shipdate + INTERVAL 30 DAY <= TIMESTAMP '1998-01-01'")
def t3(spark, d):
    from ..operators.metrics import point_in_time

    rows = A.table(spark, d, "lineitem").withColumn("label_available_at", F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS"))
    return point_in_time(rows, F.lit("1998-01-01").cast("timestamp_ntz")).agg(F.count(F.lit(1)).alias("usable"), F.count_if(F.col("l_returnflag") == "R").alias("fraud"))


@query("T5_tumbling_windows", f"WITH {A.AUTH_SQL} SELECT epoch_us(date_trunc('hour', ts))::BIGINT AS start_us, count(*)::BIGINT AS n, sum((response_code <> 'approved')::INTEGER)::BIGINT AS declined FROM auth GROUP BY 1")
def t5(spark, d):
    """Complete mode: nothing is withheld behind the watermark."""
    name = f"tumbling_{uuid.uuid4().hex}"
    q = T.tumbling(_staged(spark, d), "ts").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.unix_micros("window.start").alias("start_us"), "n", F.col("declined").cast("bigint").alias("declined"))


@query(
    "T6_T7_anchored_sessions",
    f"""WITH RECURSIVE {A.AUTH_SQL}, s AS (SELECT account, min(us) AS start, 1 AS session FROM auth GROUP BY account UNION ALL SELECT s.account, (SELECT min(a.us) FROM auth a WHERE a.account = s.account AND a.us - s.start > 4320000000), session + 1 FROM s WHERE s.start IS NOT NULL),
r AS (SELECT account, start, session, lead(start) OVER (PARTITION BY account ORDER BY session) AS nxt FROM s WHERE start IS NOT NULL)
SELECT r.account, session::BIGINT AS session, min(a.seq)::BIGINT AS seq, count(*)::BIGINT AS events FROM r JOIN auth a ON a.account = r.account AND a.us >= r.start AND (r.nxt IS NULL OR a.us < r.nxt) GROUP BY r.account, session""",
)
def t6(spark, d):
    return T.first_of_session(T.sessions(A.auth_events(spark, d)))


@query("D1_D11_simulated_counts")
def d1(spark, d):
    data = Z.generate(spark, config.load_scenario("tiny"))
    return streams.Dataset("network", None, data).summary()


@query("E11_simulator_checks")
def e11(spark, d):
    cfg = config.load_scenario("tiny")
    from ..operators.storage import written

    return Z.verify({k: written(v, f"sim-{k}") for k, v in Z.generate(spark, cfg).items()}, cfg)


@query("E_offline_report_D12_red_team")
def offline(spark, d):
    """On the smallest scenario, with short waits so that fraud falls on both sides of the split: a model trained on its first 70 %, the report on the rest, and one round of an operator who
    adapts to the frozen model, each on traffic generated anew."""
    from . import report as R

    cfg = config.merged(config.load_scenario("tiny"), {"ring": {"dormancy_days_min": 2, "dormancy_days_max": 6, "dormant_share": 0.3}})
    found, model = R.offline_report(*R.world(spark, cfg), fpr=0.01, least=100)
    climb = R.red_team(spark, cfg, model, rounds=1)
    rows = R.flat(found | {"red_team": [{k: float(x[k]) for k in ("detection", "cost", "objective")} for x in climb]})
    return spark.createDataFrame(rows, "section string, figure string, value double")


_KNOWN = {"tiny": (7, 30, 2, 8, 12, 45.0, 0.45), "sloppy": (20260830, 90, 4, 25, 55, 45.0, 0.6), "moderate": (20260830, 90, 5, 20, 45, 30.0, 0.65), "sophisticated": (20260830, 120, 6, 18, 40, 9.0, 0.62), "drift": (20260830, 120, 5, 20, 45, 38.0, 0.65)}
_KNOWN_SQL = ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]}, {v[4]}, {v[5]}::DOUBLE, {v[6]}::DOUBLE)" for k, v in _KNOWN.items())


@query("S7_scenarios", f"SELECT name, seed::BIGINT AS seed, days::BIGINT AS days, n_rings::BIGINT AS n_rings, least::BIGINT AS ring_size_min, most::BIGINT AS ring_size_max, burst AS burst_intensity, dormant AS dormant_share FROM (VALUES {_KNOWN_SQL}) t(name, seed, days, n_rings, least, most, burst, dormant)")
def s7(spark, d):
    """Every scenario, deep-merged over the defaults."""
    found = [config.load_scenario(name) for name in config.SCENARIOS]
    rows = [(c["name"], c["seed"], c["days"], *[c["ring"][k] for k in ("n_rings", "ring_size_min", "ring_size_max", "burst_intensity", "dormant_share")]) for c in found]
    return spark.createDataFrame(rows, "name string, seed bigint, days bigint, n_rings bigint, ring_size_min bigint, ring_size_max bigint, burst_intensity double, dormant_share double")


@query("S8_rules", "SELECT 'above' AS way, 9::BIGINT AS rules UNION ALL SELECT 'below', 3")
def s8(spark, d):
    rules = config.load_rules()["triggers"]
    return spark.createDataFrame([(c, v[1]) for c, v in rules.items()], "code string, way string").groupBy("way").agg(F.count(F.lit(1)).alias("rules"))


@query("S3_institutions", f"WITH {_AUTH} SELECT institution_id, row_number() OVER (ORDER BY institution_id)::BIGINT AS place FROM (SELECT DISTINCT institution_id FROM e)")
def s3(spark, d):
    streams.write_stream(auth_stream(spark, d), root := folder(spark, "jsonl"), "auth_events")
    names = [r["institution_id"] for r in streams.institutions_in(spark, root).collect()]  # a row an institution
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "institution_id string, place bigint")


@query("F12_case_narratives")
def f12(spark, d):
    from ..operators import graph as G
    from .graph_queries import found

    members, table = found(spark, d)
    shared = N.shared_phrases(G.shared_attributes(members, A.attribute_edges(spark, d)))
    empty = F.array().cast("array<string>")
    cases = table.join(shared, "community", "left").select(
        "community", "size", "cohesion", "suspicion", F.transform("institutions", lambda x: F.concat(F.lit("inst_"), x.cast("string"))).alias("institutions"), F.coalesce("shared", empty).alias("shared"), empty.alias("signals"), F.lit(None).cast("string").alias("seed"),
        F.lit(0).alias("flagged"), F.lit(0).alias("dormant"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), F.lit(0.0).alias("path_score"), F.array(F.lit("ring_membership")).alias("reasons"),
    )
    return N.narrate(cases)


@query("L1_L2_L3_behaviour_model")
def l3(spark, d):
    """All 54 features; fit on the first 70 % of the time, the threshold from what comes after."""
    from ..operators.models import FEATURES, behaviour_dataset, train
    from ..operators.storage import written

    auth = A.auth_events(spark, d)
    truth = auth.groupBy("account").agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("first_fraud")).withColumn("is_synthetic", F.col("account") % 4 == 1)
    rows = written(behaviour_dataset(auth, truth).select("seq", "y", "ts", *[F.col(n).cast("double").alias(n) for n in FEATURES]), "train")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    model = train(rows, split_ts=low + 0.7 * (high - low))
    scored = model.predict(rows)
    return scored.select("seq", "y", F.round("score", 6).alias("score"), (F.col("score") >= model.threshold_at_target_fpr).alias("flagged"))


@query("S11_image_corpus")
def s11(spark, d):
    """A portrait a vector is written as a file by the executors; the folder is read back as a corpus and measured."""
    root = folder(spark, "images")

    def write(batches):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            paths = []
            for vec_id, vector, label in zip(pdf["vec_id"], pdf["embedding"], pdf["label"], strict=True):
                store, path = fs.FileSystem.from_uri(f"{root}/{vec_id % 16}/{vec_id}.ppm")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(I.ppm(I.face(np.asarray(vector, float), np.random.default_rng(int(vec_id)), synthetic=label % 2 == 1)))
                paths.append(path)
            yield pd.DataFrame({"path": paths})

    A.table(spark, d, "embeddings").mapInPandas(write, "path string").count()
    found = I.image_features(I.image_corpus(spark, root))
    number = F.regexp_extract("path", r"([0-9]+)\.ppm$", 1).cast("bigint").alias("vec_id")
    return found.select(number, *[F.round(c, 6).alias(c) for c in ("spectral_peak_ratio", "residual_kurtosis", "color_corr_anomaly", "saturation_clip_ratio")])


@query("H13_H14_H15_H16_image_statistics")
def h13(spark, d):
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                vector, rng = np.asarray(r.embedding, float), np.random.default_rng(int(r.vec_id))
                picture = I.face(vector, rng, synthetic=r.label % 2 == 1)
                page = I.layout(int(r.label), rng)
                out.append({"vec_id": r.vec_id, "descriptor_norm": float(np.linalg.norm(I.descriptor(picture))), "ink": float(I.ink_grid(page).mean()), **I.artifacts(picture)})
            yield pd.DataFrame(out)

    schema = "vec_id bigint, descriptor_norm double, ink double, spectral_peak_ratio double, residual_kurtosis double, color_corr_anomaly double, saturation_clip_ratio double"
    return A.table(spark, d, "embeddings").mapInPandas(run, schema)
