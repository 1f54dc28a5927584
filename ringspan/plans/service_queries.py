"""Queries and SQL for the service's answers, guards, manifests and replay."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from .. import schema
from ..functions import sketches as H
from ..operators.storage import shared_folder
from ..sources import streams
from . import evaluation_queries as V
from . import graph_queries as G
from . import service
from .stream_queries import auth_stream

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BAND = "CASE WHEN s >= 0.9 * k THEN 'confirmed' WHEN s >= 0.75 * k THEN 'high' WHEN s >= 0.55 * k THEN 'elevated' WHEN s >= 0.3 * k THEN 'medium' ELSE 'low' END"


@query(
    "F3_J3_score_auth",
    f"""WITH {A.SCORED_SQL}, o AS (SELECT doc_id, scoped AS onb FROM scored WHERE doc_id % 3 <> 0), p AS (SELECT doc_id, scoped AS prop FROM scored WHERE doc_id % 5 = 0),
j AS (SELECT s.doc_id, score, coalesce(onb, 0) AS onb, prop, CASE WHEN s.doc_id % 7 = 0 THEN 'r' END AS ring FROM scored s LEFT JOIN o ON o.doc_id = s.doc_id LEFT JOIN p ON p.doc_id = s.doc_id),
f AS (SELECT *, least(1.0, greatest(score, 0.7 * coalesce(prop, 0)) * (1 + 0.35 * onb)) AS s, 1 - 0.25 * onb AS k, prop IS NOT NULL AND 0.7 * prop > score AS lifted FROM j), b AS (SELECT *, {_BAND} AS band FROM f)
SELECT doc_id AS identity, round(s, 6) AS score, band, array_to_string(list_concat(CASE WHEN lifted THEN ['ring_sibling_confirmed_fraud'] ELSE [] END, CASE WHEN ring IS NOT NULL THEN ['ring_membership'] WHEN NOT lifted AND band <> 'low' THEN ['velocity_spike'] ELSE [] END), ',') AS reason_codes FROM b""",
)
def score_auth(spark, d):
    s = A.scored(spark, d).withColumnRenamed("doc_id", "identity")
    onboarding = s.filter("identity % 3 <> 0").select("identity", F.col("scoped").alias("onboarding"))
    propagated = s.filter("identity % 5 = 0").select("identity", F.col("scoped").alias("score"))
    rings = s.filter("identity % 7 = 0").select("identity", F.lit("r").alias("ring"))
    out = service.score_auth(s.select("identity", "score"), onboarding, rings, propagated)
    return out.select("identity", F.round("score", 6).alias("score"), "band", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("F5_score_onboarding", f"WITH {A.SCORED_SQL}, b AS (SELECT doc_id, score AS s, 1.0 AS k FROM scored) SELECT doc_id, {_BAND} AS band, CASE {_BAND} WHEN 'low' THEN 'allow' WHEN 'medium' THEN 'step_up' WHEN 'elevated' THEN 'throttle' WHEN 'high' THEN 'honeypot' ELSE 'block' END AS action FROM b")
def score_onboarding(spark, d):
    return service.score_onboarding(A.scored(spark, d)).select("doc_id", "band", "action")


@query("F9_honeypot", "SELECT c_custkey AS card, CASE WHEN h % 20 = 0 THEN 'approved' ELSE 'declined_do_not_honor' END AS response_code, CASE WHEN h % 3 <> 0 THEN 'match' ELSE 'no_match' END AS avs_result, CASE WHEN h % 20 = 0 THEN 'match' ELSE 'no_match' END AS cvv_result, TRUE AS honeypot FROM (SELECT c_custkey, ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT AS h FROM customer)")
def honeypot(spark, d):
    return service.honeypot(A.table(spark, d, "customer").select(F.col("c_custkey").alias("card")))


@query("A13_service_metrics", "SELECT count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events")
def metrics(spark, d):
    out = service.metrics(A.table(spark, d, "events").select(F.col("value").alias("ms")))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "max")


_SEED = "SELECT arg_min(identity, (liveness, identity)) AS identity FROM ident WHERE is_synthetic GROUP BY ring"


@query(
    "G7_confirm_fraud",
    f"""WITH {G._PROPAGATED.replace(_SEED, "SELECT 7 AS identity")} SELECT split_part(node, ':', 2) AS identity, round(score, 6) AS score, hops::BIGINT AS hops, source, split_part(node, ':', 2) NOT IN (SELECT account::VARCHAR FROM auth) AS dormant
FROM p{G._ROUNDS} WHERE hops > 0 AND node LIKE 'identity:%' ORDER BY round(score, 9) DESC, identity LIMIT 200""",
)
def confirm(spark, d):
    edges = G.graph(spark, d)
    transacted = A.auth_events(spark, d).select(F.col("account").cast("string").alias("identity"))
    return service.confirm(edges, "7", transacted)[0].select("identity", F.round("score", 6).alias("score"), F.col("hops").cast("long").alias("hops"), "source", "dormant")


@query("T8_remembered_decisions", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS r, count(*) OVER () AS n FROM events) WHERE r <= CASE WHEN n <= 200 THEN n ELSE 101 + (n - 201) % 100 END")
def t8(spark, d):
    return service.remembered(A.table(spark, d, "events").select("event_id"), "event_id", 200)


@query("K2_list_communities")
def communities(spark, d):
    return service.communities(G.found(spark, d)[1]).select("community", "size", "score")


@query("F11_explain", f"WITH {V._DECIDE} SELECT seq AS event_id, band, action, array_to_string(codes, ',') AS reason_codes FROM d4 WHERE seq = 46")
def explain(spark, d):
    out = service.explain(V.decided(spark, d).withColumnRenamed("seq", "event_id"), 46)
    return out.select("event_id", "band", "action", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("A10_institution_devices", f"WITH {A.AUTH_SQL} SELECT device, count(*)::BIGINT AS attempts, count(DISTINCT account)::BIGINT AS accounts FROM auth GROUP BY device")
def devices(spark, d):
    return service.devices(A.auth_events(spark, d))


@query("S4_health", "SELECT 'events' AS stream, count(*)::BIGINT AS n FROM events UNION ALL SELECT 'customer', count(*) FROM customer")
def health(spark, d):
    return service.health({n: A.table(spark, d, n) for n in ("events", "customer")})


@query("S12_P14_guards", "SELECT count(*)::BIGINT AS n, sum((event_id % 50 = 0)::INTEGER + (event_id % 70 = 0)::INTEGER)::BIGINT AS broken FROM events")
def guards(spark, d):
    """Rows that break the schema are counted: some responses and some suffixes are spoilt first."""
    rows = schema.refuse_raw_personal(schema.refuse_evaluation_columns(auth_stream(spark, d)))
    k = F.substring_index("event_id", "_", -1).cast("long")
    spoilt = rows.withColumns({"response_code": F.when(k % 50 == 0, "bogus").otherwise(F.col("response_code")), "pan_suffix6": F.when(k % 70 == 0, "12x").otherwise(F.col("pan_suffix6"))})
    return spoilt.agg(F.count(F.lit(1)).alias("n"), F.sum(schema.violations(spoilt, "auth_events")).cast("bigint").alias("broken"))


@query(
    "S6_S10_manifest",
    f"WITH {A.AUTH_SQL}, t AS (SELECT user_id, min(ts) + INTERVAL 3 DAY AS f FROM events WHERE user_id % 4 = 1 GROUP BY 1) SELECT (SELECT count(*) FROM events)::BIGINT AS events, count(*)::BIGINT AS fraud, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS fraud_rate FROM events e JOIN t ON t.user_id = e.user_id WHERE ts >= f",
)
def manifest(spark, d):
    auth = auth_stream(spark, d)
    truth = auth.groupBy("account_id").agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("first_fraud_ts")).withColumns({"is_synthetic": F.substring_index("account_id", "_", -1).cast("int") % 4 == 1, "ring_id": F.lit(None).cast("string")})
    found = streams.manifest(streams.Dataset("network", None, {"auth_events": auth, "ground_truth": truth}), {})
    streams.write_report(spark, found, f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}")
    return spark.createDataFrame([(found["counts"]["auth_events"], found["n_fraud_events"], round(found["fraud_rate"], 6))], "events bigint, fraud bigint, fraud_rate double")


@query("S9_replay", "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def replay(spark, d):
    from ..streaming.features import run_to_end

    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    events = A.table(spark, d, "events").select("event_id", "event_type", "value")
    events.repartition(3).write.parquet(f"{root}/in")
    run_to_end(streams.replay(spark, f"{root}/in", events.schema), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("S9_first_events_paced", "SELECT 'evt_' || event_id AS event_id, (row_number() OVER (ORDER BY event_id) - 1) * 5.0::DOUBLE AS due_ms FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 400)")
def paced(spark, d):
    """The limit is the feature: the first rows of the stored stream in file order, at 200 a second."""
    root = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    k = F.substring_index("event_id", "_", -1).cast("long")
    streams.write_stream(auth_stream(spark, d).withColumn("_k", k).repartitionByRange(4, "_k").sortWithinPartitions("_k").drop("_k"), root, "auth_events")
    first = streams.read_stream(spark, root, "auth_events", 400).withColumn("_k", k)
    return streams.paced(first, ("_k",)).select("event_id", "due_ms")


_DRAWN = "SELECT label, i FROM (SELECT label, i, row_number() OVER (PARTITION BY label ORDER BY k) AS r FROM (SELECT label, i, min(k) AS k FROM (SELECT label, k, ('0x' || substr(sha256('seed|' || label || '|' || k), 1, 8))::BIGINT % 64 AS i FROM (SELECT DISTINCT label FROM tags), (SELECT unnest(range(0, 65)) AS k)) GROUP BY ALL)) WHERE r <= 16"
_FACE, _DEVICE = H.role("face", 64), H.role("device", 64)


@query(
    "H6_H7_hypervectors",
    f"""WITH {A.TAGS_SQL}, dv AS MATERIALIZED ({_DRAWN}), dt AS (SELECT label, array_to_string(list_sort(list(i)), ',') AS device_tag FROM dv GROUP BY label),
v AS (SELECT identity, i, count(*) AS v FROM (SELECT identity, ({_FACE[0]} * x + {_FACE[1]}) % 64 AS i FROM (SELECT identity, unnest(indices) AS x FROM tags) UNION ALL SELECT identity, ({_DEVICE[0]} * dv.i + {_DEVICE[1]}) % 64 FROM tags JOIN dv ON dv.label = tags.label) GROUP BY ALL),
h AS (SELECT identity, array_to_string(list_sort(list(i)), ',') AS hypervector FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY v DESC, sha256(i::VARCHAR)) AS r FROM v) WHERE r <= 16 GROUP BY identity)
SELECT t.identity, device_tag, hypervector FROM tags t JOIN dt ON dt.label = t.label JOIN h ON h.identity = t.identity""",
)
def hypervectors(spark, d):
    t = A.tags(spark, d)
    device = H.categorical_tag(F.col("label"), 64, 16, "seed")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return t.select("identity", joined(device).alias("device_tag"), joined(H.identity_hypervector({"face": F.col("indices"), "device": device}, 64, 16)).alias("hypervector"))


@query("W13_merchant_windows", f"WITH {A.AUTH_SQL} SELECT seq, count(*) OVER (PARTITION BY merchant ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)::BIGINT AS merchant_n_1h, count(*) OVER (PARTITION BY card ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)::BIGINT AS card_n_1h FROM auth")
def merchant_windows(spark, d):
    """Few merchants hold all events, so their histories are split by hours."""
    from ..operators import windows as W

    auth = A.auth_events(spark, d).select("seq", "us", "merchant", "card")
    n = lambda k: F.count(F.lit(1)).over(W.trailing([k, "_slice"], 3600))
    return W.sliced(auth, 3600).withColumns({"merchant_n_1h": n("merchant"), "card_n_1h": n("card")}).filter("NOT _context").select("seq", "merchant_n_1h", "card_n_1h")
