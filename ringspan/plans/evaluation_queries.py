"""Queries and SQL for evidence, evaluation, fusion, decisions and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import scalars as M
from ..functions import sketches as H
from ..operators import decision as D
from ..operators import evidence as V
from ..operators import metrics as E

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, *keep, digits=6):
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keep])


def auth(spark, d):
    return A.auth_events(spark, d).withColumnRenamed("account", "identity")


_ROLL = f"""{A.AUTH_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, seq) AS rn FROM auth), ch AS (SELECT account, unnest(string_split(string_agg(suffix, ''), '')) AS g FROM q WHERE rn <= 400 GROUP BY account),
k AS (SELECT account, g, count(*) AS n FROM ch WHERE g <> '' GROUP BY ALL), en AS (SELECT account, sum(-(n::DOUBLE / s) * log2(n::DOUBLE / s)) / log2(10) AS h, sum(n) AS t FROM (SELECT *, sum(n) OVER (PARTITION BY account) AS s FROM k) GROUP BY account),
roll AS (SELECT a.account AS identity, count(*) AS attempts, sum((response_code <> 'approved')::INTEGER) AS declines, sum((cvv_result <> 'match')::INTEGER) AS cvv_mismatch, sum((avs_result <> 'match')::INTEGER) AS avs_mismatch,
 sum(zero_auth::INTEGER) AS zero_auth, sum((amount < 5.0)::INTEGER) AS low_ticket, count(DISTINCT card) AS cards, count(DISTINCT merchant) AS merchants, count(DISTINCT device) AS devices, min(ts) AS first_ts, max(ts) AS last_ts,
 CASE WHEN any_value(t) < 4 THEN 1.0 ELSE any_value(h) END AS digit_entropy, CASE WHEN count(*) < 2 THEN 0.0 ELSE count(*) / greatest((max(us) - min(us)) / 3.6e9, 1 / 60.0::DOUBLE) END AS peak_per_hour FROM auth a JOIN en ON en.account = a.account GROUP BY a.account)"""


@query("A1_identity_rollup", f"WITH {_ROLL} SELECT identity, attempts::DOUBLE AS attempts, declines::DOUBLE AS declines, cvv_mismatch::DOUBLE AS cvv_mismatch, avs_mismatch::DOUBLE AS avs_mismatch, zero_auth::DOUBLE AS zero_auth, low_ticket::DOUBLE AS low_ticket, cards::DOUBLE AS cards, merchants::DOUBLE AS merchants, devices::DOUBLE AS devices, round(digit_entropy, 6) AS digit_entropy, round(peak_per_hour, 6) AS peak_per_hour FROM roll")
def a1(spark, d):
    return rounded(V.rollup(auth(spark, d)).drop("first_ts", "last_ts"), "identity")


_VAR = ", ".join(f"v{t} AS (SELECT {t}, count(DISTINCT name) AS n FROM ident GROUP BY {t})" for t in ("dob", "phone", "address"))
_CNT = ", ".join(f"c{t} AS (SELECT {t}, count(*) AS n FROM ident GROUP BY {t})" for t in ("device", "address", "phone", "dob", "ip"))
_ROWS = f"""{A.IDENTITY_SQL}, {_ROLL}, {_VAR}, {_CNT}, rows_ AS (SELECT i.*, credit_months < 12 AS thin, credit_months::DOUBLE / greatest(1, (age - 18) * 12) AS ratio, vdob.n > 1 OR vphone.n > 1 OR vaddress.n > 1 AS pii, cdevice.n > 1 AS sd, caddress.n > 1 AS sa, cphone.n > 1 AS sp, caddress.n AS an, r.*
 EXCLUDE (identity) FROM ident i JOIN vdob ON vdob.dob = i.dob JOIN vphone ON vphone.phone = i.phone JOIN vaddress ON vaddress.address = i.address JOIN cdevice ON cdevice.device = i.device JOIN caddress ON caddress.address = i.address JOIN cphone ON cphone.phone = i.phone LEFT JOIN roll r ON r.identity = i.identity)"""
_AGG = """avg(kurtosis) AS residual_kurtosis, avg(liveness) AS liveness_score, avg(thin::INTEGER) AS thin_file_share, avg(ratio) AS credit_age_ratio, avg(age) AS declared_age, avg(an) AS address_shared_count, avg(pii::INTEGER) AS pii_recombination_share,
 avg(sd::INTEGER) AS shared_device_share, avg(sa::INTEGER) AS shared_address_share, avg(sp::INTEGER) AS shared_phone_share, count(attempts)::DOUBLE AS accounts_transacting, coalesce(sum(attempts), 0)::DOUBLE AS attempts,
 avg(cards) AS distinct_pans_per_account, sum(declines) / sum(attempts)::DOUBLE AS decline_ratio, sum(cvv_mismatch) / sum(attempts)::DOUBLE AS cvv_mismatch_rate, sum(avs_mismatch) / sum(attempts)::DOUBLE AS avs_mismatch_rate,
 sum(zero_auth) / sum(attempts)::DOUBLE AS zero_auth_ratio, sum(low_ticket) / sum(attempts)::DOUBLE AS low_ticket_ratio, avg(digit_entropy) AS pan_digit_entropy, avg(merchants) AS merchants_per_account, avg(peak_per_hour) AS peak_attempts_per_hour"""
_HAVE = ["residual_kurtosis", "liveness_score", "thin_file_share", "credit_age_ratio", "declared_age", "address_shared_count", "pii_recombination_share", "shared_device_share", "shared_address_share", "shared_phone_share", "accounts_transacting", "attempts", "distinct_pans_per_account", "decline_ratio", "cvv_mismatch_rate", "avs_mismatch_rate", "zero_auth_ratio", "low_ticket_ratio", "pan_digit_entropy", "merchants_per_account", "peak_attempts_per_hour"]


@query("A2_A3_A4_cohort_aggregate", f"WITH {_ROWS}, g AS (SELECT coalesce(ring, -1) AS cohort, {_AGG} FROM rows_ GROUP BY 1) SELECT cohort, {', '.join(f'round({m}, 6)::DOUBLE AS {m}' for m in _HAVE)} FROM g")
def a2(spark, d):
    rows = V.cohort_rows(A.identities(spark, d), V.rollup(auth(spark, d))).withColumn("cohort", F.coalesce("ring", F.lit(-1)))
    return rounded(V.aggregate(rows, "cohort"), "cohort")


_DIR = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{V.METRICS[m][1]}'" for m in _HAVE) + " END"
_EVID = f"""{_ROWS}, x AS (SELECT b.r AS ring, coalesce(rows_.ring = b.r, FALSE) AS inside, rows_.* EXCLUDE (ring) FROM rows_, (SELECT DISTINCT ring::BIGINT AS r FROM ident WHERE ring IS NOT NULL) b), g AS (SELECT ring, inside, {_AGG} FROM x GROUP BY ring, inside),
u AS ({' UNION ALL '.join(f"SELECT ring, inside, '{m}' AS metric, {m}::DOUBLE AS v FROM g" for m in _HAVE)}),
p AS (SELECT ring, metric, max(v) FILTER (inside) AS value, max(v) FILTER (NOT inside) AS baseline, {_DIR} AS direction FROM u GROUP BY ring, metric),
ev AS (SELECT *, CASE WHEN direction <> 'count' AND baseline <> 0 THEN value / baseline END AS ratio, CASE WHEN baseline IS NOT NULL AND direction = 'higher' THEN value > baseline WHEN baseline IS NOT NULL AND direction = 'lower' THEN value < baseline END AS elevated FROM p WHERE value IS NOT NULL)"""


def evidence(spark, d):
    """All rings that occur."""
    return V.for_every_ring(A.identities(spark, d), V.rollup(auth(spark, d))).withColumn("ring", F.col("ring").cast("bigint"))


@query("A5_ring_against_rest", f"WITH {_EVID} SELECT ring, metric, direction, round(value, 6) AS value, round(baseline, 6) AS baseline, round(ratio, 6) AS ratio, elevated FROM ev")
def a5(spark, d):
    return evidence(spark, d).select("ring", "metric", "direction", *[F.round(c, 6).alias(c) for c in ("value", "baseline", "ratio")], "elevated")


@query(
    "A15_top_signals",
    f"WITH {_EVID}, s AS (SELECT *, CASE WHEN ratio >= 1 THEN ratio ELSE 1 / ratio END AS sev FROM ev WHERE elevated AND ratio <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY ring, CASE metric {' '.join(f'''WHEN '{m}' THEN '{V.METRICS[m][0]}' ''' for m in _HAVE)} END ORDER BY sev DESC, metric DESC) AS place FROM s WHERE sev >= 1.5) "
    "SELECT ring, metric, round(sev, 6) AS severity, place FROM r WHERE place <= 3",
)
def a15(spark, d):
    return V.top_signals(evidence(spark, d)).select("ring", "metric", F.round("severity", 6).alias("severity"), F.col("place").cast("long").alias("place"))


@query(
    "A6_A7_A9_onboarding_features",
    f"""WITH {A.IDENTITY_SQL}, {_VAR}, {_CNT}, s AS (SELECT identity, regexp_replace(regexp_replace(substr(handle, 1, 16), '\\p{{L}}', 'a', 'g'), '\\p{{Nd}}', '9', 'g') AS h FROM ident), sc AS (SELECT h, count(*) AS n FROM s GROUP BY h)
SELECT i.identity, {', '.join(f'c{t}.n AS shared_{t}_count' for t in ('device', 'address', 'phone', 'dob', 'ip'))}, vdob.n AS dob_name_variety, vphone.n AS phone_name_variety, sc.n AS email_shape_frequency, round(credit_months::DOUBLE / greatest(1, (age - 18) * 12), 6) AS credit_age_ratio, (credit_months < 12)::INTEGER::DOUBLE AS is_thin_file
FROM ident i {' '.join(f'JOIN c{t} ON c{t}.{t} = i.{t}' for t in ('device', 'address', 'phone', 'dob', 'ip'))} JOIN vdob ON vdob.dob = i.dob JOIN vphone ON vphone.phone = i.phone JOIN s ON s.identity = i.identity JOIN sc ON sc.h = s.h""",
)
def a9(spark, d):
    out = V.onboarding_features(A.identities(spark, d))
    return out.select("identity", *[f"shared_{t}_count" for t in ("device", "address", "phone", "dob", "ip")], "dob_name_variety", "phone_name_variety", "email_shape_frequency", F.round("credit_age_ratio", 6).alias("credit_age_ratio"), "is_thin_file")


_PAIRS = f"{A.TAGS_SQL}, e AS (SELECT identity, unnest(indices) AS i FROM tags), c AS (SELECT a.identity AS l, b.identity AS r, count(*) AS k FROM e a JOIN e b ON a.i = b.i AND a.identity < b.identity GROUP BY ALL), p AS (SELECT * FROM c WHERE k / (32.0::DOUBLE - k) >= 0.3)"


@query("A8_near_duplicate_degree", f"WITH {_PAIRS} SELECT identity, count(*)::BIGINT AS n FROM (SELECT l AS identity FROM p UNION ALL SELECT r FROM p) GROUP BY identity")
def a8(spark, d):
    from ..operators.pairs import overlapping

    return V.tag_degree(overlapping(A.tags(spark, d), 0.3)).select("identity", "n")


@query("A12_T5_hourly_histogram", f"WITH {A.AUTH_SQL} SELECT hour(ts)::BIGINT AS hour, count(*)::BIGINT AS n, sum((response_code <> 'approved')::INTEGER)::BIGINT AS declined, round(min(amount), 6) AS least, round(max(amount), 6) AS most FROM auth GROUP BY 1")
def a12(spark, d):
    g = A.auth_events(spark, d).groupBy(F.hour("ts").cast("long").alias("hour"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(M.declined(F.col("response_code")).cast("long")).alias("declined"), F.round(F.min("amount"), 6).alias("least"), F.round(F.max("amount"), 6).alias("most"))


@query("A13_latency_percentiles", f"WITH {A.AUTH_SQL} SELECT count(*)::BIGINT AS n, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99, max(amount) AS most FROM auth")
def a13(spark, d):
    p = F.percentile("amount", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return A.auth_events(spark, d).agg(F.count(F.lit(1)).alias("n"), p.alias("p"), F.max("amount").alias("most")).select("n", *[F.round(F.get("p", i), 6).alias(f"p{k}") for i, k in enumerate((50, 95, 99))], "most")


@query(
    "A14_E8_ring_visibility",
    f"WITH {A.IDENTITY_SQL}, b AS (SELECT ring, institution, count(*) AS n FROM ident WHERE ring IS NOT NULL GROUP BY ALL), r AS (SELECT ring, sum(n)::BIGINT AS size, count(*)::BIGINT AS institutions, max(n) / sum(n)::DOUBLE AS s FROM b GROUP BY ring) SELECT ring, size, institutions, round(s, 6) AS largest_share, round((SELECT quantile_cont(s, 0.5) FROM r), 6) AS median_share FROM r",
)
def a14(spark, d):
    seen = V.ring_visibility(A.identities(spark, d))
    middle = seen.agg(F.round(F.percentile("largest_share", 0.5), 6).alias("median_share"))
    return seen.crossJoin(middle).withColumn("largest_share", F.round("largest_share", 6))  # one row


@query("A17_address_shared_count", f"WITH {A.IDENTITY_SQL} SELECT i.identity, c.n::BIGINT AS address_shared_count FROM ident i JOIN (SELECT address, count(*) AS n FROM ident GROUP BY address) c ON c.address = i.address")
def a17(spark, d):
    return V.token_counts(A.identities(spark, d), ("address",)).select("identity", F.col("shared_address_count").alias("address_shared_count"))


_THR = "thr AS (SELECT coalesce(min(score) FILTER (fp <= {f} * al), 'infinity'::DOUBLE) AS t FROM (SELECT score, sum(ng) OVER (ORDER BY score DESC) AS fp, sum(ng) OVER () AS al FROM (SELECT {s} AS score, sum((y = 0)::INTEGER) AS ng FROM {src} GROUP BY 1)))"
_FPR = 0.05


@query(
    "L4_L5_E1_metrics_at_fpr",
    f"WITH {A.SCORED_SQL}, {_THR.format(f=_FPR, s='score', src='scored')}, lv AS (SELECT score, sum((y = 1)::INTEGER)::DOUBLE AS p, sum((y = 0)::INTEGER)::DOUBLE AS n FROM scored GROUP BY score), "
    "au AS (SELECT sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS auc FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lv)) "
    "SELECT round(max(t), 6) AS threshold, round(sum((score >= t AND y = 1)::INTEGER) / sum(y)::DOUBLE, 6) AS detection_rate, round(sum((score >= t AND y = 1)::INTEGER) / sum((score >= t)::INTEGER)::DOUBLE, 6) AS precision, round(sum((score >= t AND y = 0)::INTEGER) / sum((y = 0)::INTEGER)::DOUBLE, 6) AS false_positive_rate, round(max(auc), 6) AS auc FROM scored, thr, au",
)
def l4(spark, d):
    return rounded(E.evaluate(A.scored(spark, d), _FPR))


def _cohort_sql(c: str) -> str:
    return f"WITH {A.SCORED_SQL}, {_THR.format(f=_FPR, s='score', src='scored')} SELECT {c} AS cohort, count(*)::BIGINT AS n, sum((score >= t)::INTEGER)::BIGINT AS declined, round(avg((score >= t)::INTEGER), 6) AS rate FROM scored, thr WHERE y = 0 GROUP BY 1"


@query("E2_lookalike_decline", _cohort_sql("lookalike"))
def e2(spark, d):
    s = A.scored(spark, d)
    return E.false_decline(s, E.threshold_at_fpr(s, _FPR), F.col("lookalike")).withColumn("rate", F.round("rate", 6))


@query("E3_P6_thin_file_decline", _cohort_sql("thin"))
def e3(spark, d):
    s = A.scored(spark, d)
    return E.false_decline(s, E.threshold_at_fpr(s, _FPR), F.col("thin")).withColumn("rate", F.round("rate", 6))


@query(
    "E4_attempts_to_detection",
    f"WITH {A.SCORED_SQL}, {_THR.format(f=_FPR, s='score', src='scored')}, o AS (SELECT account, score, row_number() OVER (PARTITION BY account ORDER BY doc_id) AS nth FROM scored WHERE y = 1), c AS (SELECT account, min(nth) FILTER (score >= t) AS hit FROM o, thr GROUP BY account) "
    "SELECT count(*)::DOUBLE AS accounts_with_fraud, count(hit)::DOUBLE AS accounts_caught, (count(*) - count(hit))::DOUBLE AS accounts_never_caught, round(quantile_cont(hit, 0.5), 6) AS median_attempts, round(quantile_cont(hit, 0.9), 6) AS p90_attempts, round(avg(hit), 6) AS mean_attempts FROM c",
)
def e4(spark, d):
    s = A.scored(spark, d)
    return rounded(E.attempts_to_detection(s, E.threshold_at_fpr(s, _FPR)))


_T = f"{A.IDENTITY_SQL}, tr AS (SELECT identity, is_synthetic, ring, CASE WHEN identity % 3 = 0 THEN 1 END AS first_fraud FROM ident), fl AS (SELECT identity FROM ident WHERE device < 90), sd AS (SELECT ring, min(identity) AS identity FROM ident WHERE ring < 2 GROUP BY ring)"


def truth(spark, d):
    return A.identities(spark, d).select("identity", "is_synthetic", "ring", F.when(F.col("identity") % 3 == 0, 1).alias("first_fraud"), "device")


@query(
    "E5_ring_recall_before_transacting",
    f"WITH {_T} SELECT ring, count(*)::BIGINT AS size, sum((first_fraud IS NULL)::INTEGER)::BIGINT AS never_transacted, sum((first_fraud IS NULL AND identity IN (SELECT identity FROM fl))::INTEGER)::BIGINT AS flagged, round(sum((first_fraud IS NULL AND identity IN (SELECT identity FROM fl))::INTEGER) / greatest(1, sum((first_fraud IS NULL)::INTEGER))::DOUBLE, 6) AS recall FROM tr WHERE ring IS NOT NULL GROUP BY ROLLUP (ring)",
)
def e5(spark, d):
    t = truth(spark, d)
    return E.ring_recall(t, t.filter("device < 90")).withColumn("recall", F.round("recall", 6))


@query(
    "E6_E9_propagation_precision",
    f"WITH {_T}, f2 AS (SELECT identity FROM fl EXCEPT SELECT identity FROM sd), m AS (SELECT tr.* FROM f2 JOIN tr ON tr.identity = f2.identity) SELECT (SELECT count(*) FROM tr)::DOUBLE AS identities_total, count(*)::DOUBLE AS flagged, round(count(*) / (SELECT count(*) FROM tr)::DOUBLE, 6) AS flagged_share, round(avg(is_synthetic::INTEGER), 6) AS precision_synthetic, round(avg((is_synthetic AND coalesce(ring IN (SELECT ring FROM sd), FALSE))::INTEGER), 6) AS precision_same_ring, sum((NOT is_synthetic)::INTEGER)::DOUBLE AS false_flags FROM m",
)
def e6(spark, d):
    t = truth(spark, d)
    seeds = t.filter("ring < 2").groupBy("ring").agg(F.min("identity").alias("identity"))
    return rounded(E.propagation_precision(t, t.filter("device < 90"), seeds))


def _day(keys: str) -> str:
    return f"(PARTITION BY {keys} ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)"


def _model_sql(keys: str) -> str:
    return f"least(1.0, count(*) OVER {_day(keys)} / 40.0::DOUBLE + 0.5 * coalesce(avg((response_code <> 'approved')::INTEGER::DOUBLE) OVER {_day(keys)}, 0))"


_VIEWS = f"""{A.AUTH_SQL}, tr AS (SELECT account, min(us) + 259200000000 AS f, account % 4 = 1 AS syn FROM auth GROUP BY account),
w AS (SELECT auth.account, merchant, us, round({_model_sql('account')}, 9) AS score, round({_model_sql('account, merchant')}, 9) AS scoped FROM auth),
scored AS (SELECT w.*, (syn AND us >= f)::INTEGER AS y FROM w JOIN tr ON tr.account = w.account WHERE us > (SELECT (min(us) + max(us)) // 2 FROM auth))"""


@query(
    "E7_view_delta",
    f"WITH {_VIEWS}, tp AS (SELECT merchant FROM scored GROUP BY merchant HAVING count(*) >= 500 AND sum(y) > 0 ORDER BY sum(y) DESC, merchant LIMIT 40), pl AS (SELECT * FROM scored WHERE merchant IN (SELECT merchant FROM tp)), {_THR.format(f=_FPR, s='score', src='pl')}, {_THR.format(f=_FPR, s='scoped', src='pl').replace('thr AS', 'own AS')} "
    "SELECT count(DISTINCT merchant)::DOUBLE AS groups_compared, count(*)::DOUBLE AS events, sum(y)::DOUBLE AS fraud, round(sum((y = 1 AND scoped >= own.t)::INTEGER) / sum(y)::DOUBLE, 6) AS scoped_rate, round(sum((y = 1 AND score >= thr.t)::INTEGER) / sum(y)::DOUBLE, 6) AS network_rate, round((sum((y = 1 AND score >= thr.t)::INTEGER) - sum((y = 1 AND scoped >= own.t)::INTEGER)) / sum(y)::DOUBLE, 6) AS delta FROM pl, thr, own",
)
def e7(spark, d):
    """A fixed model over windows of the whole network and over windows rebuilt from what each merchant sees; holdout: the
    second half of the time."""
    from ..operators import windows as W

    def model(keys):
        day = W.trailing(keys, 86400)
        return F.round(F.least(F.lit(1.0), F.count(F.lit(1)).over(day) / 40.0 + 0.5 * W.ratio("decline", day)), 9)

    events = W.flags(A.auth_events(spark, d)).select("account", "merchant", "us", "f_decline")
    low, high = events.agg(F.min("us"), F.max("us")).first()
    rows = W.in_slices(events, 86400, lambda by: {"score": model(["account", *by]), "scoped": model(["account", "merchant", *by])})
    first = events.groupBy("account").agg((F.min("us") + 259_200_000_000).alias("_f"))
    late = rows.filter(F.col("us") > ((low or 0) + (high or 0)) // 2).join(first, "account")
    return rounded(E.view_delta(late.withColumn("y", ((F.col("account") % 4 == 1) & (F.col("us") >= F.col("_f"))).cast("int")), "merchant", _FPR))


_NAMES = "['sloppy', 'moderate', 'sophisticated', 'drift', 'other']"


@query(
    "E10_robustness_curve",
    f"""WITH {A.SCORED_SQL}, sc AS (SELECT *, ({_NAMES})[doc_id % 5 + 1] AS scenario FROM scored),
th AS (SELECT scenario, coalesce(min(score) FILTER (fp <= {_FPR} * al), 'infinity'::DOUBLE) AS t FROM (SELECT scenario, score, sum(ng) OVER (PARTITION BY scenario ORDER BY score DESC) AS fp, sum(ng) OVER (PARTITION BY scenario) AS al FROM (SELECT scenario, score, sum((y = 0)::INTEGER) AS ng FROM sc GROUP BY ALL)) GROUP BY scenario),
ow AS (SELECT scenario, coalesce(min(scoped) FILTER (fp <= {_FPR} * al), 'infinity'::DOUBLE) AS o FROM (SELECT scenario, scoped, sum(ng) OVER (PARTITION BY scenario ORDER BY scoped DESC) AS fp, sum(ng) OVER (PARTITION BY scenario) AS al FROM (SELECT scenario, scoped, sum((y = 0)::INTEGER) AS ng FROM sc GROUP BY ALL)) GROUP BY scenario),
lv AS (SELECT scenario, score, sum((y = 1)::INTEGER)::DOUBLE AS p, sum((y = 0)::INTEGER)::DOUBLE AS n FROM sc GROUP BY ALL),
au AS (SELECT scenario, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY scenario ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lv) GROUP BY scenario),
tri AS (SELECT scenario, quantile_cont(hit, 0.5) AS med, count(*) - count(hit) AS never FROM (SELECT scenario, account, min(nth) FILTER (score >= t) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY scenario, account ORDER BY doc_id) AS nth FROM sc WHERE y = 1) JOIN th USING (scenario) GROUP BY ALL) GROUP BY scenario),
rr AS (SELECT ({_NAMES})[c_custkey % 5 + 1] AS scenario, avg((c_custkey % 211 < 90)::INTEGER) AS recall FROM customer WHERE c_custkey % 25 < 5 AND c_custkey % 3 <> 0 GROUP BY 1),
m AS (SELECT scenario, sum((score >= t AND y = 0)::INTEGER) / sum((y = 0)::INTEGER)::DOUBLE AS fpr, sum((score >= t AND y = 1)::INTEGER) / sum(y)::DOUBLE AS det, sum((scoped >= o AND y = 1)::INTEGER) / sum(y)::DOUBLE AS own, avg((score >= t)::INTEGER) FILTER (lookalike AND y = 0) AS lk FROM sc JOIN th USING (scenario) JOIN ow USING (scenario) GROUP BY scenario)
SELECT scenario, {_FPR}::DOUBLE AS target_fpr, round(fpr, 6) AS realised_fpr, round(auc, 6) AS auc, round(det, 6) AS detection_rate, round(med, 6) AS median_attempts_to_detection, never::BIGINT AS accounts_never_caught, round(recall, 6) AS ring_recall_before_transacting, round(lk, 6) AS lookalike_false_decline,
 round(own, 6) AS merchant_view_detection_rate, round(det, 6) AS network_view_detection_rate FROM m LEFT JOIN au USING (scenario) LEFT JOIN tri USING (scenario) LEFT JOIN rr USING (scenario)""",
)
def e10(spark, d):
    names = F.array(*[F.lit(x) for x in (*E.SCENARIOS, "other")])
    scored = A.scored(spark, d).withColumn("scenario", F.get(names, (F.col("doc_id") % 5).cast("int")))
    rings = A.identities(spark, d).filter("identity % 25 < 5").select(F.get(names, (F.col("identity") % 5).cast("int")).alias("scenario"), "identity", F.when(F.col("identity") % 3 == 0, 1).alias("first_fraud"), (F.col("device") < 90).alias("flagged"))
    recall = rings.filter("first_fraud IS NULL").groupBy("scenario").agg(F.avg(F.col("flagged").cast("double")).alias("recall"))
    out = E.robustness_curve(E.curve(scored, recall, _FPR))
    return out.select("scenario", *[c if t == "bigint" else F.round(c, 6).alias(c) for c, t in out.dtypes if c != "scenario"])


@query("L7_L8_point_in_time", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= TIMESTAMP '1997-01-01' AND o_orderdate > TIMESTAMP '1996-01-01'")
def l7(spark, d):
    orders = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    rows = A.table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "label_available_at").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return E.out_of_time(E.point_in_time(rows, F.lit("1997-01-01").cast("timestamp_ntz")), F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_partkey")


_FUSE = """f AS (SELECT seq, least(1.0, b * (1 + 0.35 * onb)) AS score, onb FROM (SELECT seq, greatest(own, 0.7 * prop) AS b, onb FROM (SELECT event_id AS seq, value / 500.0 AS own, (event_id % 50) / 49.0::DOUBLE AS prop, (event_id % 20) / 19.0::DOUBLE AS onb FROM events)))"""


@query("F1_F2_F3_fusion", f"WITH {_FUSE} SELECT seq, round(score, 6) AS score FROM f")
def f1(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("value") / 500.0).alias("own"), ((F.col("event_id") % 50) / 49.0).alias("prop"), ((F.col("event_id") % 20) / 19.0).alias("onb"))
    return e.select("seq", F.round(D.fuse_forward(D.fuse_propagated(F.col("own"), F.col("prop")), F.col("onb")), 6).alias("score"))


@query("F2_fusion_of_tables", f"WITH {A.SCORED_SQL}, a AS (SELECT doc_id AS identity, score AS own FROM scored WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS identity, scoped AS propagated FROM scored WHERE doc_id % 2 = 0) SELECT coalesce(a.identity, b.identity) AS identity, round(greatest(coalesce(own, 0), 0.7 * coalesce(propagated, 0)), 6) AS fused FROM a FULL JOIN b ON a.identity = b.identity")
def f2(spark, d):
    s = A.scored(spark, d).withColumnRenamed("doc_id", "identity")
    return D.fuse(s.filter("identity % 3 <> 0").select("identity", F.col("score").alias("own")), s.filter("identity % 2 = 0").select("identity", F.col("scoped").alias("propagated"))).withColumn("fused", F.round("fused", 6))


_RULES = [(c, *v) for c, v in D.TRIGGERS.items() if v[0] in ("acct_decline_ratio_1h", "acct_distinct_pans_1h", "acct_timing_cv_1h", "acct_n_1m", "acct_age_days")]
_FEATS = "event_id % 100 / 99.0::DOUBLE AS acct_decline_ratio_1h, (event_id % 13)::DOUBLE AS acct_distinct_pans_1h, event_id % 31 / 30.0::DOUBLE AS acct_timing_cv_1h, (event_id % 9)::DOUBLE AS acct_n_1m, event_id % 17 / 2.0::DOUBLE AS acct_age_days"
_FIRED = ", ".join(f"CASE WHEN {f} {'>=' if w == 'above' else '<='} {b} THEN {{'m': -abs({f} - {b}) / ({abs(b)} + 1e-6), 'o': {i}, 'c': '{c}'}} END" for i, (c, f, w, b) in enumerate(_RULES))
_DECIDE = f"""d0 AS (SELECT event_id AS seq, user_id AS card, value / 400.0 AS score, (event_id % 20) / 19.0::DOUBLE AS onb, CASE WHEN event_id % 11 = 0 THEN 'r1' END AS ring, event_id % 23 = 0 AS propagated, CASE WHEN event_id % 2 = 0 THEN 'network' ELSE 'issuer' END AS view, event_id % 7 AS hits, {_FEATS} FROM events),
d1 AS (SELECT *, 1 - 0.25 * onb AS k FROM d0), d2 AS (SELECT *, CASE WHEN score >= 0.9 * k THEN 'confirmed' WHEN score >= 0.75 * k THEN 'high' WHEN score >= 0.55 * k THEN 'elevated' WHEN score >= 0.3 * k THEN 'medium' ELSE 'low' END AS band,
 list_transform(list_sort(list_filter([{_FIRED}], lambda x: x IS NOT NULL)), lambda x: x.c) AS fired FROM d1),
d3 AS (SELECT *, list_concat(list_concat(CASE WHEN propagated THEN ['ring_sibling_confirmed_fraud'] ELSE [] END, fired), list_concat(CASE WHEN ring IS NOT NULL THEN ['ring_membership'] ELSE [] END, CASE WHEN view = 'network' AND hits > 0 THEN ['cross_institution_indicator'] ELSE [] END)) AS r FROM d2),
d4 AS (SELECT *, (CASE WHEN len(r) = 0 AND band <> 'low' THEN ['velocity_spike'] ELSE r END)[1:6] AS codes, CASE band WHEN 'low' THEN 'allow' WHEN 'medium' THEN 'step_up' WHEN 'elevated' THEN 'throttle' WHEN 'high' THEN 'honeypot' ELSE 'block' END AS action FROM d3)"""


def decided(spark, d):
    e, i = A.table(spark, d, "events"), F.col("event_id")
    rows = e.select(
        i.alias("seq"), F.col("user_id").alias("card"), (F.col("value") / 400.0).alias("score"), ((i % 20) / 19.0).alias("onboarding"), F.when(i % 11 == 0, "r1").alias("ring"), (i % 23 == 0).alias("propagated"), F.when(i % 2 == 0, "network").otherwise("issuer").alias("view"), (i % 7).alias("cross_hits"),
        (i % 100 / 99.0).alias("acct_decline_ratio_1h"), (i % 13).cast("double").alias("acct_distinct_pans_1h"), (i % 31 / 30.0).alias("acct_timing_cv_1h"), (i % 9).cast("double").alias("acct_n_1m"), (i % 17 / 2.0).alias("acct_age_days"),
    )
    return D.decide(rows)


@query("F4_F5_F6_F7_F8_decisions", f"WITH {_DECIDE} SELECT seq, round(greatest(0, least(1, score)), 6)::DOUBLE AS score, band, action, array_to_string(codes, ',') AS reason_codes FROM d4")
def f4(spark, d):
    return decided(spark, d).select("seq", F.round("score", 6).alias("score"), "band", "action", F.array_join("reason_codes", ",").alias("reason_codes"))


_POT = "('0x' || substr(sha256(card::VARCHAR), 1, 8))::BIGINT"


@query("F9_F10_A18_outcomes", f"WITH {_DECIDE}, o AS (SELECT action, CASE action WHEN 'allow' THEN 'approved' WHEN 'step_up' THEN 'challenge_required' WHEN 'throttle' THEN 'declined_try_again_later' WHEN 'honeypot' THEN CASE WHEN {_POT} % 20 = 0 THEN 'approved' ELSE 'declined_do_not_honor' END ELSE 'declined_risk' END AS outcome FROM d4) SELECT action, outcome, count(*)::BIGINT AS n, round((SELECT avg((action <> 'allow')::INTEGER) FROM o), 6) AS intervention_rate FROM o GROUP BY action, outcome")
def f9(spark, d):
    out = decided(spark, d)
    rate = V.intervention_rate(out).select(F.round("rate", 6).alias("intervention_rate"))
    return out.groupBy("action", D.gateway_outcome(F.col("action"), F.col("card")).alias("outcome")).agg(F.count(F.lit(1)).alias("n")).crossJoin(rate)  # one row


_TEXT = "CASE c " + " ".join(f"WHEN '{c}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for c, t in D.REASONS.items()) + " END"


@query("F11_reason_texts", f"WITH {_DECIDE} SELECT code, {_TEXT.replace('CASE c', 'CASE code')} AS text, count(*)::BIGINT AS n FROM (SELECT unnest(codes) AS code FROM d4) GROUP BY code")
def f11(spark, d):
    both = decided(spark, d).select(F.explode(F.arrays_zip(F.col("reason_codes").alias("code"), D.explain(F.col("reason_codes")).alias("text"))).alias("z"))
    return both.groupBy(F.col("z.code").alias("code"), F.col("z.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


_MH = "[" + ", ".join(f"list_min(list_transform(indices, lambda i: ({a}::BIGINT * i + {b}) % 2147483647))" for a, b in H.coefficients(64)) + "]"


@query("H2_H3_minhash_bands", f"WITH {A.TAGS_SQL}, s AS (SELECT identity, {_MH} AS s FROM tags) SELECT identity, array_to_string(s, ',') AS signature, sha256('0|' || array_to_string(s[1:4], ',')) AS band_0, sha256('1|' || array_to_string(s[5:8], ',')) AS band_1 FROM s")
def h2(spark, d):
    s = A.tags(spark, d).select("identity", H.minhash(F.col("indices")).alias("s"))
    b = H.bands(F.col("s"), 2, 4)
    return s.select("identity", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("signature"), F.get(b, 0).alias("band_0"), F.get(b, 1).alias("band_1"))


_ROLE = H.role("face", 64)


@query("H4_bind_unbind", f"WITH {A.TAGS_SQL} SELECT identity, array_to_string(list_sort(list_transform(indices, lambda i: ({_ROLE[0]} * i + {_ROLE[1]}) % 64)), ',') AS bound, array_to_string(indices, ',') AS back FROM tags")
def h4(spark, d):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return A.tags(spark, d).withColumn("b", H.bind(F.col("indices"), "face", 64)).select("identity", joined(F.col("b")).alias("bound"), joined(H.unbind(F.col("b"), "face", 64)).alias("back"))


@query("H5_K5_H6_ring_fingerprint", f"WITH {A.TAGS_SQL}, v AS (SELECT label, i, count(*) AS v FROM (SELECT label, unnest(indices) AS i FROM tags) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, sha256(i::VARCHAR)) AS r FROM v) SELECT label, array_to_string(list_sort(list(i)), ',') AS indices FROM r WHERE r <= 16 GROUP BY label")
def h5(spark, d):
    out = H.bundle(A.tags(spark, d), "label", "indices", 16)
    return out.select("label", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


_BITS, _HASHES = H.bloom_size(500, 0.01)
_POS = f"SELECT v, ('0x' || substr(sha256('salt|' || v || '|' || k), 1, 13))::BIGINT % {_BITS} AS p FROM {{src}}, (SELECT unnest(range(0, {_HASHES})) AS k)"


@query(
    "H8_H9_H10_J16_bloom_exchange",
    f"WITH a AS (SELECT c_custkey AS v FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_custkey AS v FROM customer WHERE c_custkey % 2 = 0), w AS (SELECT DISTINCT p FROM ({_POS.format(src='a')})), q AS (SELECT v, bool_and(p IN (SELECT p FROM w)) AS present FROM ({_POS.format(src='b')}) GROUP BY v) SELECT v AS c_custkey, present, round(pow((SELECT count(*) FROM w) / {_BITS}.0::DOUBLE, {_HASHES}), 6) AS fpr FROM q",
)
def h9(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey")
    words = H.bloom_words(c.filter("c_custkey % 3 = 0"), "c_custkey", _BITS, _HASHES, "salt")
    fpr = H.realised_fpr(words, _BITS, _HASHES).select(F.round("fpr", 6).alias("fpr"))
    return H.bloom_contains(c.filter("c_custkey % 2 = 0"), "c_custkey", words, _BITS, _HASHES, "salt").crossJoin(fpr)  # one row


@query(
    "H10_exchange_summary",
    f"WITH a AS (SELECT c_custkey AS v FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT c_custkey AS v FROM customer WHERE c_custkey % 2 = 0), w AS (SELECT DISTINCT p FROM ({_POS.format(src='a')})), q AS (SELECT v, bool_and(p IN (SELECT p FROM w)) AS present FROM ({_POS.format(src='b')}) GROUP BY v) "
    f"SELECT (SELECT count(*) FROM b)::BIGINT AS n_left, (SELECT count(*) FROM a)::BIGINT AS n_right, (SELECT count(*) FROM q WHERE present)::BIGINT AS n_shared, {-(-_BITS // 8)}::BIGINT AS filter_bytes, round(pow((SELECT count(*) FROM w) / {_BITS}.0::DOUBLE, {_HASHES}), 6) AS filter_fp_rate, round({-(-_BITS // 8)} / greatest(1, (SELECT count(*) FROM a))::DOUBLE, 6) AS bytes_per_item",
)
def h10(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey")
    out = H.exchange_summary(c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 3 = 0"), "c_custkey", "salt", (_BITS, _HASHES))
    return out.withColumns({k: F.round(k, 6) for k in ("filter_fp_rate", "bytes_per_item")})


_EXCHANGE = (1 << 16, 7)
_BANDS = "[" + ", ".join(f"sha256('{k}|' || array_to_string(s[{4 * k + 1}:{4 * k + 4}], ','))" for k in range(32)) + "]"
_MH128 = "[" + ", ".join(f"list_min(list_transform(indices, lambda i: ({a}::BIGINT * i + {b}) % 2147483647))" for a, b in H.coefficients(128)) + "]"
_AT = f"SELECT identity, v, ('0x' || substr(sha256('epoch|' || v || '|' || k), 1, 13))::BIGINT % {_EXCHANGE[0]} AS p FROM b, (SELECT unnest(range(0, {_EXCHANGE[1]})) AS k)"


@query(
    "H11_identity_match",
    f"WITH {A.TAGS_SQL}, s AS (SELECT identity, {_MH128} AS s FROM tags), b AS (SELECT DISTINCT identity, unnest({_BANDS}) AS v FROM s), po AS MATERIALIZED ({_AT}), w AS (SELECT DISTINCT p FROM po WHERE identity % 2 = 0), q AS (SELECT identity, v, bool_and(p IN (SELECT p FROM w)) AS present FROM po GROUP BY ALL) SELECT identity, sum(present::INTEGER)::BIGINT AS hits, sum(present::INTEGER) >= 6 AS matched FROM q GROUP BY identity",
)
def h11(spark, d):
    t = A.tags(spark, d).select("identity", H.bands(H.minhash(F.col("indices"), 128), 32, 4).alias("bands"))
    words = H.bloom_words(t.filter("identity % 2 = 0").select(F.explode("bands").alias("b")), "b", *_EXCHANGE, "epoch")
    return H.match_identities(t, words, *_EXCHANGE, "epoch", "identity", "bands")


@query("H1_fly_tags")
def h1(spark, d):
    return H.fly_tags(A.table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.size("tag.indices").alias("n"), "tag.dim", F.array_join(F.transform("tag.indices", lambda x: x.cast("string")), ",").alias("indices"))


@query("H12_whitening", "WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY i) SELECT vec_id, round(sum((x - m) / (s + 1e-6)), 4) AS total, round(sum(pow((x - m) / (s + 1e-6), 2)), 4) AS energy FROM e JOIN s ON e.i = s.i GROUP BY vec_id")
def h12(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    z = H.whiten(e, "vec_id", "v")
    return z.select("vec_id", F.round(M.total(F.col("v")), 4).alias("total"), F.round(M.total(F.transform("v", lambda x: x * x)), 4).alias("energy"))
