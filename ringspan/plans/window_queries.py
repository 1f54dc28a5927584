"""Queries and SQL for windows and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import scalars as M
from ..operators import windows as W

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def rounded(df, *keep: str, digits: int = 6):
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keep])


def _w(key: str, seconds: int) -> str:
    return f"(PARTITION BY {key} ORDER BY us RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND 1 PRECEDING)"


_FLAG_SQL = {
    "decline": "response_code <> 'approved'", "zero_auth": "zero_auth", "cvv_bad": "cvv_result <> 'match'",
    "avs_bad": "avs_result NOT IN ('match', 'partial')", "low_ticket": "amount < 5.0",
}


def _account_sql(keys: str = "account") -> list[str]:
    out = []
    for n, s in M.SPANS.items():
        w = _w(keys, s)
        out.append(f"count(*) OVER {w}::DOUBLE AS acct_n_{n}")
        out += [f"round(coalesce(avg(({c})::INTEGER::DOUBLE) OVER {w}, 0), 6) AS acct_{f}_ratio_{n}" for f, c in _FLAG_SQL.items()]
        out.append(f"count(DISTINCT card) OVER {w}::DOUBLE AS acct_distinct_pans_{n}")
        out.append(f"count(DISTINCT merchant) OVER {w}::DOUBLE AS acct_distinct_merchants_{n}")
        out.append(f"round(coalesce(avg(amount) OVER {w}, 0), 6) AS acct_mean_amount_{n}")
    return out


@query("W1_W4_account_windows", f"WITH {A.AUTH_SQL} SELECT seq, {', '.join(_account_sql())} FROM auth")
def w1(spark, d):
    out = W.account_features(A.auth_events(spark, d))
    return rounded(out.select("seq", *W.account_windows(out)), "seq")


_BAND = "CASE WHEN s >= 0.9 THEN 'confirmed' WHEN s >= 0.75 THEN 'high' WHEN s >= 0.55 THEN 'elevated' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END"


@query(
    "W1_band_counts",
    f"WITH {A.AUTH_SQL}, s AS (SELECT seq, amount, least(1.0, 0.05 * count(*) OVER {_w('account', 86400)} + 0.5 * coalesce(avg((response_code <> 'approved')::INTEGER::DOUBLE) OVER {_w('account', 604800)}, 0)) AS s FROM auth) "
    f"SELECT {_BAND} AS band, count(*)::BIGINT AS n, round(sum(amount), 4) AS amount, round(avg(s), 6) AS mean_score FROM s GROUP BY 1",
)
def bands(spark, d):
    from ..operators.decision import band

    auth = W.flags(A.auth_events(spark, d)).select("account", "us", "amount", "f_decline")
    score = lambda by: {"s": F.least(F.lit(1.0), 0.05 * F.count(F.lit(1)).over(W.trailing(["account", *by], 86400)) + 0.5 * W.ratio("decline", W.trailing(["account", *by], 604800)))}
    return W.in_slices(auth, 604800, score).groupBy(band(F.col("s")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount"), F.round(F.avg("s"), 6).alias("mean_score"))



@query(
    "W5_W6_W7_entropy_and_timing",
    f"""WITH {A.AUTH_SQL}, l AS (SELECT seq, list(suffix) OVER {_w('account', 3600)} AS sf, list(us / 1000000.0::DOUBLE) OVER {_w('account', 3600)} AS ts,
 count(DISTINCT card) OVER {_w('account', 3600)} AS c, count(DISTINCT merchant) OVER {_w('account', 3600)} AS m FROM auth),
o AS (SELECT seq, coalesce(len(sf), 0) AS n, list_sort(list_transform(sf, lambda x: x::BIGINT)) AS v, list_sort(ts) AS t, c, m FROM l),
g AS (SELECT seq, unnest(list_filter(list_transform(range(1, n), lambda i: v[i + 1] - v[i]), lambda x: x > 0)) AS g FROM o WHERE n >= 3),
h AS (SELECT seq, length(g::VARCHAR) - 1 AS b, count(*) AS k FROM g GROUP BY ALL),
e AS (SELECT seq, sum(-(k::DOUBLE / t) * log2(k::DOUBLE / t)) AS g FROM (SELECT *, sum(k) OVER (PARTITION BY seq) AS t FROM h) GROUP BY seq),
d AS (SELECT seq, unnest(list_transform(range(1, n), lambda i: t[i + 1] - t[i])) AS x FROM o WHERE n >= 3),
v AS (SELECT seq, avg(x) AS a, stddev_pop(x) AS s FROM d GROUP BY seq)
SELECT o.seq, round(CASE WHEN n < 3 THEN 1.0 WHEN e.g IS NULL THEN 0.0 ELSE least(1.0, e.g / log2(6)) END, 6) AS acct_pan_entropy_1h,
 round(CASE WHEN n < 3 THEN 1.0 WHEN a <= 1e-9 THEN 0.0 ELSE least(2.0, s / a) END, 6) AS acct_timing_cv_1h, round(c::DOUBLE / greatest(1, m), 6) AS acct_pans_per_merchant_1h
FROM o LEFT JOIN e ON o.seq = e.seq LEFT JOIN v ON o.seq = v.seq""",
)
def w5(spark, d):
    auth = A.auth_events(spark, d).select("seq", "us", "account", "suffix", "card", "merchant")
    return rounded(W.in_slices(auth, 3600, lambda by: W.testing_signals(("account", *by))).select("seq", *W.testing_signals()), "seq")


@query(
    "W8_device_and_ip_windows",
    f"WITH {A.AUTH_SQL} SELECT seq, " + ", ".join(f"count(*) OVER {_w(k, 3600)}::DOUBLE AS {k}_n_1h, count(DISTINCT card) OVER {_w(k, 3600)}::DOUBLE AS {k}_distinct_pans_1h, round(coalesce(avg((response_code <> 'approved')::INTEGER::DOUBLE) OVER {_w(k, 3600)}, 0), 6) AS {k}_decline_ratio_1h" for k in ("device", "ip")) + " FROM auth",
)
def w8(spark, d):
    out = W.in_slices(W.flags(A.auth_events(spark, d)).select("seq", "us", "device", "ip", "card", "f_decline"), 3600, W.entity_windows)
    return rounded(out.select("seq", *W.entity_windows()), "seq")


_NOVEL = """n AS (SELECT *, (row_number() OVER (PARTITION BY account, merchant ORDER BY us, seq) = 1)::INTEGER AS fresh FROM auth)"""
_BEFORE = "(PARTITION BY account ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "W9_W12_age_novelty_own",
    f"""WITH {A.AUTH_SQL}, {_NOVEL} SELECT seq, round(coalesce((us - min(us) OVER {_BEFORE}) / 8.64e10, 0), 6) AS acct_age_days, fresh::DOUBLE AS acct_is_new_merchant,
 coalesce(sum(fresh) OVER {_BEFORE}, 0)::DOUBLE AS acct_known_merchants, zero_auth::INTEGER::DOUBLE AS is_zero_auth, (cvv_result <> 'match')::INTEGER::DOUBLE AS cvv_bad,
 (avs_result NOT IN ('match', 'partial'))::INTEGER::DOUBLE AS avs_bad, hour(ts)::DOUBLE AS hour_of_day, (isodow(ts) - 1)::DOUBLE AS day_of_week FROM n""",
)
def w9(spark, d):
    out = W.with_novelty(W.flags(A.auth_events(spark, d))).withColumns(W.own_event())
    return rounded(out.select("seq", "acct_age_days", "acct_is_new_merchant", "acct_known_merchants", *W.own_event()), "seq")


@query(
    "W1_W3_W4_tie_safe",
    f"""WITH {A.ORDERS_SQL}, n AS (SELECT *, row_number() OVER () AS row_ FROM auth) SELECT any_value(a.seq) AS seq, count(b.seq)::BIGINT AS n_7d, count(DISTINCT b.card)::BIGINT AS pans_7d, round(coalesce(avg(b.amount), 0), 6) AS mean_7d, round(coalesce(avg(b.is_declined::INTEGER::DOUBLE), 0), 6) AS declined_7d
FROM n a LEFT JOIN auth b ON a.account = b.account AND b.us >= a.us - 604800000000 AND (b.us < a.us OR (b.us = a.us AND b.seq < a.seq)) GROUP BY a.row_""",
)
def w_ties(spark, d):
    auth = A.auth_orders(spark, d)
    rows = W.tie_safe(["account"], 604800, {"card": F.col("card"), "amount": F.col("amount"), "d": F.col("is_declined").cast("double")})
    seen = auth.select("seq", rows.alias("r"))
    mean = lambda f: F.when(F.size("r") > 0, F.round(M.total(F.transform("r", lambda x: x[f])) / F.size("r"), 6)).otherwise(0.0)
    return seen.select("seq", F.size("r").cast("long").alias("n_7d"), F.size(F.array_distinct(F.transform("r", lambda x: x["card"]))).cast("long").alias("pans_7d"), mean("amount").alias("mean_7d"), mean("d").alias("declined_7d"))


@query(
    "E7_scoped_windows",
    f"""WITH {A.AUTH_SQL} SELECT seq, count(*) OVER {_w('account', 86400)}::BIGINT AS network_n, count(*) OVER {_w('account, merchant', 86400)}::BIGINT AS merchant_n,
 count(*) OVER {_w('account, institution', 86400)}::BIGINT AS institution_n FROM auth""",
)
def scoped(spark, d):
    n = lambda *k: F.count(F.lit(1)).over(W.trailing(list(k), 86400))
    counts = lambda by: {"network_n": n("account", *by), "merchant_n": n("account", "merchant", *by), "institution_n": n("account", "institution", *by)}
    return W.in_slices(A.auth_events(spark, d).select("seq", "us", "account", "merchant", "institution"), 86400, counts).select("seq", "network_n", "merchant_n", "institution_n")


@query(
    "P1_P8_event_predicates",
    f"""WITH {A.AUTH_SQL} SELECT seq, response_code <> 'approved' AS declined, cvv_result <> 'match' AS cvv_bad, avs_result NOT IN ('match', 'partial') AS avs_bad, avs_result <> 'match' AS avs_mismatch,
 amount < 5.0 AS low_ticket, hour(ts)::BIGINT AS hour_of_day, (isodow(ts) - 1)::BIGINT AS day_of_week FROM auth""",
)
def p1(spark, d):
    return A.auth_events(spark, d).select(
        "seq", M.declined(F.col("response_code")).alias("declined"), M.cvv_bad(F.col("cvv_result")).alias("cvv_bad"), M.avs_bad(F.col("avs_result")).alias("avs_bad"), M.avs_mismatch(F.col("avs_result")).alias("avs_mismatch"),
        M.low_ticket(F.col("amount")).alias("low_ticket"), M.hour_of_day(F.col("ts")).cast("long").alias("hour_of_day"), M.day_of_week(F.col("ts")).cast("long").alias("day_of_week"),
    )


@query(
    "P6_P15_identity_expressions",
    f"""WITH {A.IDENTITY_SQL} SELECT identity, credit_months < 12 AS thin_file, round(credit_months::DOUBLE / greatest(1, (age - 18) * 12), 6) AS credit_age_ratio,
 regexp_replace(regexp_replace(substr(handle, 1, 16), '\\p{{L}}', 'a', 'g'), '\\p{{Nd}}', '9', 'g') AS handle_shape, 'identity:' || identity AS node, 'identity' AS node_type, identity::VARCHAR AS node_key,
 'device_' || substr(sha256('device|' || device), 1, 16) AS device_token FROM ident""",
)
def p6(spark, d):
    node = M.node_id("identity", F.col("identity"))
    return A.identities(spark, d).select(
        "identity", M.thin_file(F.col("credit_months")).alias("thin_file"), F.round(M.credit_age_ratio(F.col("credit_months"), F.col("age")), 6).alias("credit_age_ratio"), M.handle_shape(F.col("handle")).alias("handle_shape"),
        node.alias("node"), M.node_type(node).alias("node_type"), M.node_key(node).alias("node_key"), M.opaque_token("device", F.col("device")).alias("device_token"),
    )


@query(
    "P11_label_delay",
    "SELECT l_orderkey * 16 + l_linenumber AS seq, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10, 6) AS delay_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def p11(spark, d):
    orders = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("e"))
    rows = A.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), F.round(M.label_delay_days(F.col("l_shipdate").cast("timestamp"), F.col("e")), 6).alias("delay_days"))


@query(
    "M3_M4_account_entropy_and_peak",
    f"""WITH {A.AUTH_SQL}, c AS (SELECT account, unnest(string_split(string_agg(suffix, ''), '')) AS g FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, seq) AS rn FROM auth) WHERE rn <= 400 GROUP BY account), k AS (SELECT account, g, count(*) AS n FROM c WHERE g <> '' GROUP BY ALL),
e AS (SELECT account, sum(n) AS t, sum(-(n::DOUBLE / s) * log2(n::DOUBLE / s)) / log2(10) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY account) AS s FROM k) GROUP BY account)
SELECT a.account, round(CASE WHEN any_value(t) < 4 THEN 1.0 ELSE any_value(h) END, 6) AS digit_entropy, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE count(*) / greatest((max(us) - min(us)) / 3.6e9, 1 / 60.0::DOUBLE) END, 6) AS peak_per_hour
FROM auth a JOIN e ON a.account = e.account GROUP BY a.account""",
)
def m3(spark, d):
    from ..operators.evidence import first_suffixes

    auth = A.auth_events(spark, d)
    g = auth.groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).join(first_suffixes(auth, "account").withColumnRenamed("_s", "s"), "account")
    return g.select("account", F.round(M.digit_entropy(F.col("s")), 6).alias("digit_entropy"), F.round(M.peak_hourly_rate(F.col("n"), F.col("a"), F.col("b")), 6).alias("peak_per_hour"))


@query(
    "M7_M8_M10_percentiles_kurtosis",
    f"""WITH {A.AUTH_SQL} SELECT merchant, count(*)::BIGINT AS n, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99, max(amount) AS most,
 round((list_sort(list(amount)))[least(count(*) - 1, floor(0.95 * count(*)))::INTEGER + 1], 6) AS nearest_p95, round(kurtosis(amount), 5) AS kurtosis FROM auth GROUP BY merchant""",
)
def m7(spark, d):
    n = F.count(F.lit(1))
    return A.auth_events(spark, d).groupBy("merchant").agg(
        n.alias("n"), *[F.round(F.percentile("amount", p / 100), 6).alias(f"p{p}") for p in (50, 95, 99)], F.max("amount").alias("most"),
        F.round(M.nearest_rank(F.collect_list("amount"), 95), 6).alias("nearest_p95"), F.round(M.kurtosis_corrected(n, F.kurtosis("amount")), 5).alias("kurtosis"),
    )


@query(
    "M5_M6_P13_tag_overlap",
    f"WITH {A.TAGS_SQL} SELECT a.identity AS l, b.identity AS r, round(len(list_intersect(a.indices, b.indices)) / (len(a.indices) + len(b.indices) - len(list_intersect(a.indices, b.indices)))::DOUBLE, 6) AS overlap, round((256 / 64.0::DOUBLE) / (32 - 256 / 64.0::DOUBLE), 6) AS chance, round(len(a.indices) / 64.0::DOUBLE, 6) AS sparsity FROM tags a JOIN tags b ON b.identity = a.identity + 1",
)
def m5(spark, d):
    t = A.tags(spark, d)
    tag = lambda: F.struct(F.lit(64).alias("dim"), F.col("indices"), F.lit("s").alias("seed_id"))
    a, b = t.select(F.col("identity").alias("l"), tag().alias("x")), t.select((F.col("identity") - 1).alias("l"), F.col("identity").alias("r"), tag().alias("y"))
    return a.join(b, "l").select("l", "r", F.round(M.tag_overlap(F.col("x"), F.col("y")), 6).alias("overlap"), F.round(M.chance_overlap(F.lit(64.0), F.lit(16.0)), 6).alias("chance"), F.round(M.sparsity(F.col("x")), 6).alias("sparsity"))


@query(
    "M9_severity",
    "SELECT p_partkey, round(CASE WHEN r >= 1 THEN r ELSE 1 / r END, 6) AS severity, round(least(1.0, log10(CASE WHEN r >= 1 THEN r ELSE 1 / r END) / 2), 6) AS width, (CASE WHEN r >= 1 THEN r ELSE 1 / r END) >= 3 AS is_verdict FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS r FROM part)",
)
def m9(spark, d):
    r = F.col("p_size") / F.lit(10.0)
    return A.table(spark, d, "part").select("p_partkey", F.round(M.severity(r), 6).alias("severity"), F.round(M.bar_width(r), 6).alias("width"), (M.severity(r) >= 3).alias("is_verdict"))


_SEASON = ", ".join(map(str, M.HOURLY)), ", ".join(map(str, M.DAILY))


@query("M11_seasonality", f"WITH {A.AUTH_SQL} SELECT seq, round(([{_SEASON[0]}])[hour(ts) + 1]::DOUBLE * ([{_SEASON[1]}])[isodow(ts)]::DOUBLE, 6) AS season FROM auth")
def m11(spark, d):
    return A.auth_events(spark, d).select("seq", F.round(M.seasonality(F.col("ts")), 6).alias("season"))


def _knob(name: str):
    low, high = M.KNOBS[name]
    return low + (high - low) * ((F.col("p_partkey") * (list(M.KNOBS).index(name) + 3) % 101) / F.lit(100.0))


def _cost_sql() -> str:
    parts = []
    for name, way in M.KNOB_COST.items():
        norm = f"(p_partkey * {list(M.KNOBS).index(name) + 3} % 101) / 100.0::DOUBLE"
        parts.append(f"(1 - {norm}) * {abs(way)}" if way < 0 else f"{norm} * {way}")
    return f"({' + '.join(parts)}) / {sum(map(abs, M.KNOB_COST.values()))}"


@query("M12_operator_cost", f"SELECT p_partkey, round({_cost_sql()}, 6) AS cost FROM part")
def m12(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.round(M.operator_cost(_knob), 6).alias("cost"))
