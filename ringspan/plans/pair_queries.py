"""Queries and SQL for pair joins, set operations and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import scalars as M
from ..operators import pairs as P

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def weighted(df):
    return df.withColumn("weight", F.round("weight", 6))


_J8 = " UNION ALL ".join(
    f"SELECT a.identity AS left, b.identity AS right, 'shared:{t}' AS kind, 1 / sqrt(n - 1) AS weight FROM ident a JOIN ident b ON a.{t} = b.{t} AND a.identity < b.identity JOIN (SELECT {t}, count(*) AS n FROM ident GROUP BY {t} HAVING count(*) BETWEEN 2 AND 60) g ON g.{t} = a.{t}"
    for t in P.TOKENS
).replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"')
_J9 = " UNION ALL ".join(
    f"""SELECT a.identity AS "left", b.identity AS "right", 'pii_recombination:{t}' AS kind, 1.0::DOUBLE AS weight FROM ident a JOIN ident b ON a.{t} = b.{t} AND a.identity < b.identity
 JOIN (SELECT {t} FROM ident GROUP BY {t} HAVING count(*) BETWEEN 2 AND 20 AND count(DISTINCT name) >= 2) g ON g.{t} = a.{t}"""
    for t in ("dob", "phone")
)
_SHAPE = "regexp_replace(regexp_replace(substr(handle, 1, 16), '\\p{L}', 'a', 'g'), '\\p{Nd}', '9', 'g')"
_J10 = f"""SELECT a.identity AS "left", b.identity AS "right", 'email_shape' AS kind, 0.35 * (1 - (n / t::DOUBLE) / 0.02) / sqrt(n - 1) AS weight FROM (SELECT identity, {_SHAPE} || dob % 5 AS s FROM ident) a
 JOIN (SELECT identity, {_SHAPE} || dob % 5 AS s FROM ident) b ON a.s = b.s AND a.identity < b.identity
 JOIN (SELECT {_SHAPE} || dob % 5 AS s, count(*) AS n FROM ident GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40) g ON g.s = a.s, (SELECT count(*) AS t FROM ident) WHERE n / t::DOUBLE <= 0.02"""


def _shape():
    return F.concat(M.handle_shape(F.col("handle")), (F.col("dob") % 5).cast("string"))


@query("J8_shared_token_pairs", f'WITH {A.IDENTITY_SQL} SELECT "left", "right", kind, round(weight, 6) AS weight FROM ({_J8})')
def j8(spark, d):
    return weighted(P.shared_tokens(A.identities(spark, d)))


@query("J9_pii_recombination_pairs", f"WITH {A.IDENTITY_SQL} {_J9}")
def j9(spark, d):
    return P.recombined(A.identities(spark, d))


@query("J10_handle_shape_pairs", f'WITH {A.IDENTITY_SQL} SELECT "left", "right", kind, round(weight, 6) AS weight FROM ({_J10})')
def j10(spark, d):
    return weighted(P.shared_shapes(A.identities(spark, d), _shape()))


@query(
    "J11_jaccard_pairs",
    f"""WITH {A.TAGS_SQL}, e AS (SELECT identity, unnest(indices) AS i FROM tags), c AS (SELECT a.identity AS l, b.identity AS r, count(*) AS k FROM e a JOIN e b ON a.i = b.i AND a.identity < b.identity GROUP BY ALL)
SELECT l AS "left", r AS "right", 'near_duplicate' AS kind, round(k / (32.0::DOUBLE - k), 6) AS weight FROM c WHERE k / (32.0::DOUBLE - k) >= 0.3""",
)
def j11(spark, d):
    return weighted(P.overlapping(A.tags(spark, d), 0.3))


_ALL = f"""{_J8} UNION ALL {_J9} UNION ALL {_J10}"""


_NEAR = """SELECT l AS "left", r AS "right", 'near_duplicate:' || kind AS kind, k / (32.0::DOUBLE - k) AS weight FROM (SELECT a.kind, a.identity AS l, b.identity AS r, count(*) AS k FROM ktags a JOIN ktags b ON a.kind = b.kind AND a.i = b.i AND a.identity < b.identity GROUP BY ALL)
 WHERE k / (32.0::DOUBLE - k) >= CASE kind """ + " ".join(f"WHEN '{k}' THEN {t}" for k, t in P.TAG_THRESHOLDS.items()) + " END"
_LINKS = f"{A.IDENTITY_SQL}, {A.TAG_KINDS_SQL}, links AS ({_ALL} UNION ALL {_NEAR})"


def plain_links(spark, d):
    people = A.identities(spark, d)
    return P.resolve(P.shared_tokens(people), P.recombined(people), P.shared_shapes(people, _shape()))


def near_links(spark, d):
    return {f"near_duplicate:{kind}": (tags, P.TAG_THRESHOLDS[kind]) for kind, tags in A.tag_kinds(spark, d).items()}


def all_links(spark, d):
    """All six producers of U1: tokens, recombined, shapes, and near duplicates of three kinds of tag."""
    return P.resolve(plain_links(spark, d), *[P.overlapping(tags, threshold, kind) for kind, (tags, threshold) in near_links(spark, d).items()])


def merged_links(spark, d, *more):
    """The same and ``more`` links, a row a pair."""
    return P.merged(P.resolve(plain_links(spark, d), *more), near_links(spark, d))


@query("U1_resolved_links", f"WITH {_LINKS} SELECT kind, count(*)::BIGINT AS links, round(sum(weight), 4) AS weight FROM links GROUP BY kind")
def u1(spark, d):
    return all_links(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    "J15_ring_link_summary",
    f"""WITH {_LINKS}, m AS (SELECT ring, identity FROM ident WHERE ring IS NOT NULL)
SELECT ring, kind, count(*)::BIGINT AS pairs FROM (SELECT DISTINCT a.ring, l."left", l."right", l.kind AS k, split_part(l.kind, ':', 1) AS kind FROM links l JOIN m a ON a.identity = l."left" JOIN m b ON b.identity = l."right" AND a.ring = b.ring) GROUP BY ring, kind""",
)
def j15(spark, d):
    return P.link_summary(all_links(spark, d), A.identities(spark, d).filter("ring IS NOT NULL").select("ring", "identity"))


@query(
    "J1_J4_truth_and_cohort_flags",
    f"""WITH {A.AUTH_SQL}, t AS (SELECT user_id AS account, min(ts) + INTERVAL 3 DAY AS first_fraud, user_id % 4 = 1 AS synthetic FROM events GROUP BY user_id)
SELECT seq, (synthetic AND ts >= first_fraud)::INTEGER AS y, auth.account IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS lookalike FROM auth JOIN t ON auth.account = t.account""",
)
def j1(spark, d):
    auth = A.auth_events(spark, d)
    truth = auth.groupBy("account").agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("first_fraud")).withColumn("synthetic", F.col("account") % 4 == 1)
    poor = A.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("account"), F.lit(True).alias("_l")).distinct()
    out = auth.join(truth, "account").join(poor, "account", "left")
    return out.select("seq", (F.col("synthetic") & (F.col("ts") >= F.col("first_fraud"))).cast("int").alias("y"), F.coalesce("_l", F.lit(False)).alias("lookalike"))


@query(
    "J2_J3_score_joins",
    f"""WITH {A.SCORED_SQL}, a AS (SELECT doc_id, score FROM scored), b AS (SELECT doc_id, scoped FROM scored WHERE doc_id % 3 <> 0)
SELECT a.doc_id, round(a.score, 6) AS own, round(coalesce(b.scoped, 0), 6) AS onboarding, CASE WHEN b.doc_id IS NULL THEN NULL ELSE a.doc_id % 4 END AS ring FROM a LEFT JOIN b ON a.doc_id = b.doc_id""",
)
def j2(spark, d):
    s = A.scored(spark, d)
    b = s.filter("doc_id % 3 <> 0").select("doc_id", "scoped", (F.col("doc_id") % 4).alias("ring"))
    return s.select("doc_id", F.round("score", 6).alias("own")).join(b, "doc_id", "left").select("doc_id", "own", F.round(F.coalesce("scoped", F.lit(0.0)), 6).alias("onboarding"), "ring")


@query(
    "J5_J6_U2_U4_set_operations",
    f"""WITH {A.IDENTITY_SQL}, f AS (SELECT identity FROM ident WHERE device < 60), s AS (SELECT identity FROM ident WHERE is_synthetic)
SELECT 'rest' AS what, count(*)::BIGINT AS n FROM ident WHERE identity NOT IN (SELECT identity FROM s) UNION ALL SELECT 'flagged minus seeds', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM s) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM s)""",
)
def j5(spark, d):
    p = A.identities(spark, d)
    f, s = p.filter("device < 60").select("identity"), p.filter("is_synthetic").select("identity")
    n = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return n(p.join(s, "identity", "left_anti"), "rest").union(n(f.exceptAll(s).distinct(), "flagged minus seeds")).union(n(f.intersect(s), "both"))


@query(
    "J12_G4_projection",
    f"""WITH {A.EDGES_SQL}, o AS (SELECT DISTINCT identity, attribute, kind FROM edges), g AS (SELECT kind, attribute, count(*) AS n FROM o GROUP BY ALL HAVING count(*) BETWEEN 2 AND 60),
w AS (SELECT kind, attribute, n, CASE kind WHEN 'device' THEN 1.0 WHEN 'address' THEN 0.7 WHEN 'phone' THEN 0.6 WHEN 'email' THEN 0.6 ELSE 0.4 END / sqrt(n - 1) AS w FROM g)
SELECT a.identity AS "left", b.identity AS "right", round(sum(w), 6) AS weight, count(*)::BIGINT AS shared FROM o a JOIN o b ON a.attribute = b.attribute AND a.kind = b.kind AND a.identity < b.identity JOIN w ON w.kind = a.kind AND w.attribute = a.attribute GROUP BY ALL""",
)
def j12(spark, d):
    from ..operators import graph as G

    out = G.project(A.attribute_edges(spark, d))
    return out.select("left", "right", F.round("weight", 6).alias("weight"), F.aggregate(F.map_values("tags"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("shared"))


@query(
    "J14_state_in_effect",
    f"""WITH {A.AUTH_SQL}, c AS (SELECT account, us, seq, device + 1000 * (seq % 7) AS device FROM auth WHERE seq % 5 = 0)
SELECT seq, (SELECT arg_max(c.device, (c.us, c.seq)) FROM c WHERE c.account = auth.account AND c.us <= auth.us) AS device FROM auth""",
)
def j14(spark, d):
    """The last change at or before each event: one union and one running window, no range join."""
    auth = A.auth_events(spark, d)
    changes = auth.filter("seq % 5 = 0").select("account", "us", "seq", (F.col("device") + 1000 * (F.col("seq") % 7)).alias("new"), F.lit(0).alias("kind"))
    both = auth.select("account", "us", "seq", F.lit(None).cast("bigint").alias("new"), F.lit(1).alias("kind")).unionByName(changes)
    w = Window.partitionBy("account").orderBy("us", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("device", F.last("new", ignorenulls=True).over(w)).filter("kind = 1").select("seq", "device")


@query("K1_order_by_time_and_availability", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::BIGINT AS by_time, row_number() OVER (ORDER BY l_receiptdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::BIGINT AS by_availability FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_shipdate + INTERVAL (20 + (l_orderkey * 7 + l_linenumber) % 41) DAY AS l_receiptdate FROM lineitem)")
def k1(spark, d):
    """Labels in order of their events' time and of when they became available (20 to 60 days later), each a place in a
    total order, by ranges."""
    from ..operators.ordered import places

    tie = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # numbers of lines repeat
    wait = (20 + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 41).cast("int")
    rows = A.table(spark, d, "lineitem").select(*tie, F.col("l_shipdate").cast("date").alias("at")).withColumn("available", F.date_add("at", wait))
    first = places(rows, ("at", *tie), "by_time")
    return places(first, ("available", *tie), "by_availability").select("l_orderkey", "l_linenumber", "by_time", "by_availability")


@query("K3_A15_top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 AND o_totalprice >= 1000")
def k3(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return A.table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3 AND o_totalprice >= 1000").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "K4_K8_array_top_and_distinct",
    """SELECT vec_id, (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM (SELECT i FROM (SELECT unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x) ORDER BY x DESC, i LIMIT 8)) AS winners FROM embeddings""",
)
def k4(spark, d):
    from ..functions.sketches import winners

    return A.table(spark, d, "embeddings").select("vec_id", F.array_join(F.array_sort(winners(F.transform("embedding", lambda x: x.cast("double")), 8)).cast("array<string>"), ",").alias("winners"))


@query("K7_seed_per_ring", f"WITH {A.IDENTITY_SQL} SELECT ring, arg_min(identity, (liveness, identity)) AS seed FROM ident WHERE is_synthetic GROUP BY ring")
def k7(spark, d):
    return A.identities(spark, d).filter("is_synthetic").groupBy("ring").agg(F.min_by("identity", F.struct("liveness", "identity")).alias("seed"))


@query(
    "K9_evidence_order",
    f"""WITH {A.IDENTITY_SQL}, r AS (SELECT segment, ring, count(*) AS n, avg(credit_months) / 120.0 AS ratio FROM ident WHERE ring IS NOT NULL GROUP BY ALL), s AS (SELECT *, CASE WHEN ratio >= 1 THEN ratio ELSE 1 / ratio END AS sev, ratio > 1 AS elevated FROM r)
SELECT segment, max(round(sev, 6)) AS peak, sum(elevated::INTEGER)::BIGINT AS elevated, count(*)::BIGINT AS scored FROM s GROUP BY segment""",
)
def k9(spark, d):
    r = A.identities(spark, d).filter("ring IS NOT NULL").groupBy("segment", "ring").agg((F.avg("credit_months") / 120).alias("ratio"))
    return r.groupBy("segment").agg(F.max(F.round(M.severity(F.col("ratio")), 6)).alias("peak"), F.sum((F.col("ratio") > 1).cast("long")).alias("elevated"), F.count(F.lit(1)).alias("scored"))


@query("U3_P15_institutions", "SELECT l_partkey % 50 AS community, array_to_string(list_sort(list(DISTINCT l_suppkey % 6)), ',') AS institutions, count(DISTINCT l_suppkey % 6) > 1 AS crosses FROM lineitem GROUP BY 1")
def u3(spark, d):
    held = A.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("community")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 6)).alias("institutions"))
    return held.select("community", F.array_join(F.col("institutions").cast("array<string>"), ",").alias("institutions"), M.cross_institution(F.col("institutions")).alias("crosses"))
