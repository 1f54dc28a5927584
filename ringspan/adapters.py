"""The driver's tables in the roles of the event streams. Every value is a fixed expression of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as authorisations: no two rows of an account share a time."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda m, values, rest: F.coalesce(*[F.when(F.col("event_id") % m == i, F.lit(v)) for i, v in enumerate(values)], F.lit(rest))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("account"), F.concat(F.lit("m"), F.col("event_type")).alias("merchant"), k.alias("card"), F.lpad((k * 9973 % 1000000).cast("string"), 6, "0").alias("suffix"),
        F.col("value").alias("amount"), (F.col("value") < 10).alias("zero_auth"), F.when(F.col("event_type") == "error", "declined_do_not_honor").otherwise("approved").alias("response_code"),
        pick(7, ["no_match", "unavailable", "partial"], "match").alias("avs_result"), pick(5, ["no_match", "not_provided"], "match").alias("cvv_result"),
        (F.col("user_id") % 40).alias("device"), (F.col("event_id") % 97).alias("ip"), (F.col("user_id") % 6).alias("institution"),
    )


AUTH_SQL = """auth AS (SELECT event_id AS seq, ts, epoch_us(ts) AS us, user_id AS account, 'm' || event_type AS merchant, (props->>'$.k')::INTEGER AS card,
 lpad(((props->>'$.k')::INTEGER * 9973 % 1000000)::VARCHAR, 6, '0') AS suffix, value AS amount, value < 10 AS zero_auth,
 CASE WHEN event_type = 'error' THEN 'declined_do_not_honor' ELSE 'approved' END AS response_code,
 CASE event_id % 7 WHEN 0 THEN 'no_match' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'partial' ELSE 'match' END AS avs_result,
 CASE event_id % 5 WHEN 0 THEN 'no_match' WHEN 1 THEN 'not_provided' ELSE 'match' END AS cvv_result,
 user_id % 40 AS device, event_id % 97 AS ip, user_id % 6 AS institution FROM events)"""


def from_stream(auth: DataFrame) -> DataFrame:
    """A stored or generated ``auth_events`` stream under the names that windows and rollups use."""
    return auth.select(
        F.xxhash64("event_id").alias("seq"), "ts", F.unix_micros("ts").alias("us"), F.col("account_id").alias("account"), F.col("merchant_id").alias("merchant"), F.col("card_token").alias("card"), F.col("pan_suffix6").alias("suffix"), "amount",
        F.col("is_zero_auth").alias("zero_auth"), "response_code", "avs_result", "cvv_result", F.col("device_id").alias("device"), F.col("ip_id").alias("ip"), F.col("institution_id").alias("institution"),
    )


def auth_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with orders as authorisations of day grain: many ties."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_custkey").alias("account"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"),
        F.col("l_suppkey").alias("merchant"), F.col("l_partkey").alias("card"), F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") == "R").alias("is_declined"),
        F.col("c_nationkey").alias("institution"), ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("seq"),
    )


ORDERS_SQL = """auth AS (SELECT o_custkey AS account, l_shipdate AS ts, epoch_us(l_shipdate) AS us, l_suppkey AS merchant, l_partkey AS card, l_extendedprice AS amount,
 l_returnflag = 'R' AS is_declined, c_nationkey AS institution, (l_orderkey * 16 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as applications: identity and its tokens. Group sizes straddle the guards 2, 20, 40 and 60."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("identity"), (c % 211).alias("device"), F.col("c_nationkey").cast("bigint").alias("address"), (c % 331).alias("phone"), (c % 401).alias("dob"), (c % 97).alias("ip"),
        (c % 503).alias("email"), (c % 7).alias("name"), (c % 6).alias("institution"), F.col("c_mktsegment").alias("segment"),
        F.concat(F.substr(F.lower("c_mktsegment"), F.lit(1), (c % 5 + 2).cast("int")), F.lit("."), (c % 1000).cast("string")).alias("handle"),
        (18 + c % 60).cast("int").alias("age"), (c * 7 % 240).cast("int").alias("credit_months"), ((c * 31 % 1000) / 1000).alias("liveness"), F.col("c_acctbal").alias("kurtosis"),
        (c % 25 == 3).alias("is_synthetic"), F.when(c % 25 == 3, c % 4).alias("ring"),
    )


IDENTITY_SQL = """ident AS (SELECT c_custkey AS identity, c_custkey % 211 AS device, c_nationkey::BIGINT AS address, c_custkey % 331 AS phone, c_custkey % 401 AS dob, c_custkey % 97 AS ip,
 c_custkey % 503 AS email, c_custkey % 7 AS name, c_custkey % 6 AS institution, c_mktsegment AS segment,
 substr(lower(c_mktsegment), 1, (c_custkey % 5 + 2)::INTEGER) || '.' || (c_custkey % 1000)::VARCHAR AS handle,
 (18 + c_custkey % 60)::INTEGER AS age, (c_custkey * 7 % 240)::INTEGER AS credit_months, (c_custkey * 31 % 1000) / 1000.0::DOUBLE AS liveness, c_acctbal AS kurtosis,
 c_custkey % 25 = 3 AS is_synthetic, CASE WHEN c_custkey % 25 = 3 THEN c_custkey % 4 END AS ring FROM customer)"""


def attribute_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as identity (supplier) to attribute (part) edges, typed by the part's size."""
    kinds = F.array(*[F.lit(k) for k in ("device", "address", "phone", "email", "ip_asn")])
    part = table(spark, sf_dir, "part").select("p_partkey", F.get(kinds, F.col("p_size") % 5).alias("kind"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_suppkey").alias("identity"), F.col("l_partkey").alias("attribute"), "kind", (F.col("l_suppkey") % 6).alias("institution"), F.col("l_orderkey").alias("seq"))


EDGES_SQL = """edges AS (SELECT l_suppkey AS identity, l_partkey AS attribute, (['device', 'address', 'phone', 'email', 'ip_asn'])[p_size % 5 + 1] AS kind, l_suppkey % 6 AS institution, l_orderkey AS seq
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as sparse tags: the dimensions above 1 in units of the vector's mean square, at most 16 of 64."""
    at = lambda e: F.transform(e, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("i")))
    top = F.slice(F.array_sort(at(F.col("embedding"))), 1, 16)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("identity"), F.array_sort(F.transform(top, lambda s: s["i"])).alias("indices"), "label")


TAGS_SQL = """tags AS (SELECT vec_id AS identity, list_sort(list(i)) AS indices, any_value(label) AS label FROM
 (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (SELECT vec_id, label, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)) WHERE r <= 16 GROUP BY vec_id)"""


def tag_kinds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """embeddings joined by id as the three tags of an identity, 16 of 64 dimensions each: the largest (face), the least
    (doc_template) and those of largest size (hypervector)."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"))

    def of(order):
        top = F.slice(F.array_sort(F.transform("embedding", lambda x, i: F.struct(order(x.cast("double")).alias("v"), i.alias("i")))), 1, 16)
        return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("identity"), F.array_sort(F.transform(top, lambda s: s["i"])).alias("indices")).join(ids, "identity")

    return {"face": of(lambda x: -x), "doc_template": of(lambda x: x), "hypervector": of(lambda x: -F.abs(x))}


TAG_KINDS_SQL = """ktags AS (SELECT kind, identity, i FROM (SELECT kind, identity, i, row_number() OVER (PARTITION BY kind, identity ORDER BY v, i) AS r FROM (SELECT k AS kind, vec_id AS identity, i, CASE k WHEN 'face' THEN -x WHEN 'doc_template' THEN x ELSE -abs(x) END AS v
 FROM (SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), (SELECT unnest(['face', 'doc_template', 'hypervector']) AS k))) JOIN customer ON c_custkey = identity WHERE r <= 16)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with documents: y, and a score with ties that leans towards y."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("toxic").cast("int").alias("y"), ((F.col("doc_id") * 37 % 101 + F.col("toxic") * 30) / 131).alias("score"), ((F.col("doc_id") * 53 % 89 + F.col("toxic") * 25) / 114).alias("scoped"),
        "n_chars", "source", "lang", (F.col("doc_id") % 29).alias("account"), (F.col("quality") == 1).alias("thin"), (F.col("doc_id") % 17 == 0).alias("lookalike"),
    )


SCORED_SQL = """scored AS (SELECT l.doc_id, toxic::INTEGER AS y, (l.doc_id * 37 % 101 + toxic * 30) / 131.0::DOUBLE AS score, (l.doc_id * 53 % 89 + toxic * 25) / 114.0::DOUBLE AS scoped,
 n_chars, source, lang, l.doc_id % 29 AS account, quality = 1 AS thin, l.doc_id % 17 = 0 AS lookalike FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
