"""URL filters by a temporal list join.

Dated list entries (add or remove) become validity intervals per list and key; every capture is evaluated against the
entries active when it was fetched. Intervals are laid out by 32-day periods, so that the join is an equi-join on
(key, period) with the exact bounds as residual: a key with a long history costs each capture only its period. A
common host meets few interval rows and is split by period, and further by Spark's skew join; a list of few interval
periods (counted first) is broadcast. An entry that was never removed has no end.

A capture's keys are its host, every parent domain of two labels or more, and host plus first path segment. An IPv4
address or a bracketed IPv6 address is one label: it has no parent domains. The most
specific key with an active entry decides; there an ``allow`` entry beats a ``block`` entry.

Edge cases: entries of one key, list and date apply removal first, then addition; an addition while active and a
removal while inactive change nothing; entries without key or date are ignored. A capture without url, host or fetch
date has the verdict ``none``. Repeated captures each get their row. Extra columns are ignored. Empty tables give
empty results, or ``none`` for every capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

PERIOD_DAYS = 32
SMALL_LIST = 100_000
EPOCH = "2024-01-01"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:]+)"
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, key, action ('add' or 'remove'), at (date). Gives list, key, valid_from, valid_to (exclusive,
    null while active)."""
    named = entries.select("list", "key", F.col("at").cast("date").alias("at"), (F.col("action") == "add").alias("on")).filter("key IS NOT NULL AND at IS NOT NULL AND on IS NOT NULL")
    day = named.groupBy("list", "key", "at").agg(F.max("on").alias("on"))  # removal first, then addition
    w = Window.partitionBy("list", "key").orderBy("at")
    turns = day.withColumn("_before", F.lag("on").over(w)).filter(~F.col("on").eqNullSafe(F.col("_before")))
    ends = turns.withColumn("valid_to", F.lead("at").over(w))
    return ends.filter("on").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def period(day) -> F.Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / PERIOD_DAYS).cast("int")


def host_keys(url) -> F.Column:
    """Array of (key, rank) of a URL: rank is the number of host labels, or 100 for host plus path segment."""
    host = F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))
    labels = F.when(F.regexp_like(host, F.lit(ADDRESS)), F.array(host)).otherwise(F.filter(F.split(host, r"\."), lambda x: x != ""))
    n = F.size(labels)
    tails = F.when(n >= 2, F.transform(F.sequence(F.lit(2), n), lambda k: F.struct(F.array_join(F.slice(labels, n - k + 1, k), ".").alias("key"), k.alias("rank"))))
    alone = F.when((n == 1), F.array(F.struct(host.alias("key"), F.lit(1).alias("rank"))))
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)
    path = F.when((n > 0) & (segment != ""), F.array(F.struct(F.concat_ws("/", host, segment).alias("key"), F.lit(100).alias("rank"))))
    none = F.array().cast("array<struct<key:string,rank:int>>")
    return F.concat(F.coalesce(tails, alone, none), F.coalesce(path, none))


def evaluate(captures: DataFrame, listed: DataFrame, small: int = SMALL_LIST) -> DataFrame:
    """captures: page_id, url, fetched (date); listed: what :func:`intervals` gives. One row per capture: page_id,
    fetched, verdict, matched_key, n_active (entries active on any of its keys), listed_since."""
    # only the periods in which anything was fetched are laid out
    low, high = captures.agg(F.min(period(F.col("fetched").cast("date"))), F.max(period(F.col("fetched").cast("date")))).first()
    low, high = F.lit(low or 0), F.lit(high or 0)
    start, end = F.greatest(period("valid_from"), low), F.least(F.coalesce(period(F.date_sub("valid_to", 1)), high), high)
    active = listed.filter("valid_from < valid_to OR valid_from IS NOT NULL AND valid_to IS NULL")
    few = (active.agg(F.sum(F.greatest(F.lit(0), end - start + 1))).first()[0] or 0) <= small
    laid = active.withColumn("_p", F.explode(F.when(start <= end, F.sequence(start, end))))
    rows = captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched"), F.monotonically_increasing_id().alias("_row"))
    keyed = rows.select("_row", "page_id", "fetched", F.inline_outer(host_keys(F.col("url")))).withColumn("_p", period("fetched"))
    laid = laid.select(F.col("key").alias("_k"), F.col("_p").alias("_q"), "list", "valid_from", "valid_to")
    on = (keyed["key"] == laid["_k"]) & (keyed["_p"] == laid["_q"]) & (keyed["fetched"] >= laid["valid_from"]) & (laid["valid_to"].isNull() | (keyed["fetched"] < laid["valid_to"]))
    met = keyed.join(F.broadcast(laid) if few else laid, on, "left")
    best = F.struct(F.col("rank").alias("r"), F.when(F.col("list") == "allow", 1).otherwise(0).alias("a"), F.col("key").alias("k"), F.col("list").alias("l"), F.col("valid_from").alias("f"))
    out = met.groupBy("_row", "page_id", "fetched").agg(F.max(F.when(F.col("list").isNotNull(), best)).alias("b"), F.count("list").alias("n_active"))
    return out.select("page_id", "fetched", F.coalesce("b.l", F.lit("none")).alias("verdict"), F.col("b.k").alias("matched_key"), "n_active", F.col("b.f").alias("listed_since"))


def fetched_on(page_id) -> F.Column:
    """The tables carry no fetch date: one of the days of 2024, from the id."""
    return F.date_add(F.lit(EPOCH).cast("date"), ((page_id * 37) % 365).cast("int"))


def entries_of(pages: DataFrame) -> DataFrame:
    """The tables carry no list either: a dated history of additions and removals for two in three of all keys that
    occur, drawn from the key's MD5."""
    keys = pages.select(F.explode(host_keys(F.col("url"))).alias("k")).select("k.key").distinct()
    n = F.conv(F.substr(F.md5("key"), F.lit(1), F.lit(6)), 16, 10).cast("long")
    drawn = keys.withColumn("n", n).filter("n % 3 <> 0").withColumn("list", F.when(F.col("n") % 4 == 1, "allow").otherwise("block"))
    event = lambda action, day, when: F.when(when, F.struct(F.lit(action).alias("action"), F.date_add(F.lit(EPOCH).cast("date"), day.cast("int")).alias("at")))
    first, gone = F.col("n") % 200, 20 + F.floor(F.col("n") / 7) % 90
    events = F.array_compact(F.array(event("add", first, F.lit(True)), event("remove", first + gone, F.col("n") % 2 == 0), event("add", first + 150, F.col("n") % 5 == 0)))
    return drawn.select("list", "key", F.inline(events))


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = written(intervals(entries_of(pages)), "url-list")
    found = evaluate(pages.withColumn("fetched", fetched_on(F.col("page_id"))), listed)
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed_since")})


ORACLE = {"op4_url_filters": rf"""
WITH u AS (SELECT page_id, url, (DATE '{EPOCH}' + ((page_id * 37) % 365)::INTEGER)::DATE AS fetched, row_number() OVER () AS rn,
  rtrim(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '.') AS host,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg FROM pages),
l AS (SELECT *, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [host] ELSE list_filter(string_split(host, '.'), lambda x: x <> '') END AS ls FROM u),
k AS (SELECT rn, array_to_string(ls[len(ls) - r + 1:], '.') AS key, r AS rank FROM (SELECT rn, ls, unnest(range(2, len(ls) + 1)) AS r FROM l)
  UNION ALL SELECT rn, host, 1 FROM l WHERE len(ls) = 1
  UNION ALL SELECT rn, host || '/' || seg, 100 FROM l WHERE len(ls) > 0 AND seg <> ''),
n AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS n FROM (SELECT DISTINCT key FROM k)),
d AS (SELECT key, n, CASE WHEN n % 4 = 1 THEN 'allow' ELSE 'block' END AS list FROM n WHERE n % 3 <> 0),
e AS (SELECT list, key, TRUE AS act, DATE '{EPOCH}' + (n % 200)::INTEGER AS dt FROM d
  UNION ALL SELECT list, key, FALSE, DATE '{EPOCH}' + (n % 200 + 20 + (n // 7) % 90)::INTEGER FROM d WHERE n % 2 = 0
  UNION ALL SELECT list, key, TRUE, DATE '{EPOCH}' + (n % 200 + 150)::INTEGER FROM d WHERE n % 5 = 0),
g AS (SELECT list, key, dt, bool_or(act) AS act FROM e GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, lag(act) OVER w AS before FROM g WINDOW w AS (PARTITION BY list, key ORDER BY dt)) WHERE before IS NULL OR before <> act),
i AS (SELECT list, key, dt AS valid_from, valid_to FROM (SELECT *, lead(dt) OVER (PARTITION BY list, key ORDER BY dt) AS valid_to FROM t) WHERE act),
m AS (SELECT l.rn, l.page_id, l.fetched, k.key, k.rank, i.list, i.valid_from FROM l LEFT JOIN k ON k.rn = l.rn LEFT JOIN i ON i.key = k.key AND l.fetched >= i.valid_from AND (i.valid_to IS NULL OR l.fetched < i.valid_to)),
b AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY (list IS NOT NULL) DESC, rank DESC, (list = 'allow') DESC, key DESC, valid_from DESC) AS o, count(list) OVER (PARTITION BY rn) AS c FROM m)
SELECT page_id, fetched::VARCHAR AS fetched, coalesce(list, 'none') AS verdict, CASE WHEN list IS NOT NULL THEN key END AS matched_key, c::BIGINT AS n_active, valid_from::VARCHAR AS listed_since FROM b WHERE o = 1"""}
