"""Trailing-window features of authorisation streams.

A row sees the rows of its key that were processed before it and lie within the span, its own time excluded or, with
ties, only those of lower ``seq``. One exchange and sort a key serve all spans. Views are scoped by adding their
column to the key, so no view costs a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as M


def trailing(keys: list[str], seconds: int) -> Window:
    """Frame [t - span, t) on microseconds: exact where a key has no two rows of one time."""
    return Window.partitionBy(*keys).orderBy("us").rangeBetween(-seconds * 1_000_000, -1)


def tie_safe(keys: list[str], seconds: int, fields: dict[str, Column]) -> Column:
    """The earlier rows within the span, ties of lower ``seq`` included, as an array of structs."""
    rows = F.collect_list(F.struct(F.col("us").alias("_us"), F.col("seq").alias("_seq"), *[c.alias(k) for k, c in fields.items()])).over(Window.partitionBy(*keys).orderBy("us").rangeBetween(-seconds * 1_000_000, 0))
    return F.filter(rows, lambda r: (r["_us"] < F.col("us")) | (r["_seq"] < F.col("seq")))


def sliced(auth: DataFrame, seconds: int) -> DataFrame:
    """Splits every key's history into slices of the longest span, for keys too hot for one task: a row is in its own
    slice and, as context, in the next. Put ``_slice`` among the keys, and drop ``_context`` rows after the windows. Exact
    for spans up to ``seconds``."""
    width = F.floor(F.col("us") / F.lit(seconds * 1_000_000)).cast("long")
    both = F.array(F.struct(width.alias("_slice"), F.lit(False).alias("_context")), F.struct((width + 1).alias("_slice"), F.lit(True).alias("_context")))
    return auth.select("*", F.inline(both))


def account_features(auth: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """W1-W7 with every key's history split by weeks."""
    by = (*keys, "_slice")
    rows = sliced(flags(auth), max(M.SPANS.values()))
    return rows.withColumns({**account_windows(rows, by), **testing_signals(by)}).filter("NOT _context").drop("_slice", "_context")


def flags(auth: DataFrame) -> DataFrame:
    return auth.withColumns({
        "f_decline": M.declined(F.col("response_code")).cast("double"), "f_zero_auth": F.col("zero_auth").cast("double"), "f_cvv_bad": M.cvv_bad(F.col("cvv_result")).cast("double"),
        "f_avs_bad": M.avs_bad(F.col("avs_result")).cast("double"), "f_low_ticket": M.low_ticket(F.col("amount")).cast("double"),
    })


FLAGS = ("decline", "zero_auth", "cvv_bad", "avs_bad", "low_ticket")


def ratio(name: str, w) -> Column:
    return F.coalesce(F.avg(f"f_{name}").over(w), F.lit(0.0))


def account_windows(auth: DataFrame, keys: tuple[str, ...] = ("account",)) -> dict[str, Column]:
    """W1-W4 for the four spans."""
    out = {}
    for name, seconds in M.SPANS.items():
        w = trailing(list(keys), seconds)
        out[f"acct_n_{name}"] = F.count(F.lit(1)).over(w)
        out |= {f"acct_{f}_ratio_{name}": ratio(f, w) for f in FLAGS}
        out[f"acct_distinct_pans_{name}"] = F.size(F.collect_set("card").over(w)).cast("long")
        out[f"acct_distinct_merchants_{name}"] = F.size(F.collect_set("merchant").over(w)).cast("long")
        out[f"acct_mean_amount_{name}"] = F.coalesce(F.avg("amount").over(w), F.lit(0.0))
    return out


def testing_signals(keys: tuple[str, ...] = ("account",)) -> dict[str, Column]:
    """W5-W7 over one hour."""
    w = trailing(list(keys), 3600)
    return {
        "acct_pan_entropy_1h": M.pan_entropy(F.collect_list("suffix").over(w)), "acct_timing_cv_1h": M.timing_regularity(F.collect_list(F.col("us") / 1e6).over(w)),
        "acct_pans_per_merchant_1h": F.size(F.collect_set("card").over(w)) / F.greatest(F.lit(1), F.size(F.collect_set("merchant").over(w))),
    }


def entity_windows(slices: tuple[str, ...] = ()) -> dict[str, Column]:
    """By device and by address, one hour; ``slices`` are added to either key."""
    out = {}
    for key in ("device", "ip"):
        w = trailing([key, *slices], 3600)
        out |= {f"{key}_n_1h": F.count(F.lit(1)).over(w), f"{key}_distinct_pans_1h": F.size(F.collect_set("card").over(w)).cast("long"), f"{key}_decline_ratio_1h": ratio("decline", w)}
    return out


def in_slices(auth: DataFrame, seconds: int, features) -> DataFrame:
    """The input's rows with ``features(slices)`` (name -> column), every key's history split into slices of ``seconds``."""
    return sliced(auth, seconds).withColumns(features(("_slice",))).filter("NOT _context").drop("_slice", "_context")


def with_novelty(auth: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """Days since the key's first authorisation, whether the merchant is new to it, and how many it knew. First
    times are grouped and joined back; merchants known are counted within weeks, to which those of earlier weeks, a row a
    key and week, are added: no task holds all of a hot key's history."""
    now, week = F.struct("us", "seq"), F.floor(F.col("us") / F.lit(max(M.SPANS.values()) * 1_000_000)).cast("long")
    pair = tuple(dict.fromkeys((*keys, "merchant")))
    firsts = auth.groupBy(*pair).agg(F.min(now).alias("_first"))
    starts = firsts.groupBy(*keys).agg(F.min("_first.us").alias("_start"))
    flagged = null_safe(auth, firsts, pair).withColumns({"acct_is_new_merchant": (now == F.col("_first")).cast("int"), "_week": week}).drop("_first")
    weeks = flagged.groupBy(*keys, "_week").agg(F.sum("acct_is_new_merchant").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_week").rowsBetween(Window.unboundedPreceding, -1)
    offsets = weeks.select(*keys, "_week", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_week").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = null_safe(null_safe(flagged.withColumn("_own", F.coalesce(F.sum("acct_is_new_merchant").over(own), F.lit(0))), offsets, (*keys, "_week")), starts, keys)
    out = counted.withColumns({"acct_age_days": (F.col("us") - F.col("_start")) / F.lit(8.64e10), "acct_known_merchants": F.col("_own") + F.col("_before")})
    return out.drop("_week", "_own", "_before", "_start")


def null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Inner join on keys that may be null; the left's columns, then the right's own."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def own_event() -> dict[str, Column]:
    """W12"""
    return {"is_zero_auth": F.col("f_zero_auth"), "cvv_bad": F.col("f_cvv_bad"), "avs_bad": F.col("f_avs_bad"), "hour_of_day": M.hour_of_day(F.col("ts")), "day_of_week": M.day_of_week(F.col("ts"))}


def stream_features(auth: DataFrame, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """All 54 features of every event, by its keys; the input's columns stay."""
    return in_slices(with_novelty(account_features(auth, keys), keys), 3600, entity_windows).withColumns(own_event())


FEATURES = sorted(
    [f"acct_{s}_{w}" for w in M.SPANS for s in ("n", *[f"{f}_ratio" for f in FLAGS], "distinct_pans", "distinct_merchants", "mean_amount")]
    + ["acct_pan_entropy_1h", "acct_timing_cv_1h", "acct_pans_per_merchant_1h", "acct_age_days", "acct_is_new_merchant", "acct_known_merchants", "amount"]
    + [f"{k}_{s}_1h" for k in ("device", "ip") for s in ("n", "distinct_pans", "decline_ratio")]
    + ["is_zero_auth", "cvv_bad", "avs_bad", "hour_of_day", "day_of_week"]
)
