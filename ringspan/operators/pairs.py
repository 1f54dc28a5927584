"""Pair joins of entity resolution (J8-J12, J15) and their union.

The size guards are part of the semantics. They are applied to counted groups before any pair is made, so a common token
costs one count and pairs grow with the guard, not with the group. Pairs come from a self-join on the token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import in_cells
from .storage import written

#: Guards, thresholds and weights of the link producers.
TOKENS = ("device", "address", "phone", "email", "ip")
TOKEN_GROUP, PII_GROUP, SHAPE_GROUP, SHAPE_SHARE, SHAPE_WEIGHT = (2, 60), (2, 20), (2, 40), 0.02, 0.35
TAG_THRESHOLDS = {"face": 0.50, "doc_template": 0.70, "hypervector": 0.30}
#: Identity edges of one pair take the type of the producer that comes first.
PRIORITY = ("shared", "pii_recombination", "email_shape", "near_duplicate")


def guarded_pairs(rows: DataFrame, key: str, member: str, low: int, high: int, extra: dict[str, Column] | None = None, having: Column | None = None) -> DataFrame:
    """left < right within each group of ``key`` whose count of rows lies in [low, high]; carries the count as ``n`` and
    the group's ``extra`` aggregates."""
    extra = extra or {}
    groups = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()]).filter(F.col("n").between(low, high))
    groups = groups.filter(having) if having is not None else groups
    kept = rows.select(key, member).join(groups, key)
    right = kept.select(key, F.col(member).alias("right"))
    return kept.withColumnRenamed(member, "left").join(right, key).filter("left < right").select("left", "right", key, "n", *extra)


def shared_tokens(people: DataFrame, group: tuple[int, int] = TOKEN_GROUP) -> DataFrame:
    """One link per shared token, weight 1 / sqrt(n - 1)."""
    made = [guarded_pairs(people, t, "identity", *group).select("left", "right", F.lit(f"shared:{t}").alias("kind"), (1 / F.sqrt(F.col("n") - 1)).alias("weight")) for t in TOKENS]
    return reduce(DataFrame.unionByName, made)


def recombined(people: DataFrame, group: tuple[int, int] = PII_GROUP) -> DataFrame:
    """A birth date or phone under two names or more links all its holders, same names too."""
    made = [
        guarded_pairs(people, t, "identity", *group, extra={"names": F.size(F.collect_set("name"))}, having=F.col("names") >= 2).select("left", "right", F.lit(f"pii_recombination:{t}").alias("kind"), F.lit(1.0).alias("weight"))
        for t in ("dob", "phone")
    ]
    return reduce(DataFrame.unionByName, made)


def shared_shapes(people: DataFrame, shape: Column, group: tuple[int, int] = SHAPE_GROUP, share: float = SHAPE_SHARE) -> DataFrame:
    """Rare handle shapes; weight falls with the share of all applicants and with the group."""
    shaped = people.select("identity", shape.alias("shape"))
    total = shaped.agg(F.count(F.lit(1)).alias("total"))
    pairs = guarded_pairs(shaped, "shape", "identity", *group).crossJoin(F.broadcast(total))  # one row
    of = F.col("n") / F.col("total")
    return pairs.filter(of <= share).select("left", "right", F.lit("email_shape").alias("kind"), (SHAPE_WEIGHT * (1 - of / share) / F.sqrt(F.col("n") - 1)).alias("weight"))


#: A bit set's largest index, and how many pairs of bit sets cost what one joined candidate does.
MOST_BITS, PAIRS_A_CANDIDATE = 4096, 100


def overlapping(tags: DataFrame, threshold: float, kind: str = "near_duplicate") -> DataFrame:
    """Pairs of index sets with Jaccard >= threshold, exact: by prefix filtering, or where the indices are so common
    that most pairs would meet anyway, by bit sets in pairs of blocks, which shuffles no pair."""
    tags = written(tags.select("identity", "indices"), "sets")
    words, rows = dense(tags, threshold)
    if not words:
        return by_prefixes(tags, threshold, kind)
    return in_cells([(tags, threshold, 0)], words, rows).select("left", "right", F.lit(kind).alias("kind"), "weight")


def prefixes(tags: DataFrame, threshold: float) -> DataFrame:
    """identity, size, i: indices are ordered rarest first, and the first n - ceil(t * n) + 1 of each set are kept, which
    every qualifying pair must share."""
    each = tags.select("identity", F.size("indices").alias("size"), F.explode("indices").alias("i"))
    rare = each.groupBy("i").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(rare, "i").groupBy("identity", "size").agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("o"))
    prefix = F.slice("o", F.lit(1), F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int") + 1)
    return ranked.select("identity", "size", F.explode(F.transform(prefix, lambda s: s["i"])).alias("i"))


def dense(tags: DataFrame, threshold: float) -> tuple[int, int]:
    """(64-bit words of a set as bits, sets) where the prefixes' join would cost more than all pairs of bit sets; else words are 0."""
    if tags.schema["indices"].dataType.elementType.typeName() not in ("byte", "short", "integer", "long"):
        return 0, 0
    heads = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
    low, high, rows, held = tags.withColumn("size", F.size("indices")).agg(F.min(F.array_min("indices")), F.max(F.array_max("indices")), F.count(F.lit(1)), F.sum(F.when(F.col("size") > 0, heads)).cast("double")).first()
    if low is None or low < 0 or high >= MOST_BITS:
        return 0, rows
    words = int(high) // 64 + 1
    enough = float(rows) * rows * words / PAIRS_A_CANDIDATE
    if held * held / (high - low + 1) >= enough:  # as many candidates at least, however the indices lie
        return words, rows
    met = prefixes(tags, threshold).groupBy("i").agg(F.count(F.lit(1)).cast("double").alias("f")).agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0
    return words if met >= enough else 0, rows


def by_prefixes(tags: DataFrame, threshold: float, kind: str = "near_duplicate") -> DataFrame:
    heads = prefixes(tags, threshold)
    right = heads.select(F.col("identity").alias("right"), F.col("size").alias("rs"), "i")
    met = heads.withColumnRenamed("identity", "left").join(right, "i").filter((F.col("left") < F.col("right")) & (F.least("size", "rs") >= threshold * F.greatest("size", "rs") - 1e-9)).select("left", "right").distinct()
    a, b = tags.select(F.col("identity").alias("left"), F.col("indices").alias("x")), tags.select(F.col("identity").alias("right"), F.col("indices").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    likeness = common / (F.size("x") + F.size("y") - common)
    return met.join(a, "left").join(b, "right").withColumn("weight", likeness).filter(F.col("weight") >= threshold).select("left", "right", F.lit(kind).alias("kind"), "weight")


def merged(links: DataFrame, near: dict[str, tuple[DataFrame, float]] | None = None) -> DataFrame:
    """One row a pair, left < right, of links (left, right, kind, weight) and of near duplicates, by kind the tags and
    threshold: weights add up, n counts, seq is the least :func:`priority`. Near duplicates of common indices are merged
    where their pairs are found, all other links coming there, so that pairs are not shuffled."""
    cells, words, most = [], 0, 0
    for kind, (tags, threshold) in (near or {}).items():
        tags = written(tags.select("identity", "indices"), "sets")
        wide, rows = dense(tags, threshold)
        if wide:
            cells.append((tags, threshold, PRIORITY.index("near_duplicate")))
            words, most = max(words, wide), max(most, rows)
        else:
            links = links.unionByName(by_prefixes(tags, threshold, kind))
    one = links.groupBy(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.min(priority(F.col("kind"))).alias("seq"))
    return in_cells(cells, words, most, one, merge=True) if cells else one


def resolve(*links: DataFrame) -> DataFrame:
    """U1"""
    return reduce(DataFrame.unionByName, links)


def priority(kind: Column) -> Column:
    """Order of the producers, for the first type to win."""
    out = F.lit(len(PRIORITY))
    for i, name in reversed(list(enumerate(PRIORITY))):
        out = F.when(kind.startswith(name), i).otherwise(out)
    return out


def link_summary(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links with both ends in one ring (members: ring, identity), distinct by pair and kind, counted by the kind's
    part before the colon."""
    left, right = members.select("ring", F.col("identity").alias("left")), members.select(F.col("ring").alias("_r"), F.col("identity").alias("right"))
    inside = links.join(left, "left").join(right, "right").filter("ring = _r").select("ring", F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "kind").distinct()
    return inside.groupBy("ring", F.substring_index("kind", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("pairs"))
