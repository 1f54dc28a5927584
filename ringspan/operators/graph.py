"""Identity graph: building, projection, propagation, communities, neighbourhoods."""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import moves
from .components import components, stars
from .pairs import PRIORITY, guarded_pairs
from .ordered import places
from .shares import shared_pairs
from .storage import discard, written

#: Weights of shared attributes, conductance of edges and of the node reached.
SHARE = {"device": 1.0, "face_cluster": 1.0, "doc_template": 0.9, "address": 0.7, "phone": 0.6, "email": 0.6, "ip_asn": 0.4, "card_token": 0.3}
EDGE_CONDUCTANCE = {"similar_tag": 1.0, "pii_recombination": 1.0, "observed_together": 0.8, "owns": 0.95, "transacted": 0.15}
NODE_CONDUCTANCE = {"device": 1.0, "address": 0.7, "phone": 0.65, "email": 0.6, "ip_asn": 0.35, "card_token": 0.25, "account": 0.9, "identity": 0.9, "merchant": 0.0}
OTHER_CONDUCTANCE, DECAY, MOST_HOPS, LEAST = 0.5, 0.55, 3, 0.02
PROJECTED = ("device", "address", "phone", "email", "ip_asn")
OWNERS = (2, 60)
SUSPICIOUS = ("device", "address", "phone", "ip_asn", "email", "similar_tag", "pii_recombination")


def _choose(value: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def edge_type(kind: Column) -> Column:
    """G3"""
    return F.when(kind.startswith("pii_recombination"), "pii_recombination").when(kind.startswith("near_duplicate"), "similar_tag").otherwise("observed_together")


def link_type(seq: Column, other: Column) -> Column:
    """G3 by the place among :data:`pairs.PRIORITY`; ``other`` beyond it."""
    return reduce(lambda rest, k: F.when(seq == k[0], edge_type(F.lit(k[1]))).otherwise(rest), enumerate(PRIORITY), other)


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type, weight, institution, seq) of one unordered pair are one edge: weights and counts
    add up, institutions are collected, the type of least ``seq`` stays."""
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "edge_type", "weight", "institution", "seq")
    return one.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("institution")).alias("institutions"), F.min_by("edge_type", "seq").alias("edge_type"))


def build(people: DataFrame, auth: DataFrame | None = None, telemetry: DataFrame | None = None, links: DataFrame | None = None, end: str | None = None) -> DataFrame:
    """G1: all edges of the heterogeneous graph, merged. people: identity, account, institution and tokens; auth: account,
    card, merchant, device, ip, institution; telemetry: account, device, institution; links: left, right, weight, n, seq as
    :func:`pairs.merged` gives them. An edge's ends tell which streams it comes from, so each kind of edge is merged by its
    own keys, before these become names, and no edge of a link is shuffled here. With ``end``, only the edges that have an
    end of that kind are made; links end at identities alone."""
    wanted = lambda *kinds: end is None or end in kinds
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def edge(sources, a, b, kind, weight):
        rows = reduce(DataFrame.union, [s.filter(F.col(a[1]).isNotNull() & F.col(b[1]).isNotNull()).select(F.col(a[1]).alias("a"), F.col(b[1]).alias("b"), F.col("institution").cast("string").alias("institution")) for s in sources])
        counted = rows.groupBy("a", "b", "institution").agg(F.count(F.lit(1)).alias("n"))
        one = counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("institution")).alias("institutions"))
        return named(one, node(a[0], "a"), node(b[0], "b"), F.lit(weight) * F.col("n"), F.col("institutions"), F.lit(kind))

    def named(one, a, b, weight, institutions, kind):
        return one.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), weight.alias("weight"), "n", institutions.alias("institutions"), kind.alias("edge_type"))

    out = [edge([people], ("identity", "identity"), ("account", "account"), "owns", 1.0)] if wanted("identity", "account") else []
    out += [edge([people], ("identity", "identity"), (kind, key), "observed_together", SHARE[kind]) for kind, key in (("device", "device"), ("address", "address"), ("email", "email"), ("phone", "phone"), ("ip_asn", "ip")) if wanted("identity", kind)]
    for kind, key, what, weight, sources in (("card_token", "card", "transacted", 0.3, (auth,)), ("merchant", "merchant", "transacted", 0.0, (auth,)), ("device", "device", "observed_together", 1.0, (auth, telemetry)), ("ip_asn", "ip", "observed_together", 0.4, (auth,))):
        if (held := [s for s in sources if s is not None]) and wanted("account", kind):
            out.append(edge(held, ("account", "account"), (kind, key), what, weight))
    if links is not None and wanted("identity"):
        out.append(named(links, node("identity", "left"), node("identity", "right"), F.col("weight"), F.array().cast("array<string>"), link_type(F.col("seq"), F.lit("observed_together"))))
    return reduce(DataFrame.union, out)


#: Nodes that are broadcast at most: some 40 MB.
MOST_BROADCAST = 500_000


def few(df: DataFrame, name: str) -> DataFrame:
    """Written, and broadcast where joined unless the rows are many: then edges are shuffled to it."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def summary(edges: DataFrame) -> DataFrame:
    """A10: nodes by type, and edges, in one pass: every edge has two ends."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("ends"))
    by = written(nodes.groupBy(F.substring_index("node", ":", 1).alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends")), "summary")
    return by.select("what", "n").union(by.agg(F.lit("edges"), F.coalesce(F.expr("sum(ends) div 2"), F.lit(0).cast("bigint"))))


def both_ways(edges: DataFrame) -> DataFrame:
    """In one pass, for edges may be costly to make."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"))))
    return edges.withColumn("_e", ends).select(*[F.col(f"_e.{c[0]}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])


def neighbours(edges: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """G9"""
    near = both_ways(edges.select("src", "dst")).filter(F.col("dst").startswith(f"{kind}:"))
    return near.join(few(nodes.select(F.col("node").alias("src")).distinct(), "members"), "src", "left_semi").distinct()


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    held = few(nodes.select("node").distinct(), "among")
    for end in ("src", "dst"):
        edges = edges.join(held, edges[end] == held["node"], "left_semi")
    return edges


#: Kinds of the tags of :func:`owner_groups`, by their places.
TAGS = tuple(sorted(PROJECTED))


def numbered(edges: DataFrame) -> bool:
    return edges.schema["identity"].dataType.typeName() in ("integer", "long")


def owner_groups(edges: DataFrame, owners: tuple[int, int] = OWNERS) -> DataFrame:
    """The owners of each attribute, as :func:`shares.shared_pairs` takes them."""
    once = edges.select("identity", "attribute", "kind").distinct().filter(F.col("kind").isin(*PROJECTED) & F.col("attribute").isNotNull())
    key = ["attribute", "kind"]  # as plain columns, for rows that lie together by attribute to stay where they are
    held = once.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter(F.col("n").between(*owners))
    groups = held.groupBy(*key, "n").agg(F.array_sort(F.collect_list("identity")).alias("members"))
    return groups.select(_choose(F.col("kind"), {k: i for i, k in enumerate(TAGS)}, -1).alias("tag"), (_choose(F.col("kind"), SHARE, 0.0) / F.sqrt(F.col("n") - 1)).alias("weight"), "members")


def project(edges: DataFrame, direct: DataFrame | None = None, owners: tuple[int, int] = OWNERS) -> DataFrame:
    """Identities that share an attribute. edges: identity, attribute, kind; an attribute's weight is spread over
    its owners; ``direct`` identity edges (left, right, edge_type, weight) add theirs. tags: shared attributes by type.
    Without these, pairs of numbered identities are added up block by block, so that none is shuffled."""
    if direct is None and numbered(edges):
        return shared_pairs(owner_groups(edges, owners), TAGS)
    once = edges.select("identity", "attribute", "kind").distinct().filter(F.col("kind").isin(*PROJECTED) & F.col("attribute").isNotNull())
    once = once.withColumn("key", F.struct("kind", "attribute"))
    pairs = guarded_pairs(once, "key", "identity", *owners)
    made = pairs.select("left", "right", F.col("key.kind").alias("tag"), (_choose(F.col("key.kind"), SHARE, 0.0) / F.sqrt(F.col("n") - 1)).alias("weight"))
    if direct is not None:
        made = made.union(direct.select("left", "right", F.col("edge_type").alias("tag"), "weight"))
    by_tag = made.groupBy("left", "right", "tag").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("k"))
    return by_tag.groupBy("left", "right").agg(F.sum("w").alias("weight"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "k")))).alias("tags"))


def conductance(kind: Column, reached: Column, weight: Column) -> Column:
    """By edge type, type of the node reached and weight; directional."""
    return _choose(kind, EDGE_CONDUCTANCE, OTHER_CONDUCTANCE) * _choose(F.substring_index(reached, ":", 1), NODE_CONDUCTANCE, OTHER_CONDUCTANCE) * (0.5 + 0.5 * weight / (1 + weight))


def propagate(edges: DataFrame, seeds: DataFrame, decay: float = DECAY, hops: int = MOST_HOPS, least: float = LEAST, most_rounds: int = 24) -> DataFrame:
    """Best evidence reaching each node from the seeds (node, score). Every round recomputes all labels from the
    last round's and keeps the winner's hops, until nothing changes; ties (of
    conductances to 12 digits) by hops, source, predecessor. Seeds are not in
    the output. A round passes over the edges twice, for the best score and for its ties; edges are shuffled only if labels
    are too many to be broadcast. State goes through the shared folder."""
    along = lambda reached: F.round(decay * conductance(F.col("edge_type"), F.col(reached), F.col("weight")), 12)
    step = written(edges.select("src", "dst", F.col("edge_type").alias("via"), along("dst").alias("c"), along("src").alias("back")).filter("c > 0 OR back > 0"), "conductance")
    ways = F.array(F.struct("src", "dst", "c"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("back").alias("c")))
    both = step.select("via", F.explode(ways).alias("e")).select("e.*", "via").filter("c > 0")
    start = written(seeds.select("node", "score", F.lit(0).alias("hops"), F.col("node").alias("source"), F.lit(None).cast("string").alias("before"), F.array().cast("array<struct<from_node:string,to_node:string,via:string,contribution:double>>").alias("path")), "seeds")
    held = few(start.select("node"), "seed-nodes")
    now, mark = start, None
    for _ in range(most_rounds):
        slim = few(now.filter(F.col("hops") < hops).select(F.col("node").alias("src"), "score", "hops", "source"), "frontier")
        offers = both.join(slim, "src").withColumn("next", F.col("score") * F.col("c")).filter(F.col("next") >= least).withColumnRenamed("dst", "node").join(held, "node", "left_anti")
        top = few(offers.groupBy("node").agg(F.max("next").alias("top")), "top")  # first by number alone, so that only ties are sorted by name
        ties = offers.join(top, "node").filter("next = top")
        won = ties.groupBy("node").agg(F.min_by(F.struct("next", (F.col("hops") + 1).alias("steps"), "source", "src", "via"), F.struct("hops", "source", "src")).alias("b")).select("node", F.col("b.next").alias("score"), F.col("b.steps").alias("hops"), "b.source", F.col("b.src").alias("before"), "b.via")
        hop = F.struct(F.col("before").alias("from_node"), F.col("node").alias("to_node"), "via", F.col("score").alias("contribution"))
        best = won.join(now.select(F.col("node").alias("before"), F.col("path").alias("_path")), "before").select("node", "score", "hops", "source", "before", F.concat("_path", F.array(hop)).alias("path"))
        before, now = now, written(start.unionByName(best), "propagated")
        discard(slim, top, *([before] if before is not start else []))
        seen = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("node", "score", "hops", "source", "before")), F.lit(0))).first())
        if seen == mark:
            discard(step)
            return now.filter("hops > 0").select("node", "score", "hops", "source", "path")
        mark = seen
    raise RuntimeError(f"propagation still changes after {most_rounds} rounds")


def mark_dormant(reached: DataFrame, transacted: DataFrame, key: str = "identity") -> DataFrame:
    """Identities that never transacted."""
    seen = transacted.select(key).distinct().withColumn("_seen", F.lit(True))
    return reached.join(seen, key, "left").withColumn("dormant", F.col("_seen").isNull()).drop("_seen")


def ring_alert(reached: DataFrame) -> DataFrame:
    """Reached and dormant identities by hops."""
    return reached.groupBy("hops").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dormant").cast("long")).alias("dormant"))


def ring_subgraph(edges: DataFrame, members: DataFrame, limit: int = 200) -> DataFrame:
    """Edges among the first ``limit`` members by name and their direct neighbours."""
    core = few(members.select("node").distinct().orderBy("node").limit(limit), "core")
    kept = written(edges, "ring-graph")
    near = both_ways(kept.select("src", "dst")).join(core, F.col("src") == core["node"], "left_semi").select(F.col("dst").alias("node"))
    return among(kept, near.union(core))


#: Neighbours from which a node's groups are added up as arrays.
MANY_NEIGHBOURS = 32


def _louvain(left: np.ndarray, right: np.ndarray, weight: np.ndarray, total: float, resolution: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Louvain of one component: (nodes, least node of each one's community); ``total`` is twice the weight of the
    whole graph. An edge from a node to itself is weight that an earlier level put inside it."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b, w = at[: len(left)], at[len(left) :], np.asarray(weight, float)
    home, n, rng = np.arange(len(names)), len(names), random.Random(seed)
    while True:
        loop = a == b
        ends, near = np.concatenate([a[~loop], b[~loop]]), np.concatenate([b[~loop], a[~loop]])
        by, both = np.argsort(ends, kind="stable"), np.concatenate([w[~loop], w[~loop]])
        near, both = near[by], both[by]
        starts = np.searchsorted(ends[by], np.arange(n + 1)).tolist()
        strength = np.bincount(ends[by], both, n) + 2 * np.bincount(a[loop], w[loop], n)
        group, mass, moved, own = np.arange(n), strength.copy(), False, strength.tolist()
        while True:
            changed, order = False, list(range(n))
            rng.shuffle(order)
            for i in order:
                one, two = starts[i], starts[i + 1]
                if one == two:
                    continue
                mine, k = int(group[i]), own[i]
                met, inward = group[near[one:two]], both[one:two]
                mass[mine] -= k
                if two - one < MANY_NEIGHBOURS:
                    sums = {mine: 0.0}
                    for g, x in zip(met.tolist(), inward.tolist(), strict=True):
                        sums[g] = sums.get(g, 0.0) + x
                    gain = {g: x - resolution * k * float(mass[g]) / total for g, x in sums.items()}
                    best = min(gain, key=lambda g: (-gain[g], g))  # noqa: B023  the least among equals
                    better = gain[best] > gain[mine] + 1e-12
                else:
                    groups, place = np.unique(np.append(met, mine), return_inverse=True)
                    gains = np.bincount(place, np.append(inward, 0.0)) - resolution * k * mass[groups] / total
                    top = int(gains.argmax())
                    best, better = int(groups[top]), gains[top] > gains[place[-1]] + 1e-12
                if better:
                    group[i], changed, moved = best, True, True
                    mine = best
                mass[mine] += k
            if not changed:
                break
        if not moved:
            first = np.unique(home, return_index=True)[1]
            return names, names[first[home]]
        kept, ids = np.unique(group, return_inverse=True)
        home, n = ids[home], len(kept)
        pairs, place = np.unique(np.minimum(ids[a], ids[b]) * n + np.maximum(ids[a], ids[b]), return_inverse=True)
        a, b, w = pairs // n, pairs % n, np.bincount(place, w)


#: Edges of a component above which its nodes are moved by rounds over the whole cluster before one task sees it.
ONE_TASK_EDGES = 4_000_000
MOVE_ROUNDS = 24


def moved_together(edges: DataFrame, total: float, resolution: float, seed: int, rounds: int = MOVE_ROUNDS) -> DataFrame:
    """One level of Louvain as rounds over tables: (node, group). edges: left, right, weight; loops allowed. In a round
    every other node, by a hash of node and round, moves to the neighbouring group of greatest gain, the least group
    among equals; until two rounds in a row move nothing."""
    both = written(edges.select(F.col("left").alias("a"), F.col("right").alias("b"), "weight").union(edges.filter("left <> right").select("right", "left", "weight")), "level")
    strength = both.groupBy(F.col("a").alias("node")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("weight")).otherwise(F.col("weight"))).alias("k"))
    nodes = written(strength.withColumn("group", F.col("node")), "moved")
    quiet = 0
    for r in range(rounds):
        mass = nodes.groupBy(F.col("group").alias("g")).agg(F.sum("k").alias("m"))
        reach = both.filter("a <> b").join(nodes.select(F.col("node").alias("b"), F.col("group").alias("g")), "b").select("a", "g", "weight")
        inward = reach.union(nodes.select("node", "group", F.lit(0.0))).groupBy("a", "g").agg(F.sum("weight").alias("w"))
        offers = inward.join(nodes.select(F.col("node").alias("a"), "group", "k"), "a").join(mass, "g")
        stays = F.col("g") == F.col("group")
        gain = F.col("w") - resolution * F.col("k") * (F.col("m") - F.when(stays, F.col("k")).otherwise(0.0)) / total
        best = offers.withColumn("gain", gain).groupBy("a").agg(F.min_by("g", F.struct(-F.col("gain"), "g")).alias("to"), F.max("gain").alias("top"), F.max(F.when(stays, F.col("gain"))).alias("own"), F.max("group").alias("group"), F.max("k").alias("k"))
        goes = (F.col("top") > F.col("own") + 1e-12) & (F.pmod(F.xxhash64("a", F.lit(seed + r)), F.lit(2)) == 0)
        before, nodes = nodes, written(best.select(F.col("a").alias("node"), "k", F.when(goes, F.col("to")).otherwise(F.col("group")).alias("group"), goes.alias("moves")), "moved")
        discard(before)
        quiet = 0 if nodes.filter("moves").limit(1).count() else quiet + 1
        if quiet == 2:
            break
    return nodes.select("node", "group")


def contracted(edges: DataFrame, home: DataFrame) -> DataFrame:
    """Edges between groups (home: node, group), weights added up; what lies within a group is its loop."""
    a, b = home.select(F.col("node").alias("left"), F.col("group").alias("_a")), home.select(F.col("node").alias("right"), F.col("group").alias("_b"))
    if home.count() <= MOST_BROADCAST:
        a, b = F.broadcast(a), F.broadcast(b)
    ends = edges.join(a, "left").join(b, "right").select(F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right"), "weight")
    return ends.groupBy("left", "right").agg(F.sum("weight").alias("weight"))


def settled(edges: DataFrame, nodes: DataFrame, n: int, total: float, resolution: float, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Levels over the cluster until ``most`` of the ``n`` edges are left or a level merges nothing: (home: node, group; edges).
    nodes: the edges' ends. Where these are numbered and few enough for every task, moves go by their neighbours' lists."""
    home, kind = None, edges.schema["left"].dataType.simpleString()
    listed = kind in ("int", "bigint") and nodes.count() <= MOST_BROADCAST
    ids = np.sort(nodes.toArrow().column(0).to_numpy()) if listed else None
    edges = edges if listed else written(edges, "big-edges")
    while n > most:
        if listed:
            to = moves.moved(edges, ids, n, total, resolution, seed)
            groups = edges.sparkSession.createDataFrame(pd.DataFrame({"node": ids, "group": to}), f"node {kind}, group {kind}")
            ids = np.unique(to)
        else:
            groups = moved_together(edges, total, resolution, seed)
        groups = written(groups, "groups")
        home = groups if home is None else written(home.join(groups.select(F.col("node").alias("group"), F.col("group").alias("_g")), "group").select("node", F.col("_g").alias("group")), "home")
        before, edges = n, written(contracted(edges, groups), "contracted")
        n = edges.count()
        if n == before:
            break
    return home, edges


def communities(pairs: DataFrame, institutions: DataFrame | None = None, resolution: float = 1.0, seed: int = 7, smallest: int = 4, most: int | None = None, labels: DataFrame | None = None, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: identity, community; table of communities). pairs: what :func:`project` gives, or with one ``tag`` a pair
    or none in place of the tags; ``also`` has further tags (left, right, tags) of the same pairs. Communities never span
    components. One of ``most`` edges at most is optimised in a task of its own, against the whole graph's weight; larger
    ones are first merged level by level over the cluster, until what is left of them is that small."""
    most = most or ONE_TASK_EDGES
    pairs = written(pairs, "projection")
    total = 2 * float(f"{pairs.agg(F.sum('weight')).first()[0] or 1.0:.12g}")  # the last digits hang on the order of rows
    labels = labels or few(components(stars(pairs.select(F.col("left").alias("a"), F.col("right").alias("b")))), "labels")
    inner = pairs.join(labels.withColumnRenamed("node", "left"), "left").select("label", "left", "right", "weight")
    big = written(inner.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most), "big")
    kind = pairs.schema["left"].dataType.simpleString()
    home = None
    if not big.isEmpty():
        large = F.broadcast(big.select("label"))  # few: each has more than ``most`` edges
        nodes = few(labels.join(large, "label", "left_semi").select("node"), "large")
        edges = pairs.join(nodes.withColumnRenamed("node", "left"), "left", "left_semi").select("left", "right", "weight")
        home, level = settled(edges, nodes, big.agg(F.sum("_n")).first()[0], total, resolution, seed, most)
        inner = inner.join(large, "label", "left_anti").union(level.join(labels.withColumnRenamed("node", "left"), "left").select("label", "left", "right", "weight"))

    members = _placed(inner, home, kind, total, resolution, seed)
    inside = _inside(pairs, members)
    if also is not None:
        inside = inside.union(_inside(also.withColumn("weight", F.lit(0.0)), members).withColumn("pairs", F.lit(0).cast("bigint")))
    return _rated(members, inside, institutions, smallest)


def shared_communities(edges: DataFrame, institutions: DataFrame | None = None, resolution: float = 1.0, seed: int = 7, smallest: int = 4, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`communities` of what :func:`project` gives of the edges. Components that can have more than ``most`` pairs are
    merged level by level straight from the owners of each attribute (:mod:`moves`), so that their pairs, which may be
    nearly all there can be, are only counted within communities."""
    rest = dict(resolution=resolution, seed=seed, smallest=smallest, most=most)
    if not numbered(edges):
        return communities(project(edges), institutions, **rest)
    most = most or ONE_TASK_EDGES
    kind = edges.schema["identity"].dataType.simpleString()
    groups, n = written(owner_groups(edges), "shared"), F.size("members")
    labels = few(components(stars(groups.select(F.get("members", F.lit(0)).alias("a"), F.explode("members").alias("b")))), "labels")
    met = groups.join(labels, F.get("members", F.lit(0)) == F.col("node")).groupBy("label").agg(F.sum(n * (n - 1) / 2).alias("_met"))
    wide = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_nodes")).join(met, "label").filter((F.col("_met") > most) & (F.col("_nodes") * (F.col("_nodes") - 1) / 2 > most))
    big = written(wide.select("label", "_nodes"), "big")
    held = big.agg(F.sum("_nodes")).first()[0]
    if not held or held > MOST_BROADCAST:  # so many labels don't fit every task
        return communities(shared_pairs(groups, TAGS), institutions, **rest, labels=labels)
    total = groups.agg(F.sum(F.col("weight") * n * (n - 1))).first()[0]
    large = F.broadcast(labels.join(F.broadcast(big.select("label")), "label", "left_semi").select("node"))
    whose = F.get("members", F.lit(0)) == large["node"]
    many = written(groups.join(large, whose, "left_semi"), "many")
    pairs = written(shared_pairs(groups.join(large, whose, "left_anti"), TAGS), "projection")
    discard(groups)
    ids, roots, level = moves.settled(many, total, resolution, seed, most)
    spark = edges.sparkSession
    home = written(spark.createDataFrame(pd.DataFrame({"node": ids, "group": roots}), "node bigint, group bigint").select(F.col("node").cast(kind).alias("node"), F.col("group").cast(kind).alias("group")), "home")
    if level is None:  # more groups than one task takes, which no move makes fewer
        names = np.unique(roots)
        left, right, weight = names, names, np.zeros(len(names))
    else:
        left, right, weight = (level.column(c).to_numpy() for c in ("left", "right", "weight"))
    edge = written(spark.createDataFrame(pd.DataFrame({"left": left, "right": right, "weight": weight}), f"left {kind}, right {kind}, weight double"), "level")
    inner = pairs.select("left", "right", "weight").union(edge).join(labels.withColumnRenamed("node", "left"), "left").select("label", "left", "right", "weight")
    members = _placed(inner, home, kind, total, resolution, seed)
    ends = members.join(large, members["identity"] == large["node"], "left_semi").toArrow().sort_by("identity")
    cut = many.mapInArrow(moves.parted(ends.column("identity").to_numpy(), ends.column("root").to_numpy()), f"tag int, weight double, members array<{kind}>")
    sums = shared_pairs(cut, TAGS, by_member=True).withColumnRenamed("left", "identity").join(members, "identity").select("root", "pairs", "weight", "tags")
    return _rated(members, _inside(pairs, members).union(sums), institutions, smallest)


def _placed(inner: DataFrame, home: DataFrame | None, kind: str, total: float, resolution: float, seed: int) -> DataFrame:
    """identity, root: communities of edges (label, left, right, weight), a task a component; home: node, group of those that
    stand there as groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = _louvain(pdf["left"].to_numpy(), pdf["right"].to_numpy(), pdf["weight"].to_numpy(), total, resolution, seed)
        return pd.DataFrame({"identity": nodes, "root": roots})

    last = inner.groupBy("label").applyInPandas(run, f"identity {kind}, root {kind}")
    if home is not None:  # groups stand for their members
        whole = home.join(last.withColumnRenamed("identity", "group"), "group").select(F.col("node").alias("identity"), "root")
        last = written(whole, "big-members").union(last.join(home.select(F.col("group").alias("identity")), "identity", "left_anti"))
        least = last.groupBy("root").agg(F.min("identity").alias("_least"))
        last = last.join(least, "root").select("identity", F.col("_least").alias("root"))
    return few(last, "members")


def _inside(pairs: DataFrame, members: DataFrame) -> DataFrame:
    a, b = members.select(F.col("identity").alias("left"), "root"), members.select(F.col("identity").alias("right"), F.col("root").alias("_r"))
    held = pairs.join(a, "left").join(b, "right").filter("root = _r")
    if "tag" not in pairs.columns:
        return held.select("root", F.lit(1).cast("bigint").alias("pairs"), "weight", "tags")
    sums = held.groupBy("root", "tag").agg(F.count(F.lit(1)).alias("pairs"), F.sum("weight").alias("weight"))
    return sums.select("root", "pairs", "weight", F.when(F.col("tag").isNotNull(), F.create_map(F.coalesce("tag", F.lit("")), "pairs")).otherwise(F.create_map().cast("map<string,bigint>")).alias("tags"))


def _rated(members: DataFrame, inside: DataFrame, institutions: DataFrame | None, smallest: int) -> tuple[DataFrame, DataFrame]:
    """(members by numbered community; table of communities). inside: root, and pairs inside, their weight and shared attributes by type, in sums."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= smallest)
    mass = lambda keep: F.aggregate(F.map_entries("tags"), F.lit(0).cast("bigint"), lambda s, e: s + F.when(keep(e["key"]), e["value"]).otherwise(0))
    stats = inside.groupBy("root").agg((F.sum("weight") / F.sum("pairs")).alias("cohesion"), F.sum("pairs").alias("edges"), F.sum(mass(lambda k: k.isin(*SUSPICIOUS))).alias("bad"), F.sum(mass(lambda k: F.lit(True))).alias("all"))
    table = sizes.join(stats, "root").withColumn("suspicion", F.when(F.col("all") > 0, F.col("bad") / F.col("all")).otherwise(0.0))
    table = table.withColumn("density", 2 * F.col("edges") / (F.col("size") * (F.col("size") - 1))).withColumn("score", F.col("cohesion") * F.col("suspicion") * F.log1p("size"))
    if institutions is not None:
        held = members.join(institutions, "identity").groupBy("root").agg(F.array_sort(F.collect_set("institution")).alias("institutions"))
        table = table.join(held, "root", "left").withColumn("cross_institution", F.size("institutions") > 1)
    numbered = places(table.withColumn("_less", -F.col("size")), ("_less", "root"), "_place")
    table = written(numbered.withColumn("community", F.format_string("cmt_%04d", F.col("_place") - 1)).drop("bad", "all", "_less", "_place"), "communities")
    return members.join(table.select("root", "community"), "root").select("identity", "community"), table


def match_rings(members: DataFrame, ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """For each planted ring (truth: identity, ring) the community of best F1; of equals the highest ranked
    (ranked: community, rank). A ring that nothing overlaps has zeros and rank -1."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(ranked, "community")
    rings = truth.groupBy("ring").agg(F.count(F.lit(1)).alias("planted"))
    met = truth.join(members, "identity").groupBy("ring", "community").agg(F.count(F.lit(1)).alias("hit")).join(sizes, "community").join(rings, "ring")
    f1 = met.withColumn("recall", F.col("hit") / F.col("planted")).withColumn("precision", F.col("hit") / F.col("size")).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    best = f1.groupBy("ring").agg(F.min_by(F.struct("community", "recall", "precision", "f1", "rank"), F.struct(-F.col("f1"), "rank")).alias("b")).select("ring", "b.*")
    return rings.join(best, "ring", "left").select("ring", "planted", "community", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("recall", "precision", "f1")], F.coalesce("rank", F.lit(-1)).alias("rank"))


def shared_attributes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Incidences of members with attributes that another member of the community has too, by type. members:
    community, identity; edges: identity, attribute, kind."""
    held = edges.select("identity", "attribute", "kind").distinct().join(few(members, "holders"), "identity")
    count = held.groupBy("community", "kind", "attribute").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return count.groupBy("community", "kind").agg(F.sum("n").alias("incidences"))


def visible(nodes: DataFrame, edges: DataFrame, institution: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, institutions) an institution sees, and edges with both ends among them. A node may have several rows."""
    seen = nodes.filter(F.array_contains("institutions", institution))
    return seen, among(edges, seen)


def expected_score(cohesion: float, suspicion: float, size: int) -> float:
    return cohesion * suspicion * math.log1p(size)
