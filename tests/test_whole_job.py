"""Queries do the whole job: nothing of their input is left out."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ringspan import adapters as A
from ringspan.operators import graph as G
from ringspan.plans import graph_queries
from ringspan.registry import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_communities_see_every_shared_part(spark):
    members, table = graph_queries.found(spark, DATA)
    pairs = G.project(A.attribute_edges(spark, DATA)).toPandas()
    home = {r.identity: r.community for r in members.collect()}
    assert set(home) == {r[0] for r in duckdb.sql(f"SELECT DISTINCT l_suppkey FROM '{DATA}/lineitem.parquet'").fetchall()}
    assert sum(r.edges for r in table.collect()) == sum(home[a] == home[b] for a, b in zip(pairs.left, pairs.right, strict=True))


def test_planted_rings_are_those_of_the_identities(spark):
    planted = {r.ring: r.planted for r in graph_queries.g10(spark, DATA).collect()}
    assert planted == dict(duckdb.sql(f"SELECT c_custkey % 4, count(*) FROM '{DATA}/customer.parquet' WHERE c_custkey % 25 = 3 GROUP BY 1").fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_ring_subgraph_holds_every_member(spark):
    d = "/root/testdata/sf0.01"
    nodes = {x for r in QUERIES["G8_ring_subgraph"](spark, d).collect() for x in (r.src, r.dst)}
    members = duckdb.sql(f"SELECT 'identity:' || c_custkey FROM '{d}/customer.parquet' WHERE c_custkey % 25 = 3 AND c_custkey % 4 = 1").fetchall()
    assert len(members) > 3 and {m[0] for m in members} <= nodes


def test_every_ring_is_compared(spark):
    found = {r.ring for r in QUERIES["A5_ring_against_rest"](spark, DATA).select("ring").distinct().collect()}
    assert found == {r[0] for r in duckdb.sql(f"SELECT DISTINCT c_custkey % 4 FROM '{DATA}/customer.parquet' WHERE c_custkey % 25 = 3").fetchall()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_view_delta_compares_every_merchant(spark):
    d = "/root/testdata/sf0.01"
    enough = duckdb.sql(f"SELECT event_type FROM '{d}/events.parquet' WHERE epoch_us(ts) > (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM '{d}/events.parquet') GROUP BY 1 HAVING count(*) >= 500").fetchall()
    assert 0 < QUERIES["E7_view_delta"](spark, d).first().groups_compared <= len(enough)


@pytest.mark.parametrize("most", [10, 10**9])
def test_communities_found_by_rounds_are_as_good(spark, most):
    """Two cliques of 12 and a ring of cliques: by rounds over the cluster or in one task, modularity is near the best."""
    rows = [(20 * c + i, 20 * c + j) for c in range(8) for i in range(12) for j in range(i + 1, 12)] + [(20 * c, 20 * ((c + 1) % 8) + 1) for c in range(8)]
    pairs = spark.createDataFrame([(min(a, b), max(a, b), 1.0, {"device": 1}) for a, b in rows], "left bigint, right bigint, weight double, tags map<string,bigint>")
    members, table = G.communities(pairs, most=most)
    home = {r.identity: r.community for r in members.collect()}
    assert len(home) == 96 and table.count() == len(set(home.values()))
    inside = sum(home[a] == home[b] for a, b in rows)
    degree = {}
    for a, b in rows:
        for x in (a, b):
            degree[home[x]] = degree.get(home[x], 0) + 1
    modularity = inside / len(rows) - sum((k / (2 * len(rows))) ** 2 for k in degree.values())
    assert modularity > 0.85


def test_pairs_of_a_large_component_are_not_written(spark, monkeypatch):
    """Where nearly all suppliers share a part, pairs between communities are added up, not kept."""
    written, kept, d = G.written, {}, "/root/testdata/sf0.01"
    monkeypatch.setattr(G, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    monkeypatch.setattr(G, "ONE_TASK_EDGES", 1000)
    members, table = graph_queries.found(spark, d)
    assert kept["projection"].count() == 0
    pairs = G.project(A.attribute_edges(spark, d)).toPandas()
    home = {r.identity: r.community for r in members.collect()}
    inside = pairs[pairs.left.map(home) == pairs.right.map(home)]
    by = inside.groupby(inside.left.map(home)).weight.agg(["count", "mean"])
    assert len(pairs) > 4000 and len(home) == 100
    assert {r.community: (r.edges, round(r.cohesion, 9)) for r in table.collect()} == {c: (n, round(w, 9)) for c, n, w in by.itertuples()}


@pytest.mark.parametrize("most", [10, 60, 10**9])
def test_communities_of_owners_are_as_good(spark, most):
    """The cliques of the test above as attributes: those of a component of its own stay apart."""
    held = [(100 * k + i, 1000 * k + 20 * c, "device") for k in range(2) for c in range(8) for i in range(12 * c, 12 * c + 12)]
    held += [(100 * k + i, 1000 * k + 20 * c + 1, "ip_asn") for k in range(2) for c in range(8) for i in (12 * c, 12 * ((c + 1) % 8) + 1)]
    edges = spark.createDataFrame(held, "identity bigint, attribute bigint, kind string")
    members, table = G.shared_communities(edges, most=most)
    home = {r.identity: r.community for r in members.collect()}
    assert len(home) == 192 and all(len({home[100 * k + 12 * c + i] for i in range(12)}) == 1 for k in range(2) for c in range(8))
    assert not {home[i] for i in range(96)} & {home[100 + i] for i in range(96)}
    assert sum(r.size for r in table.collect()) == 192 and table.filter("size < 12").isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_links_of_a_large_component_are_read_by_node(spark, monkeypatch):
    """No round joins links with tables; those within communities have the number, weights and types that SQL finds."""
    d = "/root/testdata/sf0.01"
    monkeypatch.setattr(G, "ONE_TASK_EDGES", 1000)
    monkeypatch.delattr(G, "moved_together")
    members, table = graph_queries.applicants(spark, d)
    con, home = duckdb.connect(), members.toPandas()
    for t in ("customer", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    con.register("home", home)
    owned = " UNION ALL ".join(f"SELECT a.identity AS l, b.identity AS r, {w} / sqrt(n - 1) AS w, '{k}' AS tag FROM ident a JOIN ident b ON a.{t} = b.{t} AND a.identity < b.identity JOIN (SELECT {t}, count(*) AS n FROM ident GROUP BY {t} HAVING count(*) BETWEEN 2 AND 60) g ON g.{t} = a.{t}" for t, k, w in (("device", "device", 1.0), ("address", "address", 0.7), ("email", "email", 0.6), ("phone", "phone", 0.6), ("ip", "ip_asn", 0.4)))
    direct = f"SELECT l, r, sum(w) AS w, arg_min(kind, o) AS tag FROM (SELECT * FROM ({graph_queries._LINKS}) x(l, r, kind, w, o)) GROUP BY l, r"
    want = con.sql(f"""WITH {A.IDENTITY_SQL}, {A.TAG_KINDS_SQL}, every AS ({owned} UNION ALL {direct}), inside AS (SELECT h.community, e.* FROM every e JOIN home h ON h.identity = l JOIN home i ON i.identity = r AND i.community = h.community)
SELECT community, count(DISTINCT (l, r)), sum(w) / count(DISTINCT (l, r)), avg((tag <> 'observed_together')::INTEGER) FROM inside GROUP BY community""").fetchall()
    assert len(home) == con.sql("SELECT count(*) FROM customer").fetchall()[0][0] and len(want) > 1
    assert {r.community: (r.edges, round(r.cohesion, 9), round(r.suspicion, 9)) for r in table.collect()} == {c: (n, round(w, 9), round(s, 9)) for c, n, w, s in want}


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_blocks_of_neighbours_change_nothing(spark, monkeypatch, kind):
    """Cliques in a ring, their merged level with loops too: modularity is near the best, and the same however nodes are dealt."""
    rows = [(20 * c + i, 20 * c + j) for c in range(8) for i in range(12) for j in range(i + 1, 12)] + [(20 * c, 20 * ((c + 1) % 8) + 1) for c in range(8)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in rows], f"left {kind}, right {kind}, weight double")
    nodes, found = edges.selectExpr("explode(array(left, right)) AS node").distinct(), []
    for most in (2_000_000, 40):
        monkeypatch.setattr(G.moves, "BLOCK_NEIGHBOURS", most)
        home, level = G.settled(edges, nodes, len(rows), 2.0 * len(rows), 1.0, 7, 9)
        found.append((sorted(home.collect()), sorted((r.left, r.right, round(r.weight, 9)) for r in level.collect())))
    assert found[0] == found[1] and sum(w for _, _, w in found[0][1]) == len(rows)
    home, degree = dict(found[0][0]), Counter()
    for a, b in rows:
        degree.update([home[a], home[b]])
    assert sum(home[a] == home[b] for a, b in rows) / len(rows) - sum((k / (2 * len(rows))) ** 2 for k in degree.values()) > 0.8


def test_propagation_that_never_settles_is_an_error(spark):
    edges = spark.createDataFrame([("identity:1", "device:1", "observed_together", 1.0)], "src string, dst string, edge_type string, weight double")
    with pytest.raises(RuntimeError):
        G.propagate(edges, spark.createDataFrame([("identity:1", 1.0)], "node string, score double"), most_rounds=1).count()


def test_links_of_tags_are_counted_and_drawn(spark):
    kinds = {r.kind for r in QUERIES["U1_resolved_links"](spark, DATA).collect()}
    assert {"email_shape"} < kinds and any(k.startswith("near_duplicate:") for k in kinds)
    assert QUERIES["G1_G2_A11_merged_edges"](spark, DATA).filter("edge_type = 'similar_tag'").count() > 0


@pytest.mark.parametrize("name", ["U1_resolved_links", "A8_near_duplicate_degree"])
def test_near_duplicates_are_counted_where_they_are_found(spark, name):
    """Near duplicates of 16 of 64 indices grow with the square of the rows: none is joined on its index or shuffled."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "MapInArrow" in plan and "array_intersect" not in plan and "Generate explode(indices" not in plan


def test_edges_of_links_are_not_shuffled_as_names(spark):
    """Links are merged by number where they are found; no edge is grouped or sorted under its names."""
    plan = QUERIES["G1_G2_A11_merged_edges"](spark, DATA)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "MapInArrow" in plan and "hashpartitioning(src" not in plan and "array_intersect" not in plan


def test_top_communities_are_the_same_in_small_blocks(spark, monkeypatch):
    rows = lambda: sorted((r.size, round(r.score, 9)) for r in QUERIES["K2_list_communities"](spark, DATA).collect())
    whole = rows()
    monkeypatch.setattr("ringspan.operators.shares.BLOCK_ROWS", 300)
    assert rows() == whole != []


def test_members_go_to_the_attributes(spark):
    """However large the tables: edges, which are many, stay where they are."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(i, i // 2, "device") for i in range(20)], "identity bigint, attribute bigint, kind string")
        found = G.shared_attributes(edges.select((F.col("identity") % 3).alias("community"), "identity"), edges.union(edges.selectExpr("identity + 3", "attribute", "kind")))
        plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        held = Counter((i % 3, a) for i, a in {(i, i // 2) for i in range(20)} | {(i + 3, i // 2) for i in range(17)})
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {(r.community, r.incidences) for r in found.collect()} == {(c, n) for c in range(3) if (n := sum(k for (x, _), k in held.items() if x == c and k > 1))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_device_neighbours_need_no_links(spark):
    """Links join identities, so that no near duplicate is looked for, and the graph's edges to devices are all there."""
    plan = QUERIES["G9_device_neighbours"](spark, DATA)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "MapInArrow" not in plan
    whole = graph_queries.graph(spark, DATA).filter("src LIKE 'device:%' OR dst LIKE 'device:%'")
    only = G.build(graph_queries.people(spark, DATA), graph_queries.auth(spark, DATA), end="device")
    assert 0 < only.count() == whole.count() and whole.exceptAll(only).isEmpty()
