"""Properties of the operators, held against small models in plain Python."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspan import schema
from ringspan import simulate as Z
from ringspan.functions import images as I
from ringspan.functions import scalars as M
from ringspan.functions import sketches as H
from ringspan.operators import decision as D
from ringspan.operators import graph as G
from ringspan.operators import metrics as E
from ringspan.operators import narrative as N
from ringspan.operators import pairs as P
from ringspan.operators import windows as W
from ringspan.sources import config, streams


def entropy_of(suffixes):
    if len(suffixes) < 3:
        return 1.0
    try:
        n = sorted(map(int, suffixes))
    except ValueError:
        return 1.0
    gaps = [b - a for a, b in zip(n, n[1:]) if b > a]  # noqa: B905
    if not gaps:
        return 0.0
    levels = Counter(len(str(g)) for g in gaps)
    return min(1.0, -sum(c / len(gaps) * math.log2(c / len(gaps)) for c in levels.values()) / math.log2(6))


def regularity_of(times):
    if len(times) < 3:
        return 1.0
    t = np.sort(times)
    gaps = np.diff(t)
    return 0.0 if gaps.mean() <= 1e-9 else min(2.0, gaps.std() / gaps.mean())


def test_entropy_and_regularity(spark):
    rng = random.Random(1)
    cases = [[], ["1"], ["1", "2"], ["000001", "000002", "000003"], ["1", "x", "3"], ["5", "5", "5"], ["1", "11", "1011", "1012"], ["0", "10", "110"], ["999999", "0", "1000"]] + [[str(rng.randrange(10 ** rng.randrange(1, 7))) for _ in range(rng.randrange(3, 20))] for _ in range(60)]
    times = [[rng.choice([1.0, 5.0, 7.5]) * i + rng.random() for i in range(rng.randrange(0, 12))] for _ in cases]
    df = spark.createDataFrame(list(enumerate(zip(cases, times, strict=True))), "i int, v struct<s:array<string>,t:array<double>>")
    for r in df.select("i", M.pan_entropy(F.col("v.s")).alias("e"), M.timing_regularity(F.col("v.t")).alias("c")).collect():
        assert r.e == pytest.approx(entropy_of(cases[r.i])) and r.c == pytest.approx(regularity_of(times[r.i]), abs=1e-9)


def test_digit_entropy_and_peak(spark):
    df = spark.createDataFrame([(1, ["123"]), (2, ["1111", "1111"]), (3, ["0123456789"])], "i int, s array<string>")
    assert [round(r[0], 9) for r in df.orderBy("i").select(M.digit_entropy(F.col("s"))).collect()] == [1.0, 0.0, 1.0]


def test_windows_see_only_the_past(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), seq, rng.choice([0, 5, 10, 3600, 3605, 7200]) * 1_000_000) for seq in range(40)]
    df = spark.createDataFrame(rows, "account int, seq int, us bigint")
    got = {r.seq: r.n for r in df.select("seq", F.size(W.tie_safe(["account"], 3600, {})).alias("n")).collect()}
    assert got == {s: sum(a2 == a and u - 3_600_000_000 <= u2 <= u and (u2 < u or s2 < s) for a2, s2, u2 in rows) for a, s, u in rows}


def test_slices_change_nothing(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(2), s, rng.randrange(40 * 86_400) * 1_000_000 + s, rng.randrange(5), f"m{rng.randrange(4)}", f"{rng.randrange(999):06d}", rng.random() * 20, rng.random() < 0.5, rng.choice(["approved", "declined_risk"]), "match", "match") for s in range(300)]
    auth = spark.createDataFrame(rows, "account int, seq int, us bigint, card int, merchant string, suffix string, amount double, zero_auth boolean, response_code string, avs_result string, cvv_result string")
    plain, cut = W.flags(auth).withColumns(W.account_windows(auth)), W.account_features(auth)
    names = ["seq", *W.account_windows(auth)]
    a, b = ({r.seq: tuple(round(float(x), 9) for x in r) for r in df.select(names).collect()} for df in (plain, cut))
    assert a == b


def test_running_totals(spark):
    from ringspan.operators.ordered import running_totals

    rows = [(i * 37 % 1009 / 10, i % 5) for i in range(1000)]
    got = {r.k: r.t for r in running_totals(spark.createDataFrame(rows, "k double, v int"), "k", {"t": "v"}, parts=16).collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v


def test_all_features(spark):
    rows = [(s, s * 600_000_000, "t", 1, "m1", 5, "000005", 3.0, s % 2 == 0, "approved", "match", "match", 1, 1, 1) for s in range(5)]
    auth = spark.createDataFrame(rows, "seq bigint, us bigint, t string, account int, merchant string, card int, suffix string, amount double, zero_auth boolean, response_code string, avs_result string, cvv_result string, device int, ip int, institution int")
    out = W.stream_features(auth.withColumn("ts", F.timestamp_micros("us")))
    assert set(W.FEATURES) <= set(out.columns) and len(W.FEATURES) == 54
    first = out.filter("seq = 0").first()
    assert (first.acct_n_7d, first.acct_age_days, first.acct_is_new_merchant, first.acct_known_merchants) == (0, 0.0, 1, 0)
    with pytest.raises(schema.LeakageError):
        schema.refuse_evaluation_columns(out.withColumn("ring_id", F.lit(1)))


def test_guarded_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(12)) for i in range(60)]
    got = {(r.left, r.right) for r in P.guarded_pairs(spark.createDataFrame(rows, "identity int, t int"), "t", "identity", 2, 5).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {p for g in groups.values() if 2 <= len(g) <= 5 for p in itertools.combinations(sorted(g), 2)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 1.0])
def test_prefix_join_is_exact(spark, threshold):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(40), rng.randrange(1, 12))) for _ in range(80)] + [[1, 2, 3], [1, 2, 3]]
    got = {(r.left, r.right) for r in P.overlapping(spark.createDataFrame(list(enumerate(sets)), "identity int, indices array<int>"), threshold).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len({*sets[i]} & {*sets[j]}) >= threshold * len({*sets[i]} | {*sets[j]}) - 1e-12}


def best_first(edges, seeds, hops=3, least=0.02):
    """Settles nodes from the highest score down, as a heap would."""
    near = defaultdict(list)
    for a, b, c in edges:
        near[a].append((b, c))
    done, heap = {}, [(-1.0, 0, s, s) for s in seeds]
    while heap:
        heap.sort()
        score, h, source, node = heap.pop(0)
        if node in done:
            continue
        done[node] = (-score, h)
        if h < hops:
            heap += [(score * c, h + 1, source, b) for b, c in near[node] if b not in done and -score * c >= least]
    return {n: v for n, v in done.items() if n not in seeds}


@pytest.mark.parametrize("seed", range(3))
def test_propagation(spark, seed):
    rng = random.Random(seed)
    nodes = [f"identity:{i}" for i in range(14)] + [f"device:{i}" for i in range(5)]
    edges = [(a, b, rng.choice(["owns", "observed_together", "transacted"]), rng.uniform(0.1, 4)) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.2]
    frame = spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double")
    step = G.both_ways(frame).select("src", "dst", (0.55 * G.conductance(F.col("edge_type"), F.col("dst"), F.col("weight"))).alias("c")).collect()
    got = {r.node: (r.score, r.hops) for r in G.propagate(frame, spark.createDataFrame([("identity:0", 1.0)], "node string, score double")).collect()}
    want = best_first([tuple(r) for r in step], ["identity:0"])
    assert got.keys() == want.keys() and all(got[n] == (pytest.approx(want[n][0], abs=1e-9), want[n][1]) for n in got)


def test_first_edge_type_wins(spark):
    edges = spark.createDataFrame([("a", "b", "observed_together", 1.0, "x", 2.0), ("b", "a", "owns", 0.5, "y", 1.0), ("a", "b", "similar_tag", 0.25, None, 3.0)], "src string, dst string, edge_type string, weight double, institution string, seq double")
    r = G.merge_edges(edges).first()
    assert (r.src, r.dst, r.weight, r.n, r.institutions, r.edge_type) == ("a", "b", 1.75, 3, ["x", "y"], "owns")


def test_communities_find_planted_groups(spark):
    rng, edges = random.Random(6), []
    for g in range(3):
        for i, j in itertools.combinations(range(8), 2):
            if rng.random() < 0.8:
                edges.append((10 * g + i, 10 * g + j, 1.0, {"device": 1}))
    edges += [(0, 10, 0.1, {"ip_asn": 1}), (11, 20, 0.1, {"ip_asn": 1})]
    members, table = G.communities(spark.createDataFrame(edges, "left int, right int, weight double, tags map<string,bigint>"))
    groups = defaultdict(set)
    for r in members.collect():
        groups[r.community].add(r.identity)
    assert sorted(map(sorted, groups.values())) == [[10 * g + i for i in range(8)] for g in range(3)]
    for r in table.collect():
        assert r.score == pytest.approx(G.expected_score(r.cohesion, r.suspicion, r.size))
    truth = spark.createDataFrame([(10 * g + i, f"r{g}") for g in range(3) for i in range(8)] + [(99, "lost")], "identity int, ring string")
    ranked = table.select("community", F.col("size").cast("int").alias("rank"))
    found = {r.ring: r for r in G.match_rings(members, ranked, truth).collect()}
    assert found["r0"].f1 == 1.0 and (found["lost"].f1, found["lost"]["rank"]) == (0.0, -1)


@pytest.mark.parametrize("fpr", [0.0, 0.05, 0.2, 1.0])
def test_threshold_is_lowest_that_holds(spark, fpr):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(12) / 11) for _ in range(150)]
    df = spark.createDataFrame(rows, "y int, score double")
    neg = [s for y, s in rows if y == 0]
    fits = [s for s in {s for _, s in rows} if sum(n >= s for n in neg) <= fpr * len(neg)]
    assert E.threshold_at_fpr(df, fpr).first()[0] == (min(fits) if fits else math.inf)
    pairs = [(p > n) + 0.5 * (p == n) for y, p in rows if y for z, n in rows if not z]
    assert E.rank_auc(df).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_point_in_time_and_positives(spark):
    labels = spark.createDataFrame([(1,), (9,)], "label_available_at int")
    assert E.point_in_time(labels, F.lit(5)).count() == 1
    with pytest.raises(schema.LeakageError):
        E.point_in_time(labels, F.lit(5), strict=True)
    with pytest.raises(ValueError):
        E.enough_positives(spark.createDataFrame([(1,)], "y int"))


def test_decisions(spark):
    rows = [(i / 100,) for i in range(101)]
    got = [r[0] for r in spark.createDataFrame(rows, "s double").orderBy("s").select(D.band(F.col("s"))).collect()]
    assert [got.index(b) for b in ("low", "medium", "elevated", "high", "confirmed")] == [0, 30, 55, 75, 90]
    df = spark.createDataFrame([(b / 10, o / 10) for b in range(11) for o in range(11)], "b double, o double")
    assert df.filter(D.fuse_forward(F.col("b"), F.col("o")) < F.col("b") - 1e-12).count() == 0
    cards = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("card"))
    ok = cards.select(D.honeypot(F.col("card")).alias("h")).filter("h.response_code = 'approved'").count()
    assert 0.01 <= ok / 2000 <= 0.12
    assert set(D.TRIGGERS) <= set(D.REASONS) and len(D.REASONS) == 23
    shape = D.decide(spark.createDataFrame([(0.8, 0.0, None, False, "network", 0)], "score double, onboarding double, ring string, propagated boolean, view string, cross_hits int")).first()
    assert (shape.band, shape.action, shape.reason_codes) == ("high", "honeypot", ["velocity_spike"])


def test_sketches(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=128)
    h, other = H.FlyHash(128), H.FlyHash(128, seed_id="other")
    near, far = h.tags(np.stack([base, base + 0.05 * rng.normal(size=128), 3 * base, rng.normal(size=128)])), other.tags(base[None])
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    assert like(near[0], near[1]) > 0.5 and near[0] == near[2] and like(near[0], near[3]) < 0.12 and like(near[0], far[0]) < 0.12
    assert h.tags(base[None])[0] == near[0] == H.FlyHash(128).tags(base[None])[0]
    df = spark.createDataFrame([(1, near[0]), (2, near[1]), (3, near[3])], "g int, indices array<int>")
    back = df.select("indices", H.unbind(H.bind(F.col("indices"), "face", 4096), "face", 4096).alias("b")).collect()
    assert all(list(r.b) == list(r.indices) for r in back)
    est = {r.g: r.s for r in df.select("g", H.minhash(F.col("indices"), 200).alias("s")).collect()}
    assert abs(sum(a == b for a, b in zip(est[1], est[2], strict=True)) / 200 - like(near[0], near[1])) < 0.15
    with pytest.raises(ValueError):
        H.check_bundle(spark.createDataFrame([((1, "a"),), ((1, "b"),)], "tag struct<dim:int,seed_id:string>"))
    tag = df.select(H.categorical_tag(F.col("g"), 4096, 50, "s").alias("t"), H.identity_hypervector({"face": F.col("indices"), "doc": F.col("indices")}, 4096, 100).alias("v")).first()
    assert len(set(tag.t)) == 50 and len(set(tag.v)) == 100


def test_bloom_has_no_false_negatives(spark):
    bits, hashes = H.bloom_size(300, 0.01)
    df = spark.range(300).select(F.col("id").alias("v"))
    words = H.bloom_words(df, "v", bits, hashes, "s")
    assert H.bloom_contains(df, "v", words, bits, hashes, "s").filter("NOT present").count() == 0
    others = spark.range(1000, 2000).select(F.col("id").alias("v"))
    assert H.bloom_contains(others, "v", words, bits, hashes, "s").filter("present").count() < 40


def test_images():
    rng = np.random.default_rng(2)
    who, other = rng.normal(size=64), rng.normal(size=64)
    a, b, c = (I.descriptor(I.face(w, rng)) for w in (who, who, other))
    assert np.corrcoef(a, b)[0, 1] > 0.8 > np.corrcoef(a, c)[0, 1] + 0.2
    real, fake = I.artifacts(I.face(who, rng)), I.artifacts(I.face(who, rng, synthetic=True, strength=1.6))
    assert fake["spectral_peak_ratio"] > real["spectral_peak_ratio"]
    grids = [I.ink_grid(I.layout(t, rng)) for t in (1, 1, 2)]
    assert np.abs(grids[0] - grids[1]).mean() < np.abs(grids[0] - grids[2]).mean()
    image = (I.face(who, rng) * 255).astype(np.uint8)
    raw = b"P6 64 64 255\n" + image.tobytes()
    assert np.allclose(I.parse_ppm(raw), image / 255)


def test_image_statistics_by_hand():
    flat, spot = np.zeros((10, 10)), np.zeros((10, 10))
    spot[4, 5] = 1.0
    # the residual of a spot: 4 in the middle and -1 at its four neighbours, among 64 values
    assert sorted(I.laplacian(spot).ravel())[:5] == [-1, -1, -1, -1, 0] and I.laplacian(spot).sum() == 0 and I.laplacian(spot).max() == 4
    g2 = ((4**4 + 4) / 64) / ((16 + 4) / 64) ** 2 - 3
    assert abs(I.kurtosis(I.laplacian(spot)) - 63 / (62 * 61) * (65 * g2 + 6)) < 1e-9 and I.kurtosis(I.laplacian(flat)) == 0
    # its spectrum is 4 - 2 cos(2 pi u / 8) - 2 cos(2 pi v / 8): 4, 2, 2, 4 at the quarter frequencies
    power = lambda u, v: 4 - 2 * np.cos(np.pi * u / 4) - 2 * np.cos(np.pi * v / 4)
    ring = [np.median([power(u + a, v + b) for a in (-3, -2, 2, 3) for b in (-3, -2, 2, 3)]) for u, v in ((2, 2), (2, 0), (0, 2), (2, -2))]
    assert abs(I.spectral_peaks(I.laplacian(spot)) - 3 / np.mean(ring)) < 1e-9 and I.spectral_peaks(I.laplacian(flat)) == 0
    x = np.linspace(0, 1, 100).reshape(10, 10)
    assert abs(I.channel_anomaly(np.stack([x, 2 * x, -x], 2)) - 1) < 1e-9 and I.channel_anomaly(np.stack([x, flat, flat], 2)) == 0
    # |r| = 1 for one pair and 0 for two: a mean of 1/3, below 0.85
    odd = np.where(np.arange(100) % 2, 1.0, -1.0).reshape(10, 10)
    even = np.where(np.arange(100) // 2 % 2, 1.0, -1.0).reshape(10, 10)
    assert I.channel_anomaly(np.stack([odd, -odd, even], 2)) == 0
    clipped = np.full((2, 2, 3), 0.5)
    clipped[0, 0], clipped[1, 1, 0] = 1.0, 0.004
    assert I.artifacts(np.pad(clipped, ((1, 1), (1, 1), (0, 0)), constant_values=0.5))["saturation_clip_ratio"] == 4 / 48
    assert np.allclose(I.luminance(np.array([[[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]])), [[0.299, 0.587, 0.114]])
    # a pure cosine of 3 rows and 2 columns is one coefficient, number 10 * 3 + 2 less the constant's
    y, z = (np.arange(64) + 0.5) / 64, (np.arange(64) + 0.5) / 64
    wave = 0.5 + 0.2 * np.cos(np.pi * 3 * y)[:, None] * np.cos(np.pi * 2 * z)
    found = np.abs(I.descriptor(wave))
    assert len(found) == 99 and found.argmax() == 31 and abs(np.linalg.norm(I.descriptor(wave + 0.2)) - np.linalg.norm(found)) < 1e-6
    assert np.allclose(I.descriptor(np.full((64, 64), 0.3)), 0)


def test_image_corpus_and_its_fallback(spark, tmp_path):
    rng = np.random.default_rng(4)
    pictures = {f"{i}.ppm": (rng.random((12, 10, 3)) * 255).round() / 255 for i in range(3)}
    for name, picture in pictures.items():
        (tmp_path / name).write_bytes(I.ppm(picture))
    (tmp_path / "notes.txt").write_text("no image")
    found = {r.path.rpartition("/")[2]: I.parse_ppm(bytes(r.content)) for r in I.image_corpus(spark, f"file://{tmp_path}").collect()}
    assert found.keys() == pictures.keys() and all(np.allclose(found[k], pictures[k]) for k in pictures)
    for path in (None, f"file://{tmp_path}/nowhere"):
        assert I.image_corpus(spark, path, fallback=5).count() == 5
    one, again = (I.image_features(I.image_corpus(spark, None, fallback=3)).collect() for _ in range(2))
    assert one == again and len(one) == 3 and len(one[0].descriptor) == 99


def test_scenarios_and_rules(tmp_path):
    tiny = config.load_scenario("tiny")
    assert (tiny["seed"], tiny["ring"]["n_rings"], tiny["ring"]["burst_intensity"]) == (7, 2, 45.0)
    with pytest.raises(ValueError, match="sophisticated"):
        config.load_scenario("none")
    with pytest.raises(KeyError):
        config.merged(config.DEFAULTS, {"nothing": 1})
    yaml = pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(yaml.safe_dump({"thresholds": {"high": 0.8}, "triggers": {"velocity_spike": {"feature": "x", "above": 2}, "unknown": {"feature": "y", "below": 1}}}))
    rules = config.load_rules(str(tmp_path / "r.yaml"))
    assert rules["thresholds"]["high"] == 0.8 and rules["triggers"] == {"velocity_spike": ("x", "above", 2.0)}


def test_generated_scenario(spark, tmp_path):
    cfg = config.load_scenario("tiny")
    data = {k: v.cache() for k, v in Z.generate(spark, cfg).items()}
    checks = {r.check: r.ok for r in Z.verify(data, cfg).collect()}
    # a tiny world holds more fraud than the share that full scenarios aim at
    assert all(ok for name, ok in checks.items() if name != "fraud rate on target"), checks
    for name, df in data.items():
        assert df.filter(schema.violations(df, name) > 0).count() == 0 if name != "ground_truth" else True
        schema.refuse_raw_personal(df)
        streams.write_stream(df, str(tmp_path), name)
    again = Z.generate(spark, cfg)["auth_events"].repartition(7)
    assert again.agg(F.bit_xor(F.xxhash64("event_id", "ts", "amount"))).first() == data["auth_events"].agg(F.bit_xor(F.xxhash64("event_id", "ts", "amount"))).first()
    whole = streams.load(spark, str(tmp_path))
    some = streams.institutions_in(spark, str(tmp_path)).first()[0]
    scoped = streams.load(spark, str(tmp_path), "issuer", some)
    assert 0 < scoped.auth_events.count() < whole.auth_events.count() and scoped.ground_truth.count() == whole.ground_truth.count()
    assert streams.load(spark, str(tmp_path), limit=5).auth_events.count() == 5
    with pytest.raises(ValueError):
        streams.load(spark, str(tmp_path), "merchant")
    with pytest.raises(PermissionError):
        streams.Vault().resolve("x")
    found = streams.manifest(whole, cfg)
    assert found["n_fraud_events"] > 0 and len(found["ring_sizes"]) == 2
    streams.write_report(spark, found, f"{tmp_path}/meta.json")


def test_settings_of_the_simulator_take_effect(spark):
    tiny = config.load_scenario("tiny")

    def traffic(**over):
        cfg = config.merged(tiny, over)
        return Z.traffic(Z.people(spark, cfg), cfg)

    of = lambda df, cohort: df.filter(F.col("cohort") == cohort)
    most = lambda df, c: df.groupBy("id").agg(F.countDistinct(c).alias("n")).agg(F.max("n")).first()[0]
    base = traffic().cache()
    still = traffic(population={"p_device_change": 0.0, "p_travel": 0.0, "p_move": 0.0, "devices_min": 1, "devices_max": 1}).cache()
    assert most(of(still, "customer"), "device") == most(of(still, "customer"), "subnet") == 1 < most(of(base, "customer"), "device")
    assert of(still, "traveller").filter("subnet LIKE '%_away'").count() > 0 and of(still, "new_device").filter("device LIKE '%_new'").count() > 0
    assert of(traffic(population={"p_move": 1.0}), "customer").filter("subnet LIKE '%_moved'").count() > 0
    tests = lambda df: df.filter("kind = 'test'").count()
    assert tests(traffic(ring={"n_bursts_per_account": 2, "dormancy_days_min": 2, "dormancy_days_max": 3})) > 1.5 * tests(traffic(ring={"dormancy_days_min": 2, "dormancy_days_max": 3}))
    mean = lambda df: of(df, "small_business").agg(F.avg(F.log("amount"))).first()[0]
    assert abs(mean(base) - 2.1) < 0.4 < mean(traffic(lookalikes={"small_business_amount_mu": 4.0})) - mean(base)
    drift = lambda mult: config.merged(tiny, {"drift": {"enabled": True, "at_fraction": 0.0, "device_reuse_mult": mult}, "ring": {"device_reuse_rate": 1.0}})
    shared = lambda cfg: Z.people(spark, cfg).filter("ring IS NOT NULL AND device LIKE 'r%'").count()
    assert shared(drift(0.0)) == 0 < shared(drift(1.0))
    near = lambda jitter: config.merged(tiny, {"ring": {"face_jitter": jitter, "face_reuse_rate": 1.0}})

    def overlap(cfg):
        folk = Z.people(spark, cfg)
        tags = [set(r.face_tag.indices) for r in Z.portraits(folk.filter("face = 'r0_0'"), cfg).collect()]
        return np.mean([len(a & b) / len(a | b) for a, b in itertools.combinations(tags, 2)])

    assert overlap(near(0.02)) > overlap(near(0.8)) + 0.2


def test_beta_draws(spark):
    d = Z.Draws(5)
    for a, b in ((8.0, 1.6), (1.8, 4.0)):
        m, v, low, high = spark.range(20_000).select(d.beta("x", a, b, "id").alias("x")).agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
        assert abs(m - a / (a + b)) < 0.01 and abs(v - a * b / ((a + b) ** 2 * (a + b + 1))) < 0.004 and 0 <= low < high <= 1


def test_narratives(spark):
    schema_ = "community string, size bigint, cohesion double, suspicion double, institutions array<string>, shared array<string>, signals array<string>, seed string, flagged int, dormant int, hops int, via string, path_score double, reasons array<string>"
    rows = [("c1", 5, 0.5, 0.9, ["a", "b"], ["3 shared addresses"], ["decline ratio 4.0x above"], "idn_1", 4, 2, 2, "owns -> owns", 0.31, ["ring_membership"]), ("c2", 4, 0.1, 0.2, [], [], [], None, 0, 0, 0, None, 0.0, [])]
    text = {r.community: r.narrative for r in N.narrate(spark.createDataFrame(rows, schema_)).collect()}
    assert text["c2"] == "Group: c2; members 4; cohesion 0.10; suspicious share of ties 0.20\nState: unconfirmed\nNext: keep under watch; structure by itself is not grounds for a block"
    lines = dict(x.split(": ", 1) for x in text["c1"].split("\n"))
    assert lines["Seen at"] == "a, b" and lines["Reach"] == "from idn_1; flagged 4; never transacted 2" and lines["Strongest path"] == "owns -> owns; hops 2; score 0.310"
    assert "shared-attribute density" in lines["Reasons"] and lines["State"] == "dormant members in reach"


def test_moves_and_costs(spark):
    drawn = Z.moves(spark, 60, 3).collect()
    by = {i: {r.knob: r.step for r in drawn if r.round == i} for i in range(60)}
    assert {len(v) for v in by.values()} == {2, 3, 4} and len({k for v in by.values() for k in v}) == len(M.KNOBS)
    low, high = ({k: M.KNOBS[k][i] for k in M.KNOBS} for i in (0, 1))
    for v in by.values():
        after = Z.moved(low, v)
        assert all(M.KNOBS[k][0] <= after[k] <= M.KNOBS[k][1] for k in after) and all(after[k] == round(after[k]) for k in Z.WHOLE & set(v))
    cheap = {k: M.KNOBS[k][0] if w > 0 else M.KNOBS[k][1] for k, w in M.KNOB_COST.items()}
    assert Z.cost_of(low | cheap) == 0 and Z.cost_of(low | {k: M.KNOBS[k][1] if w > 0 else M.KNOBS[k][0] for k, w in M.KNOB_COST.items()}) == 1
    found = Z.red_team(spark, low, lambda p: 0.5, rounds=5)
    assert len(found) == 6 and all(abs(x["objective"] - 0.5 - 0.35 * x["cost"]) < 1e-12 for x in found)


def test_model_round_trip(spark, tmp_path):
    from ringspan.operators.models import TrainedModel, train

    rng = random.Random(9)
    rows = [(y, y + rng.gauss(0, 0.5), rng.random()) for y in (0, 1) for _ in range(80)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    model = train(df, ["a", "b"], fpr=0.05, trees=3, depth=2)
    again = TrainedModel.load(spark, model.save(f"file://{tmp_path}/m"))
    p, q = (sorted(r.score for r in m.predict(df).collect()) for m in (model, again))
    assert p == q and 0 <= p[0] < p[-1] <= 1 and again.threshold_at_target_fpr == model.threshold_at_target_fpr


@pytest.mark.parametrize("way", ["prefixes", "cells"])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 1.0])
def test_both_ways_of_the_jaccard_join_are_exact(spark, threshold, way):
    """Sets of one or of many sizes, over two words of bits and more blocks than one; an empty set has no partner."""
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(100), rng.randrange(1, 12))) for _ in range(60)] + [sorted(rng.sample(range(8), 4)) for _ in range(60)] + [[], [1, 2, 99], [1, 2, 99]]
    tags = spark.createDataFrame([(f"n{i}", s) for i, s in enumerate(sets)], "identity string, indices array<int>")
    if way == "prefixes":
        found = P.by_prefixes(tags, threshold)
    else:
        found = P.in_cells([(tags, threshold, 0)], 2, 5000)
    got = sorted((r.left, r.right, r.weight) for r in found.collect())
    like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = [(*sorted((f"n{i}", f"n{j}")), like(sets[i], sets[j])) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and like(sets[i], sets[j]) >= threshold]
    assert got == sorted(want) and len(want) > 2


def test_common_indices_make_no_joined_candidates(spark):
    """16 of 64 indices: prefixes join nearly all pairs many times over, so the sets go to cells."""
    rng = random.Random(6)
    tags = spark.createDataFrame([(i, rng.sample(range(64), 16)) for i in range(200)], "identity int, indices array<int>")
    plan = P.overlapping(tags, 0.3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    rare = spark.createDataFrame([(i, [i, i + 1, 4000]) for i in range(200)], "identity int, indices array<int>")
    assert "Join" in P.overlapping(rare, 0.9)._jdf.queryExecution().toString()


def test_links_are_merged_where_near_duplicates_are_found(spark):
    """In cells, by prefixes, or both: one row a pair, of tokens and of two kinds of tag."""
    rng = random.Random(7)
    near = {f"near_duplicate:{k}": (spark.createDataFrame([(i, rng.sample(range(64), 16)) for i in range(90)], "identity bigint, indices array<int>"), 0.3) for k in ("face", "hypervector")}
    plain = spark.createDataFrame([(*sorted(rng.sample(range(100), 2)), rng.choice(["shared:device", "pii_recombination:dob", "email_shape"]), 0.5) for _ in range(2000)], "left bigint, right bigint, kind string, weight double")
    want = defaultdict(list)
    for r in P.resolve(plain, *[P.by_prefixes(t, threshold, kind) for kind, (t, threshold) in near.items()]).collect():
        want[r.left, r.right].append((next(i for i, p in enumerate(P.PRIORITY) if r.kind.startswith(p)), r.weight))
    for found in (P.merged(plain, near), P.merged(P.resolve(plain, *[P.by_prefixes(t, threshold, kind) for kind, (t, threshold) in near.items()]))):
        got = {(r.left, r.right): r for r in found.collect()}
        assert found.count() == len(got) == len(want)
        assert all((got[k].n, got[k].seq) == (len(v), min(s for s, _ in v)) and got[k].weight == pytest.approx(sum(w for _, w in v)) for k, v in want.items())
    assert "MapInArrow" in P.merged(plain, near)._jdf.queryExecution().toString()


def test_ties_of_propagation_go_by_hops_source_and_name(spark):
    """Three ways of one score reach node x; the edges are neither shuffled nor sorted for the best score."""
    edges = spark.createDataFrame([("identity:1", "device:10", "observed_together", 1.0), ("identity:2", "device:9", "observed_together", 1.0), ("device:10", "identity:7", "observed_together", 1.0), ("device:9", "identity:7", "observed_together", 1.0), ("identity:2", "device:10", "observed_together", 1.0)], "src string, dst string, edge_type string, weight double")
    got = {r.node: r for r in G.propagate(edges, spark.createDataFrame([("identity:1", 1.0), ("identity:2", 1.0)], "node string, score double")).collect()}
    assert (got["device:10"].source, got["device:9"].source) == ("identity:1", "identity:2")
    assert (got["identity:7"].hops, got["identity:7"].source, [h.to_node for h in got["identity:7"].path]) == (2, "identity:1", ["device:10", "identity:7"])


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    import glob

    from ringspan.operators.storage import CLEANUP, written

    folder = spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    files = lambda: {*glob.glob(f"{folder}/**/shuffle_*.data", recursive=True), *glob.glob(f"{folder}/../blockmgr-*/**/shuffle_*.data", recursive=True)}
    before, was = files(), spark.conf.get(CLEANUP, None)
    made = written(spark.range(50_000).groupBy((F.col("id") % 20_000).alias("k")).count(), "cleaned")
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(CLEANUP, None) == was and made.count() == 20_000


def test_summary_counts_edges_by_their_ends(spark):
    edges = spark.createDataFrame([("a:1", "b:1"), ("a:1", "b:2"), ("a:2", "b:1")], "src string, dst string")
    assert {tuple(r) for r in G.summary(edges).collect()} == {("a", 2), ("b", 2), ("edges", 3)}
    assert {tuple(r) for r in G.summary(edges.filter("src = 'c'")).collect()} == {("edges", 0)}


@pytest.mark.parametrize("size", [6, 60])
def test_louvain_on_arrays_finds_planted_groups(size):
    """Groups of few and of many neighbours, a loop, and two rows of one pair; 300,000 edges take seconds, not minutes."""
    rng = random.Random(8)
    rows = [(size * c + i, size * c + j, 1.0) for c in range(170) for i in range(size) for j in range(i)] + [(rng.randrange(170 * size), rng.randrange(170 * size), 0.05) for _ in range(500)]
    rows += [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5)]
    left, right, weight = map(np.array, zip(*rows, strict=True))
    began = time.time()
    nodes, roots = G._louvain(left, right, weight, 2 * weight.sum(), 1.0, 7)
    assert time.time() - began < 60
    found = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    assert len(found) == 170 * size and all(len({found[size * c + i] for i in range(size)}) == 1 for c in range(170))
    assert all(r <= n for n, r in found.items()) and len({*found.values()}) > 20


@pytest.mark.parametrize(("rows", "at_once"), [(500_000, 1 << 19), (150, 40)])
def test_projected_pairs_are_added_up_in_blocks(spark, monkeypatch, rows, at_once):
    """Every pair once, with each attribute it shares; no pair is joined or shuffled, and unknown attributes join nobody."""
    monkeypatch.setattr("ringspan.operators.shares.BLOCK_ROWS", rows)
    monkeypatch.setattr("ringspan.operators.shares.AT_ONCE", at_once)
    rng = random.Random(5)
    held = [(rng.randrange(90) - 7, rng.randrange(60), rng.choice([*G.PROJECTED, "merchant"])) for _ in range(3000)] + [(1, None, "device"), (2, None, "device"), (None, 3, "device")]
    found = G.project(spark.createDataFrame(held, "identity bigint, attribute bigint, kind string"), owners=(2, 9))
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "MapInArrow" in plan and "Join" not in plan
    owners, want = defaultdict(set), defaultdict(list)
    for identity, attribute, kind in held:
        if attribute is not None and kind in G.PROJECTED:
            owners[kind, attribute].add(identity)
    for (kind, _), who in owners.items():
        if 2 <= len(who) <= 9:
            for pair in itertools.combinations(sorted(who - {None}), 2):
                want[pair].append((kind, G.SHARE[kind] / math.sqrt(len(who) - 1)))
    got = {(r.left, r.right): r for r in found.collect()}
    assert found.count() == len(got) and set(got) == set(want) and len(got) > 500
    assert all(got[k].tags == dict(Counter(kind for kind, _ in v)) and got[k].weight == pytest.approx(sum(w for _, w in v)) for k, v in want.items())


def test_stars_join_what_the_edges_join(spark):
    from ringspan.operators.components import components, stars

    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(2000)] + [(5000 + rng.randrange(200), 5000 + rng.randrange(200)) for _ in range(90)] + rng.sample(chain, len(chain)), "a bigint, b bigint").repartition(3)
    few = stars(edges)
    assert few.count() <= 3 * 661 - 3
    assert {tuple(r) for r in components(few).collect()} == {tuple(r) for r in components(edges).collect()}
