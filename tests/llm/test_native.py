import hashlib
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ringspan.llm import fingerprints, mixing, quality_rules
from ringspan.llm.common import fresh

from .test_fixtures import DOCS, documents, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_match_brute_force(spark):
    found = quality_rules.ledger(frame(spark).withColumn("n_words", F.lit(-1))).collect()
    want = Counter((r[0], *measures(r[1])) for r in documents())
    assert Counter((r.doc_id, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]) for r in found) == want


def test_policies_and_ablations(spark):
    led = quality_rules.ledger(frame(spark))
    rows = quality_rules.apply_policy(led).collect()
    assert {r.doc_id for r in rows if r.kept} >= {1, 2, 3, 9} and not any(r.kept for r in rows if r.doc_id in (4, 5, 6, 7, 8))
    table = {(r.version, r.rule): r for r in quality_rules.ablations(led).collect()}
    for version, rules in quality_rules.POLICIES.items():
        mask = quality_rules.mask_of(rules)
        for rule in rules:
            bit, one = quality_rules.mask_of([rule]), table[version, rule]
            failed = [r.failed & mask for r in rows]
            assert (one.n_failed, one.n_only, one.n_kept) == (sum(f & bit > 0 for f in failed), sum(f == bit for f in failed), sum(f == 0 for f in failed))


def test_keep_good_keeps_columns_and_rows(spark):
    kept = quality_rules.keep_good(frame(spark))
    assert kept.columns == frame(spark).columns
    assert Counter(r.doc_id for r in kept.collect())[2] == 2


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_edits_and_order(spark):
    rows = sorted([(r[0], r[1] or "") for r in documents()], key=lambda r: (r[0] is None, -(r[0] or 0), -spark_hash(r[1].encode())))
    found = fingerprints.with_next(frame(spark)).withColumn("like", fingerprints.likeness(F.col("_bins"), F.col("next_bins"))).collect()
    want = Counter((rows[i][0], rows[i][1], rows[(i + 1) % len(rows)][1]) for i in range(len(rows)))
    assert Counter((r.doc_id, r.text, r.next_text) for r in found) == want
    for r in found:
        a, b = shingle_set(r.text), shingle_set(r.next_text)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert 0 <= r.like <= 1 and abs(r.like - true) < 0.25
        if r.text == r.next_text:
            assert r.like == 1.0


def spark_hash(data, seed=42):
    """Spark's xxhash64 of one string or long."""
    return xxhash.xxh64_intdigest(data, seed) - (xxhash.xxh64_intdigest(data, seed) >> 63 << 64)


def bins_of(text):
    """One-permutation MinHash in plain Python: 128 bins by the top bits of 63, low 8 bits kept, empty ones filled along
    their own probes."""
    words, hashes = [spark_hash(w.encode()) for w in WORD.findall(text)], set()
    for i in range(max(len(words) - 4, min(1, len(words)))):
        h = 42
        for w in words[i : i + 5] if len(words) >= 5 else words:
            h = spark_hash(struct.pack("<q", w), h & (1 << 64) - 1)
        hashes.add(h & (1 << 63) - 1)
    held = {}
    for h in sorted(hashes, reverse=True):
        held[h >> 56] = h & 255
    if not held:
        return []
    out = []
    for j in range(128):
        at = (b for b in [j, *((fingerprints.STEP[j] * t + fingerprints.START[j]) % 128 for t in range(128))] if b in held)
        out.append(held[next(at)])
    return out


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256))


@pytest.mark.parametrize("rows", [documents(), [(None, prose(i, 8 + i), "en", "s") for i in range(90)] + [(3, prose(i, 12), "en", "s") for i in range(40)] + [(i, f"only {i}", "en", "s") for i in range(10, 30)], [(1, "alone", "en", "s")]])
def test_query_matches_brute_force(spark, rows):
    frame(spark, rows).repartition(3).write.parquet((folder := fresh(spark, "in")) + "/documents.parquet")
    order = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is None, -(r[0] or 0), -spark_hash(r[1].encode())))
    hexed = lambda bins: "".join(f"{x:02x}" for x in bins)
    want = Counter()
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other = bins_of(text), bins_of(edited)
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(other), round(likeness(own, other), 9), round(likeness(own, bins_of(after)), 9)] += 1
    found = fingerprints.op9_document_fingerprints(spark, folder).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want


def test_one_id_on_many_rows_is_split(spark):
    docs = frame(spark, [(7, f"text {i} of one id", "en", "s") for i in range(3000)] + [(i, "other", "en", "s") for i in range(50)])
    keyed = docs.select(F.col("doc_id").alias("_k"), F.xxhash64("text").alias("_t"))
    found = fingerprints.range_bounds(keyed, 16)
    sizes = Counter(r[0] for r in keyed.select(fingerprints.lower_bound(found, F.col("_k"), F.col("_t"))).collect())
    assert max(sizes.values()) < 500


def test_lone_document_follows_itself(spark):
    one = fingerprints.with_next(frame(spark, [(1, "a b c", "en", "s")])).collect()
    assert [(r.text, r.next_text) for r in one] == [("a b c", "a b c")]


def test_fingerprint_is_unbiased(spark):
    rows = []
    for i in range(120):
        words = [f"w{i}_{k}" for k in range(250)]
        rows.append((2 * i, " ".join(words), "en", "s"))
        rows.append((2 * i + 1, " ".join(words[:150] + [f"v{i}_{k}" for k in range(100)]), "en", "s"))
    got = {r.doc_id: r._bins for r in fingerprints.with_bins(frame(spark, rows).select("doc_id", "text"), "text", "_bins").collect()}
    pairs = [(sum(x == y for x, y in zip(got[2 * i], got[2 * i + 1], strict=True)) / 128 - 1 / 256) / (1 - 1 / 256) for i in range(120)]
    assert abs(sum(pairs) / len(pairs) - 146 / 346) < 0.02


def test_raking_meets_marginals(spark):
    rows = [(i, prose(i, 20 + i % 200), ["en", "de"][i % 3 == 0], "big" if i % 3 else f"s{i % 4}") for i in range(400)]
    docs = frame(spark, rows)
    cells, _ = mixing.probabilities(docs, rounds=60, targets={"lang": {"en": 0.5, "de": 0.5}}, fraction=0.2)
    got, total = defaultdict(float), 0.0
    for r in cells.collect():
        assert 0 <= r.prob <= 1
        got[r._lang] += r.weight
        total += r.tokens
    assert abs(got["en"] - got["de"]) < 1e-6 * total and abs(sum(got.values()) - 0.2 * total) < 1e-6 * total


def test_many_cells_give_the_same(spark, monkeypatch):
    rows = [(i, prose(i, 20 + i % 90), ["en", "de", "fr"][i % 3], f"s{i % 5}") for i in range(200)]
    docs = frame(spark, rows)
    few = {(r._source, r._lang, r._topic): r.weight for r in mixing.probabilities(docs, rounds=3)[0].collect()}
    monkeypatch.setattr(mixing, "SMALL_CELLS", -1)
    cells, said = mixing.probabilities(docs, rounds=3)
    many = {(r._source, r._lang, r._topic): r.weight for r in cells.collect()}
    assert not said and many.keys() == few.keys() and all(abs(many[k] - few[k]) < 1e-6 * (1 + few[k]) for k in few)


def test_residuals_say_how_well_marginals_are_met(spark):
    rows = [(i, prose(i, 20 + i % 200), ["en", "de"][i % 3 == 0], f"s{i % 4}") for i in range(300)]
    found = mixing.residuals(mixing.probabilities(frame(spark, rows), rounds=60, fraction=0.2)[0]).collect()
    assert {r.dimension for r in found} == set(mixing.DIMENSIONS) and all(abs(r.target - r.weight) < 1e-6 * (1 + r.target) for r in found)


def test_mixing_edge_cases(spark):
    docs = frame(spark)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(documents()) and all(0 <= r.prob <= 1 for r in mixed)
    assert len({r.taken for r in mixed if r.doc_id == 2}) == 1
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.sample(docs).count() == sum(r.taken for r in mixed)


@pytest.mark.parametrize("run", [lambda d: quality_rules.keep_good(d), lambda d: fingerprints.with_next(d), lambda d: mixing.sample(d), lambda d: quality_rules.quality(d)])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0
