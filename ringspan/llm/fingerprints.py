"""Document fingerprints by one-permutation MinHash (native).

Each word shingle is hashed once; its top bits name one of 128 bins and each bin keeps its least hash. Empty bins
are filled by optimal densification: every bin has its own random probe sequence (an affine permutation of the
bins) and takes the value of the first filled bin on it. The low 8 bits of each bin are stored, 256 hex digits in
all, and likeness is corrected for the 1/256 of bins that agree by chance.

Edge cases: a null text counts as empty; a text without words has the fingerprint '' and is like (1.0) only
another such text; one of 1 to 4 words has one shingle, all its words. Equal texts have equal fingerprints. The
next document follows by descending ``doc_id`` (null last), ties by the text's descending xxhash64; after the last comes
the first, so a lone document is its own next. One id on very many rows is split by that hash; only rows equal in id and
text stay together. Repeated rows count as documents. Extra columns are ignored.
Very long texts stay whole, in memory linear in the text.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE, shuffle_partitions, table, words_of

BINS, BITS = 128, 8
SHIFT = 63 - 7
LOW = (1 << SHIFT) - 1
ATTEMPTS = 4
LEAST = -(1 << 63)


def _draw(name: str, bin_: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{name}:{bin_}".encode()).digest()[:4], "big") % BINS


#: Probe t of bin j is bin (STEP[j] * t + START[j]) mod 128; an odd step visits every bin once.
STEP = [_draw("step", j) | 1 for j in range(BINS)]
START = [_draw("start", j) for j in range(BINS)]


def _ints(values, kind: str = "bigint") -> Column:
    """A constant array; a long one is a single folded literal, however many ranges there are."""
    if len(values) <= 256:
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of 128 ints, or an empty array for a text without words. Stays in the row: hashes are
    sorted as primitive longs together with one sentinel per bin, so the first of each bin is its minimum."""
    rest = [c for c in df.columns]
    # each step names its array twice or more, so that the optimizer doesn't inline it into a lambda
    one = df.select(*rest, F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x)).alias("_h"))
    window = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)]).bitwiseAND(F.lit((1 << 63) - 1))
    shingles = F.when(F.size("_h") >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size("_h") - SHINGLE), window)).when(F.size("_h") > 0, F.array(F.xxhash64("_h").bitwiseAND(F.lit((1 << 63) - 1))))
    two = one.select(*rest, F.sort_array(F.concat(shingles, _ints([(j << SHIFT) | LOW for j in range(BINS)]))).alias("_s"))
    first = lambda x, i: F.coalesce(F.shiftright(F.get("_s", i - 1), SHIFT) != F.shiftright(x, SHIFT), F.lit(True))
    value = lambda x: F.when(x.bitwiseAND(F.lit(LOW)) != LOW, x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    three = two.select(*rest, F.transform(F.filter("_s", first), value).alias("_b"))

    def fill(x: Column, j: Column) -> Column:
        probe = lambda t: F.get("_b", (F.get(_ints(STEP), j) * t + F.get(_ints(START), j)).bitwiseAND(F.lit(BINS - 1)))
        every = F.filter(F.transform(F.sequence(F.lit(ATTEMPTS), F.lit(BINS - 1)), probe), lambda v: v.isNotNull())
        return F.coalesce(x, *[probe(F.lit(t)) for t in range(ATTEMPTS)], F.get(every, 0))

    return three.select(*rest, F.coalesce(F.transform("_b", fill), F.array().cast("array<int>")).alias(out))


def packed(bins: Column) -> Column:
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected estimate of the Jaccard similarity, 0 to 1, of two arrays of bins."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / BINS
    chance = 1.0 / (1 << BITS)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``fingerprint``."""
    out = with_bins(docs.withColumn("_body", F.col(text)), "_body", "_bins")
    return out.withColumn("fingerprint", packed(F.col("_bins"))).drop("_bins", "_body")


def lower_bound(bounds: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the sorted bounds lie below (key, tie), by binary search."""
    if not bounds:
        return F.lit(0)
    keys, ties, steps = _ints([k for k, _ in bounds]), _ints([t for _, t in bounds]), [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def below(i: Column) -> Column:
        return F.coalesce((F.get(keys, i) < key) | (F.get(keys, i) == key) & (F.get(ties, i) < tie), F.lit(False))

    return F.aggregate(_ints(steps), F.lit(0), lambda at, step: F.when(below(at + step - 1), at + step).otherwise(at))


def range_bounds(keyed: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Bounds of ranges of about equal counts over (_k, _t): those of _k, and where several fall on one _k, which is then
    on many rows, bounds of _t within it."""
    shares = lambda n: _ints([i / n for i in range(1, n)], "double")
    cuts = Counter(keyed.agg(F.percentile_approx("_k", shares(ranges), F.lit(20 * ranges))).first()[0] or [])
    hot = {k: n for k, n in cuts.items() if n > 1}
    found = [(k, LEAST) for k in cuts]
    if hot:
        most = max(hot.values()) + 1
        within = keyed.filter(F.array_contains(_ints(sorted(hot)), F.col("_k"))).groupBy("_k").agg(F.percentile_approx("_t", shares(most), F.lit(20 * most)).alias("h"))
        found += [(r["_k"], h) for r in within.collect() for h in r["h"]]
    return sorted(set(found))


def with_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """doc_id, text and bins, with those of the next document by descending doc_id. One shuffle of the texts:
    documents go to ranges of doc_id; the top of each range is sent to the range above as well, where it follows
    that range's last, and the top of all closes the circle. The driver sees a few numbers per range."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    body = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("_k"))
    one = body.withColumn("_t", F.xxhash64("text"))
    ranges = per_partition * shuffle_partitions(docs.sparkSession)
    home = lower_bound(range_bounds(one, ranges), F.col("_k"), F.col("_t"))
    tops = sorted((r["_r"], (r["t"]["_k"], r["t"]["_t"])) for r in one.select(home.alias("_r"), "_k", "_t").groupBy("_r").agg(F.max(F.struct("_k", "_t")).alias("t")).collect())
    at = lower_bound([t for _, t in tops], F.col("_k"), F.col("_t"))
    tops_k, tops_h = (_ints([t[i] for _, t in tops]) if tops else F.array().cast("array<bigint>") for i in (0, 1))
    copy = F.when((F.get(tops_k, at) == F.col("_k")) & (F.get(tops_h, at) == F.col("_t")), at + 1)
    above = [r for r, _ in tops[1:] + tops[:1]]
    sent = F.when(copy > 0, F.struct(F.get(_ints(above) if above else F.array().cast("array<int>"), copy - 1).cast("int").alias("_to"), (copy == len(tops)).alias("_wraps"), F.lit(True).alias("_guest")))
    dealt = one.select("*", F.inline(F.array_compact(F.array(F.struct(home.alias("_to"), F.lit(False).alias("_wraps"), F.lit(False).alias("_guest")), sent))))
    ranged = with_bins(dealt.repartition(F.col("_to")), "text", "_bins")
    w = Window.partitionBy("_to").orderBy("_wraps", F.desc("_k"), F.desc("_t"), "text")
    return ranged.select("*", F.lead("text").over(w).alias("next_text"), F.lead("_bins").over(w).alias("next_bins")).filter(~F.col("_guest")).select("doc_id", "text", "_bins", "next_text", "next_bins")


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    both = with_bins(pairs.select("doc_id", n.cast("long").alias("n_chars"), "_bins", "next_bins", edited.alias("edited")), "edited", "_edited_bins")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("_bins")).alias("fingerprint"), packed(F.col("_edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited"), likeness(F.col("_bins"), F.col("next_bins")).alias("near_next"),
    )
