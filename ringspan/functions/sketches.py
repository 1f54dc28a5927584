"""Sparse tags and set sketches."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def seeded(*parts: str) -> np.random.Generator:
    digest = hashlib.blake2b("|".join(parts).encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "big"))


def winners(values: Column, k: int) -> Column:
    """K4: indices of the k greatest values, the lower index first among equals."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


class FlyHash:
    """H1: normalise, project sparsely into many dimensions, keep the winners. Fixed by the seed alone, so every worker
    rebuilds the same projection."""

    def __init__(self, input_dim: int, dim: int = 4096, sampling: float = 0.12, share: float = 0.05, seed_id: str = "default", salt: str = ""):
        self.input_dim, self.dim, self.length, self.seed_id = input_dim, dim, max(1, round(dim * share)), seed_id
        rng = seeded(salt, seed_id)
        per = max(1, round(input_dim * sampling))
        self.projection = np.zeros((dim, input_dim), np.float32)
        for row in self.projection:
            row[rng.choice(input_dim, per, replace=False)] = 1
        self.order = rng.permutation(dim)

    def tags(self, x: np.ndarray) -> list[list[int]]:
        x = np.asarray(x, np.float64)
        x = x / np.maximum(np.abs(x).mean(1, keepdims=True), 1e-12)
        act = (x - x.mean(1, keepdims=True)) @ self.projection.T
        top = np.lexsort((np.broadcast_to(self.order, act.shape), -np.round(act, 9)), axis=1)[:, : self.length]
        return [sorted(map(int, t)) for t in top]


def fly_tags(df: DataFrame, key: str, vector: str, **how) -> DataFrame:
    """key and tag, by Arrow batches."""

    def run(batches):
        hasher = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy())
                hasher = hasher or FlyHash(x.shape[1], **how)
                yield pd.DataFrame({key: pdf[key], "tag": [{"dim": hasher.dim, "indices": t, "seed_id": hasher.seed_id} for t in hasher.tags(x)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInPandas(run, f"{key} {kind}, tag struct<dim:int,indices:array<int>,seed_id:string>")


def coefficients(n: int, seed: str = "") -> list[tuple[int, int]]:
    """Multipliers and offsets of n permutations modulo 2^31 - 1, from SHA-256."""
    draw = lambda what, i: int.from_bytes(hashlib.sha256(f"{seed}|{what}|{i}".encode()).digest()[:4], "big") % (PRIME - 1)
    return [(draw("a", i) + 1, draw("b", i)) for i in range(n)]


def minhash(indices: Column, n: int = 64, seed: str = "") -> Column:
    """H2: least (a * i + b) mod (2^31 - 1) for each permutation; zeros for an empty set."""
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in coefficients(n, seed)])
    return F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(indices, lambda i: (p["a"] * i + p["b"]) % PRIME)), F.lit(0).cast("long")))


def bands(signature: Column, n_bands: int, size: int) -> Column:
    """H3: one key a band, of its number and its part of the signature."""
    part = lambda s, k: F.array_join(F.transform(F.slice(s, k * size + 1, size), lambda x: x.cast("string")), ",")
    of = lambda s: F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.sha2(F.concat_ws("|", k.cast("string"), part(s, k)), 256))
    return F.get(F.transform(F.array(signature), of), 0)  # the signature is evaluated once


def role(name: str, dim: int) -> tuple[int, int]:
    """H4: the affine permutation of a role; the multiplier is coprime to ``dim``."""
    digest = hashlib.sha256(f"role|{name}".encode()).digest()
    a, b = int.from_bytes(digest[:4], "big") % dim | 1, int.from_bytes(digest[4:8], "big") % dim
    while math.gcd(a, dim) != 1:
        a += 2
    return a % dim, b


def bind(indices: Column, name: str, dim: int) -> Column:
    a, b = role(name, dim)
    return F.array_sort(F.transform(indices, lambda i: ((F.lit(a).cast("long") * i + b) % dim).cast("int")))


def unbind(indices: Column, name: str, dim: int) -> Column:
    a, b = role(name, dim)
    back = pow(a, -1, dim)
    return F.array_sort(F.transform(indices, lambda i: F.pmod(F.lit(back).cast("long") * (i - b), F.lit(dim)).cast("int")))


def jitter(index: Column) -> Column:
    """Tie-break of votes: fixed, and unrelated to the order of the indices."""
    return F.sha2(index.cast("string"), 256)


def bundle(members: DataFrame, group: str, indices: str, length: int) -> DataFrame:
    """H5/K5/H6: each group's most frequent indices, ``length`` of them, ties by jitter."""
    from pyspark.sql import Window

    votes = members.select(group, F.explode(indices).alias("i")).groupBy(group, "i").agg(F.count(F.lit(1)).alias("v"))
    ranked = votes.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("v"), jitter(F.col("i"))))).filter(F.col("r") <= length)
    return ranked.groupBy(group).agg(F.array_sort(F.collect_list("i")).alias("indices"))


def check_bundle(members: DataFrame) -> DataFrame:
    """H5: refuses to mix sizes or seeds, and to bundle nothing. members: tag struct column ``tag``."""
    kinds = members.select("tag.dim", "tag.seed_id").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError("a bundle needs tags of one size and one seed")
    return members


def identity_hypervector(tags: dict[str, Column], dim: int, length: int) -> Column:
    """H6: the tags of an identity bound to their roles, bundled in the row."""
    bound = F.flatten(F.array(*[bind(t, name, dim) for name, t in sorted(tags.items())]))

    def vote(all_: Column) -> Column:
        each = F.transform(F.array_distinct(all_), lambda i: F.struct((-F.size(F.filter(all_, lambda x: x == i))).alias("v"), jitter(i).alias("j"), i.alias("i")))
        return F.array_sort(F.transform(F.slice(F.array_sort(each), 1, length), lambda s: s["i"]))

    return F.get(F.transform(F.array(bound), vote), 0)


def categorical_tag(value: Column, dim: int, length: int, seed_id: str) -> Column:
    """H7: a set of ``length`` indices from the value's hash, drawn until distinct."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(4 * length)), lambda k: (F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(seed_id), value.cast("string"), k.cast("string")), 256), F.lit(1), F.lit(8)), 16, 10).cast("long") % dim).cast("int"))
    return F.array_sort(F.slice(F.array_distinct(draw), 1, length))


def bloom_size(items: int, false_positives: float = 0.001) -> tuple[int, int]:
    """H8: (bits, hashes)."""
    n = max(1, items)
    m = max(64, math.ceil(-n * math.log(false_positives) / math.log(2) ** 2))
    return m, max(1, round(m / n * math.log(2)))


def bloom_positions(value: Column, bits: int, hashes: int, salt: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(salt), value.cast("string"), k.cast("string")), 256), F.lit(1), F.lit(13)), 16, 10).cast("long") % bits)


def bloom_words(items: DataFrame, value: str, bits: int, hashes: int, salt: str) -> DataFrame:
    """The filter as (word, bits), merged by bitwise or: partial aggregation, one row a 63-bit word."""
    at = items.select(F.explode(bloom_positions(F.col(value), bits, hashes, salt)).alias("p"))
    return at.groupBy(F.floor(F.col("p") / 63).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 63 as int))")).alias("bits"))


def bloom_contains(candidates: DataFrame, value: str, words: DataFrame, bits: int, hashes: int, salt: str) -> DataFrame:
    """Adds ``present``. An equi-join on the word, which Spark broadcasts only if it is small."""
    asked = candidates.withColumn("_p", F.explode(bloom_positions(F.col(value), bits, hashes, salt))).withColumn("word", F.floor(F.col("_p") / 63).cast("long"))
    hit = asked.join(words, "word", "left").withColumn("_hit", F.coalesce(F.expr("(bits & shiftleft(1L, cast(_p % 63 as int))) <> 0"), F.lit(False)))
    return hit.groupBy(*candidates.columns).agg(F.bool_and("_hit").alias("present"))


def realised_fpr(words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """H9: share of bits set, to the power of the hashes."""
    return words.agg(F.pow(F.sum(F.bit_count("bits")) / F.lit(bits), F.lit(float(hashes))).alias("fpr"))


def exchange_summary(left: DataFrame, right: DataFrame, value: str, salt: str, size: tuple[int, int] | None = None) -> DataFrame:
    """One row on what an exchange tells ``left`` of ``right``: counts, hits, and the filter's bytes and error rate.
    Without ``size`` (bits, hashes) the filter is sized for the right side's count."""
    bits, hashes = size or bloom_size(right.count())
    words = bloom_words(right, value, bits, hashes, salt)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    shared = bloom_contains(left.select(value).distinct(), value, words, bits, hashes, salt).filter("present")
    one = n(left, "n_left").crossJoin(n(right, "n_right")).crossJoin(n(left.join(shared, value, "left_semi"), "n_shared")).crossJoin(realised_fpr(words, bits, hashes))  # one row each
    held = -(-bits // 8)
    return one.select("n_left", "n_right", "n_shared", F.lit(held).cast("bigint").alias("filter_bytes"), F.col("fpr").alias("filter_fp_rate"), (F.lit(held) / F.greatest(F.lit(1), "n_right")).alias("bytes_per_item"))


def match_identities(candidates: DataFrame, words: DataFrame, bits: int, hashes: int, salt: str, key: str, band_keys: str, least: int = 6) -> DataFrame:
    """Identities with at least ``least`` bands in the other side's filter."""
    each = candidates.select(key, F.explode(band_keys).alias("band")).distinct()
    found = bloom_contains(each, "band", words, bits, hashes, salt)
    return found.groupBy(key).agg(F.sum(F.col("present").cast("long")).alias("hits")).withColumn("matched", F.col("hits") >= least)


def whiten(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Each dimension less its mean over its population deviation + 1e-6."""
    each = df.select(key, F.posexplode(vector).alias("i", "x"))
    stats = each.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scaled = each.join(F.broadcast(stats), "i").select(key, "i", ((F.col("x") - F.col("m")) / (F.col("s") + 1e-6)).alias("z"))  # a row a dimension
    return scaled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda s: s["z"]).alias(vector))
