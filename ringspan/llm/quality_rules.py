"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule;
versioned policies are masks over those bits, so a policy change or an ablation reads the ledger only.

Edge cases: a null text counts as empty; an empty or blank text has no words, fails ``too_few_words`` and is
rejected; repeated rows each get their row; ``doc_id`` may be null or tied; extra columns are ignored, even
those that carry the name of a result column; an empty table gives an empty ledger. Texts of any length are
measured whole, in memory linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, SPACES, WORD, words_of

#: name -> predicate in SQL over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "duplicate_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines",
    "long_words": "word_chars > 20 * n_words",
}
#: version -> the rules that reject. The base rules stand in every version.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("too_few_words", "repeated_words"),
    "v2": ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "long_words"),
}
BASE = ("too_few_words", "repeated_words")
CURRENT = "v2"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measurements, all long. Only ``keep`` and ``text`` are read.

    Repeated windows are found inside the row: window hashes (64 bits) are sorted as primitives by
    ``array_distinct`` first, and only texts with a repeat pay for the positions. No shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    one = docs.select(*keep, body.alias("_t"), words_of(F.col(text)).alias("_w"), lines.alias("_l"))
    two = one.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", rf"[{SPACES}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    window = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(SHINGLE)])
    at = F.when(F.size("_h") >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size("_h") - SHINGLE), window)).otherwise(F.array().cast("array<bigint>"))
    three = two.select(*keep, *[c for c in MEASURES if c != "n_repeat_words"], at.alias("_g"))
    # A map with one row per window would be shuffled; a sorted array of (hash, position) stays in the row.
    pairs = F.when(F.size("_g") > F.size(F.array_distinct("_g")), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    four = three.select(*keep, *[c for c in MEASURES if c != "n_repeat_words"], pairs.alias("_p"))
    same = lambda x, k: F.coalesce(F.get("_p", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_p", k + 1)["h"] == x["h"], F.lit(False))
    five = four.select(*keep, *[c for c in MEASURES if c != "n_repeat_words"], F.sort_array(F.transform(F.filter("_p", same), lambda x: x["i"])).alias("_r"))
    step = lambda p, k: F.least(F.lit(SHINGLE), F.coalesce(F.get("_r", k + 1), p + SHINGLE) - p)
    covered = F.when(F.size("_r") > 0, F.aggregate(F.transform("_r", step), F.lit(0), lambda a, x: a + x)).otherwise(0)
    return five.select(*keep, *[c for c in MEASURES if c != "n_repeat_words"], covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failed`` (long): bit i is set if rule i fails."""
    bits = [F.when(F.expr(p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(RULES.values())]
    return measure(docs, text, keep).withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def rejects(failed: Column, version: str = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(mask_of(POLICIES[version]))) != 0


def apply_policy(led: DataFrame, version: str = CURRENT) -> DataFrame:
    base = led["failed"].bitwiseAND(F.lit(mask_of(BASE))) != 0
    return led.withColumn("base_failed", base).withColumn("kept", ~base & ~rejects(led["failed"], version))


def ablations(led: DataFrame) -> DataFrame:
    """One row per policy version and rule: documents that fail the rule, that only this rule rejects (dropping
    the rule would keep them), and that the version keeps; with the bits that any and all documents fail. The
    ledger is first counted by mask, at most 2^rules rows."""
    masks = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    policy = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(mask_of(r)).cast("long").alias("mask")) for v, r in POLICIES.items()]))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(names)]))
    hit = F.col("failed").bitwiseAND(F.col("p.mask"))
    wide = masks.withColumn("p", policy).withColumn("r", rule).withColumn("hit", hit).filter(F.col("p.mask").bitwiseAND(F.col("r.bit")) != 0)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return wide.groupBy(F.col("p.version").alias("version"), F.col("r.rule").alias("rule")).agg(
        count(F.col("hit").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), count(F.col("hit") == F.col("r.bit")).alias("n_only"),
        count(F.col("hit") == 0).alias("n_kept"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"),
    )


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents a policy version keeps, all columns as they came."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.col("text").alias("_text"))
    judged = apply_policy(ledger(packed, "_text", ("_row",)), version)
    # not a filter: pushed below the measurements, its copies of their nested expressions would grow without end
    good = judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return good.select(*[F.col("_row")[c].alias(c) for c in names])


def quality(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    led = apply_policy(ledger(docs), version)
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed")


def _oracle() -> str:
    bits = " + ".join(f"(CASE WHEN {p} THEN {1 << i} ELSE 0 END)" for i, p in enumerate(RULES.values()))
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM l LEFT JOIN c ON l.doc_id = c.doc_id),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask_of(BASE)}) <> 0 AS base_failed,
  (failed & {mask_of(BASE) | mask_of(POLICIES[CURRENT])}) = 0 AS kept, n_lines, failed FROM f"""


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality(table(spark, sf_dir, "documents"))


ORACLE = {"op3_quality_rules": _oracle()}
