"""Mixing sources to target weights by iterative proportional fitting (native).

Documents are counted into cells of (source, language, topic). Raking scales the cells' token weights until the
three marginals meet their targets; no cell may get more tokens than it has, so that weight / tokens is an
inclusion probability. Each document is then taken or not by a uniform drawn from its ``doc_id``, the same in
every run and partitioning. Only the cell table is iterated: its size is the number of cells, not of documents.

Edge cases: a null source, language or text counts as '' (an empty text has no words, topic ``note``); documents
of a cell without words have the cell's probability 1; repeated ``doc_id`` share their draw; a null ``doc_id``
draws as ''. Shares named for values that don't occur are dropped and the rest scaled to 1. An empty table gives
an empty table. Extra columns pass through :func:`sample`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, table, written

DIMENSIONS = ("source", "lang", "topic")
#: A marginal's target: share of the tokens to this power, scaled to 1. 1 keeps what is observed.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
FRACTION = 0.5
ROUNDS = 24
ROUNDS_A_JOB = 6
#: Up to so many cells they are raked in one task and broadcast; beyond it both are shuffled.
SMALL_CELLS = 20_000
SEED = "mix-1"


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column, n: Column) -> Column:
    """A coarse kind of text, from its layout: table, note, article or report."""
    body = F.coalesce(text, F.lit(""))
    pipes = F.length(body) - F.length(F.replace(body, F.lit("|"), F.lit("")))
    return F.when((n > 0) & (5 * pipes >= n), "table").when(n < 100, "note").when(n < 600, "article").otherwise("report")


def described(docs: DataFrame, keep: list[Column], topic: Column | None = None) -> DataFrame:
    n = tokens_of(F.col("text"))
    one = docs.select(*keep, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("source", "lang")], F.col("text").alias("_text"), n.alias("_n"))
    return one.withColumn("_topic", topic if topic is not None else topic_of(F.col("_text"), F.col("_n"))).drop("_text")


def summed(state: DataFrame, d: str, value: Column, out: str, few: bool) -> DataFrame:
    """Adds ``out``, the sum of a value over the cells of a marginal. Few cells are one partition, where a window costs no
    shuffle; of many, one value may hold a third, so its sum is grouped and joined back."""
    if few:
        return state.withColumn(out, F.sum(value).over(Window.partitionBy(f"_{d}")))
    return state.join(state.groupBy(f"_{d}").agg(F.sum(value).alias(out)), f"_{d}")


def share_of(d: str, held: Column, total: float, targets: dict[str, dict[str, float]] | None, temper: dict[str, float]) -> Column:
    """The wanted share of a value of a marginal, before they are scaled to 1."""
    share = F.pow(held / F.lit(total), F.lit(temper[d]))
    if targets and d in targets:
        named = targets[d]
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col(f"_{d}")), F.lit(0.0)) if named else F.lit(0.0)
    return F.when(held > 0, share).otherwise(0.0)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS, few: bool = True) -> DataFrame:
    """cells: _source, _lang, _topic, tokens. Adds ``weight``, the tokens to take, ``prob``, and the marginals' targets
    (``_t_source``, ``_t_lang``, ``_t_topic``)."""
    temper = TEMPER | (temper or {})
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    state = cells.withColumn("weight", F.lit(fraction) * F.col("tokens"))
    for d in DIMENSIONS:
        shares = cells.groupBy(f"_{d}").agg(F.sum("tokens").alias("h")).select(share_of(d, F.col("h"), total, targets, temper).alias("s"))
        whole = shares.agg(F.sum("s")).first()[0] or None
        state = summed(state, d, F.col("tokens"), "_held", few)
        state = state.withColumn(f"_t_{d}", F.lit(fraction * total) * share_of(d, F.col("_held"), total, targets, temper) / F.lit(whole).cast("double")).drop("_held")
        state = state if few else written(state, "rake")
    for r in range(rounds):
        for d in DIMENSIONS:
            state = summed(state, d, F.col("weight"), "_have", few)
            state = state.withColumn("weight", F.least(F.col("tokens").cast("double"), F.when(F.col("_have") > 0, F.col("weight") * F.col(f"_t_{d}") / F.col("_have")).otherwise(0.0))).drop("_have")
            if not few:  # joined with itself, so each step is cut
                before, state = state, written(state, "rake")
                discard(before)
        if few and (r + 1) % ROUNDS_A_JOB == 0 and r + 1 < rounds:
            state = written(state, "rake").coalesce(1)
    return state.withColumn("prob", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0))


def residuals(raked: DataFrame) -> DataFrame:
    """How well the marginals are met: dimension, value, target and weight in tokens, a row a value."""
    parts = [raked.groupBy(F.col(f"_{d}").alias("value")).agg(F.max(f"_t_{d}").alias("target"), F.sum("weight").alias("weight")).select(F.lit(d).alias("dimension"), "value", "target", "weight") for d in DIMENSIONS]
    return parts[0].union(parts[1]).union(parts[2])


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substr(digest, F.lit(1), F.lit(12)), 16, 10).cast("double") / float(1 << 48)


def probabilities(docs: DataFrame, **how) -> tuple[DataFrame, bool]:
    """The raked cells, and whether they are few."""
    counted = described(docs, []).groupBy("_source", "_lang", "_topic").agg(F.sum("_n").cast("long").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    cells = written(counted, "cells")
    few = cells.count() <= SMALL_CELLS
    return rake(cells.coalesce(1) if few else cells, few=few, **how), few


def _joined(described_docs: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    slim = written(cells.select("_source", "_lang", "_topic", "prob", "weight"), "raked")
    return described_docs.join(F.broadcast(slim) if few else slim, ["_source", "_lang", "_topic"])


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: its cell, tokens, calibrated probability and whether it is taken."""
    cells, few = probabilities(docs, **how)
    out = _joined(described(docs, [F.col("doc_id")]), cells, few)
    return out.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_n").alias("n_tokens"),
        F.round("prob", 6).alias("prob"), (draw(F.col("doc_id")) < F.col("prob")).alias("taken"),
    )


def sample(docs: DataFrame, **how) -> DataFrame:
    """The documents taken, all columns as they came."""
    cells, few = probabilities(docs, **how)
    names = docs.columns
    packed = described(docs, [F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.col("doc_id").alias("_id")])
    return _joined(packed, cells, few).filter(draw(F.col("_id")) < F.col("prob")).select(*[F.col("_row")[c].alias(c) for c in names])


def _oracle() -> str:
    parts = [
        "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents)",
        "e AS (SELECT doc_id, source, lang, n, CASE WHEN n > 0 AND 5 * (length(t) - length(replace(t, '|', ''))) >= n THEN 'table' WHEN n < 100 THEN 'note' WHEN n < 600 THEN 'article' ELSE 'report' END AS topic FROM d)",
        "c AS (SELECT source, lang, topic, sum(n)::BIGINT AS tokens FROM e GROUP BY ALL)",
        f"g AS (SELECT {FRACTION} * sum(tokens)::DOUBLE AS goal, sum(tokens)::DOUBLE AS total FROM c)",
    ]
    for d in DIMENSIONS:
        parts.append(f"h_{d} AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE / any_value(total), {TEMPER[d]}) ELSE 0 END AS s FROM c, g GROUP BY {d})")
        parts.append(f"t_{d} AS (SELECT {d}, any_value(goal) * any_value(s) / (SELECT sum(s) FROM h_{d}) AS t FROM h_{d}, g GROUP BY {d})")
    parts.append(f"r0 AS MATERIALIZED (SELECT c.*, {FRACTION} * tokens::DOUBLE AS w, ts.t AS t_source, tl.t AS t_lang, tt.t AS t_topic FROM c JOIN t_source ts USING (source) JOIN t_lang tl USING (lang) JOIN t_topic tt USING (topic))")
    i = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(f"r{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(tokens::DOUBLE, CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END) AS w, t_source, t_lang, t_topic FROM r{i})")
            i += 1
    u = f"('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"
    return f"WITH {', '.join(parts)}, p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 1.0 END AS p FROM r{i}) SELECT doc_id, source, lang, topic, n AS n_tokens, round(p, 6) AS prob, {u} < p AS taken FROM e JOIN p USING (source, lang, topic)"


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = {"op1_mixing": _oracle()}
