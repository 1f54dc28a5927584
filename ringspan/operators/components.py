"""Connected components of an edge table, by alternating stars; nothing is collected to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written

#: Edges of a task that are looked at together.
AT_ONCE = 1_000_000


def _stars(batches):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= AT_ONCE:
            yield from _star(pa.Table.from_batches(held))
            held, rows = [], 0
    if held:
        yield from _star(pa.Table.from_batches(held))


def _star(table: pa.Table):
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (label[a], label[b], a, b):
            np.minimum.at(new, ends, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    away = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[label[away]], table.schema.field("a").type), pa.array(names[away], table.schema.field("b").type)], names=["a", "b"])


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same nodes as these do, but as few of them as nodes in a task: each task gives nodes an edge
    to the least node that its own edges, some at once, lead to."""
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", F.col("b").cast(kind).alias("b")).filter("a <> b").mapInArrow(_stars, f"a {kind}, b {kind}")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: a, b (any orderable type). Gives node, label (the least node of its component) for every node with
    an edge to another. Each round halves chains at least; state is written to the shared folder round by round."""
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), name)
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        # large star: every greater neighbour of a node goes to the least in its neighbourhood
        # (written first: a join of two plain shuffles can split the partition of a centre with many neighbours)
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b")
        before, now = now, written(small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), name)
        discard(before, least)
        seen = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if seen == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        mark = seen
