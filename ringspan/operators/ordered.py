"""Running totals over a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

PARTS = 256


def below(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds lie below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    items = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(items, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))


def running_totals(df: DataFrame, key: str, sums: dict[str, str], by: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """For each (new column, summed column) of ``sums``: the total over rows of the same ``by`` with a lower key. Rows go to
    ranges of the key; a range's own rows are summed within it, and the totals of lower ranges, ``parts`` rows a group,
    are added. Rows of one key must have been grouped before."""
    cuts = df.agg(F.percentile_approx(key, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))).first()[0] or []
    ranged = df.withColumn("_range", below(sorted(set(cuts)), F.col(key)))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(lower), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"_i_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = own.join(offsets if by else F.broadcast(offsets), [*by, "_range"])  # without groups: ``parts`` rows
    return joined.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def places(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Adds each row's place, from 1, in the total order of ``keys``: rows are sorted by ranges, and the counts of lower
    ranges, one a partition, are added."""
    kept = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return kept.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")
