"""Numbers within groups of any size: the rows of one group may lie in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.scratch import written


def number_within(rows: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """``rows`` with ``name``, each row's place from 1 among those with its keys. The order has to be total for the
    numbers to be certain; null keys are a group.

    Rows are dealt out by ranges of (keys, order) and sorted; a group then begins in a partition and goes on in the
    next ones, and a row for each group and partition tells how many come before. No task gets a whole group, unless
    its rows are equal in all columns of the order. Give it narrow rows: ids and what they are sorted by.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(dealt.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")), "numbered")
    heads = placed.groupBy(*keys, "__p").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__c").select("*", *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__q")).drop(*keys, "__p")
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & placed[k].eqNullSafe(F.col(f"__k_{k}"))
    return placed.join(heads, same).select(*[placed[c] for c in rows.columns], (F.col("__i") - F.col("__first") + F.col("__before") + 1).cast("long").alias(name))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows before, within the keys and by a total order. Groups may be of
    any size, as in ``number_within``: sums are made within partitions, and a row for each group and partition carries on."""
    by = [*keys, *order]
    placed = written(rows.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "summed")
    heads = placed.groupBy(*keys, "__p").agg(F.sum(value).alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    # only the group that a partition begins with can have begun before: the rest has nothing to carry, however many groups there are
    heads = heads.withColumn("__before", before).where("__before is not null").select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__q"), "__before")
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & placed[k].eqNullSafe(F.col(f"__k_{k}"))
    here = F.sum(value).over(Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(heads, same, "left").select(*[placed[c] for c in rows.columns], (F.coalesce(here, F.lit(0)) + F.coalesce("__before", F.lit(0))).cast("long").alias(name))


def last_before(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``last_<value>`` for each value: the latest one that isn't null among the rows before, within the
    keys and by a total order. Groups may be of any size, as in ``number_within``."""
    by = [*keys, *order]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()), "carried")
    tails = placed.groupBy(*keys, "__p").agg(*[F.max(F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("__v")))).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__q"), *[F.last(F.col(f"{v}.__v"), True).over(before).alias(f"__c_{v}") for v in values])
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & placed[k].eqNullSafe(F.col(f"__k_{k}"))
    here = Window.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(tails, same)
    return found.select(*[placed[c] for c in rows.columns], *[F.coalesce(F.last(F.col(v), True).over(here), F.col(f"__c_{v}")).alias(f"last_{v}") for v in values])
