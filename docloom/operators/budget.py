"""Token budgets over ranked rows: (group, order, tokens) and what of it fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def before_overflow(df: DataFrame, budget: str | int, keys: tuple[str, ...], order: tuple, tokens: str = "tokens") -> DataFrame:
    """Rows up to, and without, the first that overflows the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    return df.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= limit)


def until_reached(df: DataFrame, budget: str | int, keys: tuple[str, ...], order: tuple, tokens: str = "tokens") -> DataFrame:
    """Rows up to, and with, the one that reaches the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    return df.withColumn("before", F.coalesce(F.sum(tokens).over(w), F.lit(0))).where(F.col("before") < limit)


def skipping(df: DataFrame, budget: int, keys: tuple[str, ...], order: tuple[str, ...], tokens: str = "tokens", row: str = "id") -> DataFrame:
    """Rows taken greedily: one that overflows is skipped and later ones still tried.

    What is taken depends on all that was taken before, so a group's rows are folded in order; a group
    is the ranked list of one question.
    """
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(tokens).cast("long").alias("_t"), F.col(row).alias("_id")))).alias("l"))
    kind = dict(df.dtypes)[row]
    fold = f"aggregate(l, named_struct('used', 0L, 'ids', cast(array() as array<{kind}>)), (a, x) -> if(a.used + x._t <= {int(budget)}L, named_struct('used', a.used + x._t, 'ids', array_append(a.ids, x._id)), a), a -> a.ids)"
    return listed.select(*keys, F.posexplode(F.expr(fold)).alias("place", row))
