"""Running totals and ranks within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows of the same group that come earlier in ``order``.

    Rows are dealt by ranges of (group, order), so a group of any share of the rows spreads over many tasks. A window
    runs over the piece of a group that one range holds; the pieces' totals, one row for each group and range, are
    summed over the groups and joined back. ``order`` should be total, so that reruns agree. The ranges are
    checkpointed once: both branches then see the same pieces whatever executors are lost.
    """
    piece, before = "_piece", "_before"
    dealt = checkpointed(df.repartitionByRange(*group, *order).withColumn(piece, F.spark_partition_id()))
    same = [F.col(g) for g in group]
    inside = Window.partitionBy(*same, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*same).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        dealt.groupBy(*group, piece)
        .agg(F.sum(value).alias(before))
        .withColumn(before, F.coalesce(F.sum(before).over(across), F.lit(0)))
        .select(*[F.col(g).alias(f"_{g}") for g in group], F.col(piece).alias("_p"), before)
    )
    on = F.col(piece) == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    # salted by the piece, so the join key of a hot group is spread as well
    return (
        dealt.withColumn(into, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(pieces, on)
        .withColumn(into, F.col(into) + F.col(before))
        .drop(piece, before, "_p", *[f"_{g}" for g in group])
    )


def rank_in_group(df: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Adds ``into``: the rank from 0 within the group; see ``running_total``."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one", into).drop("_one")
