"""Connected components of a graph given by edges, with tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import removed, unused, written

#: A key with more rows than HUB is dealt to a task for each HUB of its rows; the HUBS largest ones are told to all executors.
#: Any other key has less than a HUBS-th of all rows.
HUB, HUBS = 256, 10_000


def hub_join(many: DataFrame, key: str, one: DataFrame, other: str, count: str) -> DataFrame:
    """``many`` joined to the row of ``one`` whose ``other`` is its ``key``, though some keys hold a large share of ``many``.

    ``one`` has ``count``, the rows of ``many`` for its key, and is read twice (a checkpoint): rows of large keys are salted.
    """
    hub, parts, salt, salts = unused([*many.columns, *one.columns], "_hub", "_parts", "_salt", "_salts")
    large = one.select(F.col(other).alias(hub), F.ceil(F.col(count) / HUB).cast("int").alias(parts)).where(F.col(parts) > 1)
    large = F.broadcast(large.orderBy(F.desc(parts), hub).limit(HUBS))
    many = many.join(large, F.col(key) == F.col(hub), "left")
    many = many.withColumn(salt, F.pmod(F.xxhash64(*[c for c in many.columns if c not in (hub, parts)]), F.coalesce(F.col(parts), F.lit(1))).cast("int")).drop(hub, parts)
    one = one.drop(count).join(large, F.col(other) == F.col(hub), "left")
    one = one.withColumn(salts, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(hub, parts)
    return many.join(one, (F.col(key) == F.col(other)) & (F.col(salt) == F.col(salts))).drop(salt, salts)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: longs); root is the component's smallest node.

    Large-star and small-star rounds (Kiveris et al. 2014): each round points a node's larger, then its smaller
    neighbours to the smallest one it knows, which ends in one star per component after few rounds. A round is grouped
    minima, combined before the shuffle, and an equi-join in which hubs are salted; no node's neighbours are collected.
    """

    spark = edges.sparkSession
    tables: list[str] = []

    def table(df: DataFrame) -> DataFrame:
        out, path = written(df)
        tables.append(path)
        return out

    def star(both: DataFrame, keep_larger: bool) -> DataFrame:
        least = table(both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m"), F.count("*").alias("n")))  # a row for each node
        least = least.withColumn("m", F.least("_a", "m"))
        pairs = hub_join(both, "a", least, "_a", "n")
        if keep_larger:
            out = pairs.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
        return table(out.where("a <> b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        large = star(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        now = star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        for path in tables[:-1]:
            removed(spark, path)
        del tables[:-1]
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
