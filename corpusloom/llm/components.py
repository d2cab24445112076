"""Connected components of a graph that is only ever held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, stored


def connected_components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b long) reaches; roots are listed too.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each round is two shuffles by node in which a node's
    neighbours stream past in order and meet its smallest one, so a node with very many neighbours takes no more memory
    than others. Each round's edges are written below ``path``; it ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{path}/edges-0")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = print_of(now)
    old = f"{path}/edges-0"
    for k in range(1, rounds + 1):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.first("b").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        first = F.first("b").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        small = large.withColumn("m", first)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stored(small.where("a <> b").distinct(), f"{path}/edges-{k}")
        after = print_of(now)
        dropped(spark, old)
        old = f"{path}/edges-{k}"
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
