"""Connected components of a DataFrame of links, by alternating large and small stars.

Each round is two aggregates (with partial sums, so a hub costs one row per task) and two joins; its result is
written to the shared folder, which cuts the lineage.  Nothing is collected but two totals a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b: long); loops are ignored."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark, mark = links.sparkSession, written()
    links = materialize(links, "links")
    before = _state(links)
    for _ in range(rounds):
        # Large star: each neighbour above u points to the least node of u's surroundings.
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its lower neighbours point to the least of them.
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        down = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(down.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = _state(links)
        drop_written(spark, mark, keep=1)  # the round before
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
