"""Merging channel scores and choosing matches: windows with a rank bound, which Spark prunes before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import CHANNEL_ORDER

PAIR, SOURCE = ["s1", "src", "cid"], ["s1", "src"]


def rank(df: DataFrame, order: list, by: list[str] = SOURCE, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def max_merge(df: DataFrame) -> DataFrame:
    return df.groupBy(*PAIR).agg(F.max("score").alias("score"))


def merged(*scores: Column) -> Column:
    """``max_merge`` of channels that score a pair in one row; null is a channel without the pair."""
    return F.greatest(*scores)


def channel_rank():
    return F.array_position(F.array(*[F.lit(c) for c in CHANNEL_ORDER]), F.col("channel"))


def ladder(df: DataFrame) -> DataFrame:
    """A channel counts for a source only if none before it accepted; after the first channel one hit at most."""
    df = df.withColumn("step", channel_rank())
    first = df.groupBy(*SOURCE).agg(F.min("step").alias("first"))
    df = df.join(first, SOURCE).where("step = first")
    exact = df.where("channel = 'exact'")
    other = rank(df.where("channel <> 'exact'"), ["cid"]).where("rank = 1").drop("rank")
    return exact.unionByName(other).select(*PAIR, "score").distinct()


def fallback(df: DataFrame) -> DataFrame:
    """Core counts only if neither source has an exact match; the anchor always counts."""
    has = df.where("channel = 'exact'").select("s1").distinct()
    return df.where("channel <> 'core'").unionByName(df.where("channel = 'core'").join(has, "s1", "left_anti").select(*df.columns)).groupBy(*PAIR).agg(F.max("score").alias("score"))


def both_empty(df: DataFrame) -> DataFrame:
    """A channel counts only if none before it accepted for either source; then with all its hits."""
    df = df.withColumn("step", channel_rank())
    first = df.groupBy("s1").agg(F.min("step").alias("first"))
    return df.join(first, "s1").where("step = first").groupBy(*PAIR).agg(F.max("score").alias("score"))


def visited(pairs: DataFrame, hits: DataFrame, merge: str) -> DataFrame:
    """The pairs that a fallback looks at, whatever their score: a channel is tried while it is needed."""
    if merge not in ("ladder", "both_empty", "fallback"):
        return pairs
    hits = hits.withColumn("step", channel_rank())
    first = hits.groupBy("s1", "src").agg(F.min("step").alias("step"), F.max((F.col("channel") == "exact").cast("int")).alias("exact"))
    by = first.groupBy("s1").agg(F.min("step").alias("any"), F.max("step").alias("all"), F.count("*").alias("n"), F.max("exact").alias("exact"))
    need = {
        "ladder": F.col("all").isNull() | (F.col("n") < 2) | (channel_rank() <= F.col("all")),
        "both_empty": F.col("any").isNull() | (channel_rank() <= F.col("any")),
        "fallback": (F.col("channel") != "core") | (F.coalesce("exact", F.lit(0)) == 0),
    }[merge]
    return pairs.join(by, "s1", "left").where(need).select(*pairs.columns)


def top_k(df: DataFrame, k: int, ties: str = "desc") -> DataFrame:
    order = [F.desc("score"), F.desc("cid") if ties == "desc" else F.asc("cid")]
    return rank(df, order).where(F.col("rank") <= k)


def top_k_rows(df: DataFrame, k: int) -> DataFrame:
    """Appended channel rows: the same candidate may take several places, and counts once."""
    return rank(df, [F.desc("score"), F.desc("cid")]).where(F.col("rank") <= k).groupBy(*PAIR).agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The first n of each source in arrival order, whatever their score."""
    return rank(df, ["cid"], name="arrival").where(F.col("arrival") <= n).drop("arrival")


def tiered(df: DataFrame, tiers: tuple[tuple[int, int], ...]) -> DataFrame:
    """Rank r stays if its score reaches the tier of some rank bound >= r; scores fall, so what stays is a prefix."""
    df = rank(df, [F.desc("score"), "cid"]).where(F.col("rank") <= max(r for r, _ in tiers))
    keep = F.lit(False)
    for r, s in tiers:
        keep = keep | ((F.col("rank") <= r) & (F.col("score") >= s))
    return df.where(keep)


def lists(df: DataFrame, reference: DataFrame | None, ranked: bool, name: str = "matched_entity_ids") -> DataFrame:
    """One row a reference id, with its ids as an array (empty if none): by source and rank, or sorted.  Without a
    reference, the ids that have a match."""
    item = F.struct("src", "rank", "cid") if ranked else F.struct("cid")
    got = df.groupBy("s1").agg(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["cid"]).alias(name))
    if reference is not None:
        got = reference.select(F.col("entity_id").alias("s1")).join(got, "s1", "left")
    return got.select(F.col("s1").alias("source1_entity_id"), F.coalesce(name, F.array().cast("array<string>")).alias(name))


def prune(df: DataFrame, n: int, col: str = "matched_entity_ids") -> DataFrame:
    """The first n ids of each source of finished lists."""
    part = lambda p: F.slice(F.filter(F.col(col), lambda x: x.startswith(p)), 1, n)
    return df.withColumn(col, F.concat(part("S2-"), part("S3-")))


def prune_totals(before: DataFrame, after: DataFrame, col: str = "matched_entity_ids") -> DataFrame:
    a = before.agg(F.sum(F.size(col)).alias("ids_before"), F.count("*").alias("entities"))
    b = after.agg(F.sum(F.size(col)).alias("ids_after"), F.sum((F.size(col) == 0).cast("long")).alias("empty"))
    return a.join(b).withColumn("pruned", F.col("ids_before") - F.col("ids_after"))
