"""Targets as a stream against a static reference: the row loop of the later profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import similarity as S
from ..operators import blocking, scoring
from ..plans.profiles import PROFILES, Profile


def stream_scores(reference: DataFrame, targets: DataFrame, profile: Profile | str = "v13") -> DataFrame:
    """Scored pairs (s1, src, cid, channel, score) of a streaming DataFrame of targets; a stateless stream-static join."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    if p.index_side != "reference":
        raise ValueError("only profiles that index the reference can stream their targets")
    ref, new = blocking.with_features(reference, p), blocking.with_features(targets, p)
    postings = blocking.bounded(blocking.keys(ref, p), p).select("country", "channel", "key", "bucket", F.col("entity_id").alias("s1"))
    side = lambda df, x, key: df.select(F.col("entity_id").alias(key), *[F.col(f).alias(x + f) for f in blocking.FEATURES])
    every = _keys_with_row(new, p)
    pairs = every.join(postings, ["country", "channel", "key"]).join(side(ref, "l_", "s1"), "s1")
    pairs = pairs.where(S.gate(scoring.L, scoring.R, *p.gate))
    return pairs.select("s1", "src", "cid", "channel", scoring.SCORERS[p.scorer]().alias("score"))


def _keys_with_row(new: DataFrame, p: Profile) -> DataFrame:
    """Keys of each target beside its features, in one projection (a stream can't be joined with itself here)."""
    carried = new.select("*", F.struct("entity_id", *blocking.FEATURES).alias("r"))
    k = blocking.keys(carried.withColumn("src", F.struct("src", "r")), p)
    return k.select("country", "channel", "key", F.col("src.src").alias("src"), F.col("entity_id").alias("cid"), *[F.col(f"src.r.{f}").alias("r_" + f) for f in blocking.FEATURES])


def write_matches(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Best score of each pair by micro-batch, appended; a reader takes the maximum over batches."""

    def save(batch: DataFrame, _: int) -> None:
        batch.groupBy("s1", "src", "cid").agg(F.max("score").alias("score")).write.mode("append").parquet(path)

    return scores.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
