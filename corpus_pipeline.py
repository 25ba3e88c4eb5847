"""A corpus pipeline of four stages over ``documents``; each stage calls one operator of kindred.llm.

toxicity       drops documents the factorization machine scores 0.5 or more
near_dedup     keeps the document with the smallest id of each near-duplicate group (five-word shingles,
               similarity 0.8 or more)
suffix_dedup   cuts bytes of 50-byte strings that also start in a document with a smaller id
packing        packs the rest along a space-filling curve into sequences of at most 2048 tokens

All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import near_groups, packing, suffix_dedup, toxicity
from kindred.llm.common import drop_written, materialize, table, written

SIMILARITY, SHINGLE = 0.8, 5


def spare(docs: DataFrame, name: str) -> str:
    """name, or name with underscores where docs has such a column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of 0.5 or more go; null texts count as empty.  An empty table stays empty; without labels
    every row stays.  All columns of docs stay, whatever their names."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    name = spare(docs, "toxicity")
    return toxicity.score(docs, machine, name=name).where(F.col(name) < 0.5).drop(name)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts count as empty, and texts without words are near-duplicates of each other; rows with a null id stay;
    an empty table stays empty; all columns of docs stay, whatever their names.  Of a group's rows the one with the smallest id stays, and the smallest text hash if
    that id has several texts; of rows that share id and text the smallest by all columns stays.  Texts that share
    an id but are not near-duplicates all stay."""
    found = near_groups.near_groups(docs, SHINGLE, SIMILARITY)
    found = materialize(found.where("doc_id is not null").select("doc_id", "text_hash", "kept"), "groups")
    key = ["doc_id", spare(docs, "text_hash")]
    found = found.withColumnRenamed("text_hash", key[1])
    losers = found.where("not kept").select(*key).distinct()
    kept = docs.withColumn(key[1], F.xxhash64(F.col("text").cast("string"))).join(losers, key, "left_anti")
    if found.groupBy(*key).count().where("count > 1").isEmpty():
        return kept.select(*docs.columns)
    once = kept.where("doc_id is not null").groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(kept.where("doc_id is null").select(*docs.columns))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters of which a byte goes, go; n_chars is that of the new text.  Null texts become empty; rows that share
    an id never cut each other; rows with a null id stay whole; an empty table stays empty; all other columns stay as
    they are, whatever their names."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    other = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(rest)])
    kept = suffix_dedup.repeated(other, carry=other.columns[2:], with_text=True)
    back = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long"), **{c: F.col(f"other{i}") for i, c in enumerate(rest)}}
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, as ``packing.pack`` has them; null texts count as empty, an empty table gives
    none, other columns are ignored."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Trained models, hashes and a tokenizer decide the rows; the tests hold the operators against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, mark, keep=1)  # the stage before, and what this one wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
