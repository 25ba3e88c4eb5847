"""Scans and sinks of the native formats, and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Tab-separated records: quoted fields may hold tabs, doubled quotes and line ends; short rows are padded;
    missing values are empty strings."""
    df = spark.read.schema(RECORD).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(list(paths))
    return df.fillna("")


def split_ids(col):
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), F.trim), lambda x: x != "")


def read_lists(spark: SparkSession, path: str, name: str = "matched_entity_ids") -> DataFrame:
    """Ground truth or results: id and comma list (empty: no ids)."""
    df = spark.read.schema(f"source1_entity_id string, {name} string").option("sep", "\t").option("header", True).csv(path)
    return df.select(F.trim("source1_entity_id").alias("source1_entity_id"), split_ids(F.col(name)).alias(name))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """First column of a raw text file without its header; no quoting; blank lines go."""
    df = spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("id"))
    return df.where("id <> '' and id <> 'entity_id'")


def header_fault(spark: SparkSession, path: str, expected: list[str]) -> str | None:
    """What is wrong with the first line of a results file: empty, commas for tabs, or other columns."""
    first = spark.read.text(path).first()
    if first is None:
        return "empty"
    if "\t" not in first["value"] and "," in first["value"]:
        return "comma separated"
    cols = [c.strip().lower() for c in first["value"].split("\t")]
    return None if cols == expected else f"unexpected header {cols}"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id, ids (as written: no trimming, repeats and empty items stay), malformed (a line without a
    tab) of a results file; blank lines and header lines go."""
    lines = spark.read.text(path).where("trim(value) <> ''").where(~F.lower("value").startswith("source1_entity_id\t"))
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    malformed = F.instr("value", "\t") == 0
    ids = F.when(malformed | (F.trim(rest) == ""), F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    return lines.select(F.substring_index("value", "\t", 1).alias("source1_entity_id"), ids.alias("ids"), malformed.alias("malformed"))


def head(df: DataFrame, n: int, id_col: str = "entity_id", keep: DataFrame | None = None) -> DataFrame:
    """The first n rows in order of id, and those whose id is in keep (id): an evaluation subset."""
    first = df.orderBy(id_col).limit(n)
    if keep is None:
        return first
    rest = df.join(keep.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    return first.unionByName(rest.join(first.select(id_col), id_col, "left_anti").select(*df.columns))


def side_by_side(a: DataFrame, b: DataFrame, n: int = 20, id_col: str = "source1_entity_id") -> DataFrame:
    """The first n ids that both have, with the other columns of both (of the second one with the suffix _2)."""
    other = b.select(id_col, *[F.col(c).alias(f"{c}_2") for c in b.columns if c != id_col])
    return a.join(other, id_col).orderBy(id_col).limit(n)


def backup(spark: SparkSession, path: str) -> bool:
    """Copy path to path.bak unless that exists or there is nothing to copy; whether it did."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".bak")
    fs = src.getFileSystem(conf)
    if fs.exists(dst) or not fs.exists(src):
        return False
    return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, fs, dst, False, conf))


def write_lists(df: DataFrame, path: str, name: str = "matched_entity_ids", files: int | None = None) -> None:
    """Id and comma list with a header, in order of id; an existing path is never replaced.  Directory commit is
    atomic; ``files`` = 1 gives a single file."""
    out = df.select("source1_entity_id", F.array_join(name, ",").alias(name))
    out = out.coalesce(1) if files == 1 else out
    out.sortWithinPartitions("source1_entity_id").write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
