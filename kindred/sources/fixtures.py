"""Entity-resolution records made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = """
SELECT concat('S', 1 + p_partkey % 3, '-', p_partkey) AS entity_id, p_name AS business_name,
  concat(CASE WHEN (p_partkey div 7) % 5 = 0 THEN '' ELSE concat(p_size, ' ') END, p_type, ' Road, ', replace(p_brand, '#', ''),
    CASE WHEN p_partkey % 2 = 1 THEN concat(', ', element_at(array('Rajasthan', 'Haryana', 'Kerala'), cast(1 + (p_partkey div 11) % 3 AS int)))
         ELSE concat(', ', element_at(array('TX', 'NY', 'WA'), cast(1 + (p_partkey div 11) % 3 AS int))) END,
    CASE WHEN (p_partkey div 5) % 4 = 0 THEN concat(', ', 10000 + p_size) ELSE '' END) AS business_address,
  CASE p_partkey % 2 WHEN 1 THEN 'India' ELSE 'US' END AS country, p_brand
FROM {part}"""


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART, part=spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))


def part_truth(records: DataFrame) -> DataFrame:
    """Synthetic truth: pairs (s1, cid) with the same name, brand and country."""
    a = records.where("entity_id like 'S1-%'").selectExpr("entity_id AS s1", "business_name", "p_brand", "country")
    b = records.where("entity_id not like 'S1-%'").selectExpr("entity_id AS cid", "business_name", "p_brand", "country")
    return a.join(b, ["business_name", "p_brand", "country"]).select("s1", "cid")


def part_key() -> Column:
    """Records with equal keys are true pairs of ``part_truth``; null for a record without any."""
    cols = ["business_name", "p_brand", "country"]
    return F.when(F.concat(*cols).isNotNull(), F.struct(*cols))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return df.selectExpr("concat('S', 1 + doc_id % 3, '-', doc_id) AS entity_id", "array_join(slice(split(trim(lower(text)), '\\\\s+'), 1, 6), ' ') AS business_name", "'' AS business_address", "lang AS country")


#: Records of firms, four to an entity, in SQL that both engines read.  The first is the reference's; the others differ
#: in legal form, order, spacing, spelling, script, number, street, postcode, state and country.
_PICK = "split_part('{list}', ',', CAST(1 + {at} % {n} AS INT))"


def _pick(words: str, at: str) -> str:
    return _PICK.format(list=words, at=at, n=words.count(",") + 1)


_BRAND = f"concat({_pick('Arav,Bela,Corin,Delt,Etna,Fargo,Gitan,Himal,Indus,Jayan', 'e')}, {_pick('soft,mart,chem,lines,works,trade,foods,steel,power,media,craft', 'CAST(floor(e / 10) AS BIGINT)')}, {_pick(',ia,on,el,um,ora,ex,ix,ano,eta', 'CAST(floor(e / 110) AS BIGINT)')})"
_SECOND = _pick("Global,United,Prime,Royal,Om,Sai,North Star", "e")
_KIND = _pick("Foods,Motors,Exports,Metals,Textiles", "e")
_STREET = _pick("Lotus,Station,Temple,Church,Market,Garden,Palm,Hill,Rampur", "e")
_INDIA = _pick("Mumbai Maharashtra,Pune MH,Hyderabad Telangana,Vijayawada Andhra Pradesh,Chennai Tamil Nadu,Kolkata West Bengal,Jaipur Rajasthan", "e")
_US = _pick("Austin TX,Albany NY,Seattle WA,Salem OR,Macon GA", "e")
_FRANCE = _pick("Lyon,Paris,Nantes,Lille", "e")
FIRMS = f"""
SELECT concat(CASE v WHEN 0 THEN 'S1-' WHEN 3 THEN 'S3-' ELSE 'S2-' END, k) AS entity_id,
  CASE WHEN v = 0 OR (e + v) % 13 = 0 THEN concat(brand, ' ', second, ' ', kind, ' Pvt Ltd')
    WHEN (e + v) % 13 = 1 THEN concat(brand, ' ', second, ' ', kind, ' LLP')
    WHEN (e + v) % 13 = 2 THEN concat(second, ' ', brand, ' ', kind, ' Limited')
    WHEN (e + v) % 13 = 3 THEN concat(brand, second, ' ', kind, ' Pvt. Ltd.')
    WHEN (e + v) % 13 = 4 THEN concat(substr(brand, 1, 4), 'xa ', second, ' ', kind)
    WHEN (e + v) % 13 = 5 THEN concat(brand, ' ', kind)
    WHEN (e + v) % 13 = 6 THEN concat(kind, ' and Sons')
    WHEN (e + v) % 13 = 7 THEN concat('www.', lower(brand), '.com ', second, ' ', kind)
    WHEN (e + v) % 13 = 8 THEN concat(replace(brand, 'e', 'é'), ' ', upper(second), ' ', kind, ' & Co.')
    WHEN (e + v) % 13 = 9 THEN concat('कमल ', second, ' ', kind)
    WHEN (e + v) % 13 = 10 THEN concat(substr(brand, 1, 5), ' ', substr(brand, 6, 9), ' ', second, ' ', kind, ' Pvt Ltd')
    WHEN (e + v) % 13 = 11 THEN concat(brand, ' Ltd')
    ELSE concat(brand, ' ', second) END AS business_name,
  CASE WHEN (e + 3 * v) % 17 = 0 THEN '' ELSE concat(
    CASE WHEN v > 0 AND (e + v) % 5 = 1 THEN '' ELSE concat(n + CASE WHEN v > 0 AND (e + v) % 5 = 2 THEN 1 WHEN v > 0 AND (e + v) % 7 = 3 THEN 20 ELSE 0 END, ' ') END,
    CASE WHEN v > 0 AND (e + 2 * v) % 11 = 4 THEN replace(street, 'a', 'e') ELSE street END, ' Road, ',
    CASE WHEN (e + v) % 6 = 0 THEN 'Old Quarter, ' ELSE '' END,
    CASE WHEN v > 0 AND (e + v) % 19 = 5 THEN 'Patna Bihar' ELSE place END,
    CASE WHEN (e + 2 * v) % 4 = 1 THEN '' ELSE concat(' ', post + CASE WHEN v > 0 AND (e + v) % 23 = 7 THEN 1 ELSE 0 END) END) END AS business_address,
  country
FROM (SELECT k, e, v, {_BRAND} AS brand, {_SECOND} AS second, {_KIND} AS kind, {_STREET} AS street, 1 + (e * 7) % 90 + 90 * CAST(floor(e / 300) AS BIGINT) AS n,
    CASE WHEN e % 5 < 3 THEN {_INDIA} WHEN e % 5 = 3 THEN {_US} ELSE {_FRANCE} END AS place,
    CASE WHEN e % 5 < 3 THEN 400000 WHEN e % 5 = 3 THEN 70000 ELSE 69000 END + e % 60 + 60 * CAST(floor(e / 300) AS BIGINT) AS post,
    CASE WHEN e % 5 < 3 THEN 'India' WHEN e % 5 = 3 THEN 'US' ELSE 'France' END AS country
  FROM (SELECT k, CAST(floor(k / 4) AS BIGINT) % 300 + 300 * CAST(floor(k / 4800) AS BIGINT) AS e, k % 4 AS v FROM {{part}}) a) b"""


def firm_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firms_of(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")))


def firms_of(numbers: DataFrame) -> DataFrame:
    """Firm records of the numbers k: about four entities share each name and place, however many there are."""
    return numbers.sparkSession.sql(FIRMS, part=numbers)


def firm_truth(records: DataFrame) -> DataFrame:
    """Pairs (s1, cid) of one entity: four records with consecutive numbers."""
    entity = "cast(floor(cast(substring_index(entity_id, '-', -1) AS bigint) / 4) AS bigint)"
    a = records.where("entity_id like 'S1-%'").selectExpr("entity_id AS s1", f"{entity} AS e")
    return a.join(records.where("entity_id not like 'S1-%'").selectExpr("entity_id AS cid", f"{entity} AS e"), "e").select("s1", "cid")
