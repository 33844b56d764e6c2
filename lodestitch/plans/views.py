"""Entity views over the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

#: Customers as businesses of three sources in two countries; every row takes part.
ENTITIES = """
SELECT c_custkey AS id, CAST(c_custkey % 3 + 1 AS INT) AS source, CASE WHEN n_regionkey < 3 THEN 'us' ELSE 'india' END AS country,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(c_mktsegment) || ' ' || CASE c_nationkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'pharma' WHEN 2 THEN 'the shine' ELSE 'wheel' END
    || ' ' || CAST(c_nationkey AS STRING) || CASE WHEN c_custkey % 5 = 0 THEN ' trading ' ELSE ' traders ' END || CAST(c_custkey % 8 AS STRING) END AS norm_name,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END || CAST(c_custkey % 100 AS STRING) || ' ' || lower(c_mktsegment) || ' street '
    || CASE WHEN c_custkey % 7 = 0 THEN '15b ' ELSE '' END
    || CASE c_nationkey % 5 WHEN 0 THEN 'springfield' WHEN 1 THEN 'portland' WHEN 2 THEN 'jaipur' WHEN 3 THEN 'nagpur' ELSE 'dallas' END || ' '
    || CASE WHEN n_regionkey < 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'il' ELSE 'or' END ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'tamil nadu' ELSE 'goa' END END || ' '
    || lpad(CAST(c_custkey % 700 AS STRING), CASE WHEN n_regionkey < 3 THEN 5 ELSE 6 END, '7') END AS norm_address,
  c_nationkey * 1000 + length(c_mktsegment) * 60 + c_custkey % 40 AS truth_key
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

#: Events as scored candidate pairs: the user is the S1, the event the target; label, decision and evidence follow from the columns.
SCORED = """
SELECT user_id AS s1_id, CASE WHEN event_type IN ('click', 'view') THEN 2 ELSE 3 END AS target_source, event_id AS target_id,
  CASE WHEN value >= 50 THEN 0.99 + least(value, 500) / 50000 ELSE value / 50 END AS score,
  CASE WHEN value * 7 % 10 > 4 THEN 1 ELSE 0 END AS label, event_type,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 100 / 100.0e0 END AS address_token_set_ratio, value / 500 AS name_ratio,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 / 2.0e0 END AS address_number_set_jaccard,
  event_id % 7 / 7.0e0 AS translit_skeleton_ratio, event_id % 50 + 1 AS target_name_frequency,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 2 AS INT) END AS house_number_match, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS target_address_missing,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 13 / 12.0e0 END AS translit_name_ratio, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 21 / 20.0e0 END AS address_ratio,
  CAST(event_id % 6 = 0 AS INT) AS name_exact, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 3 = 0 AS INT) END AS house_city_match,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 4 <> 0 AS INT) END AS city_match, CAST(event_id % 5 = 0 AS INT) AS house_city_hit, CAST(event_id % 4 + 1 AS INT) AS n_channels,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 100 AS INT) END AS name_char_rank, CASE WHEN event_id % 4 = 1 THEN NULL ELSE CAST(event_id % 25 AS INT) END AS address_char_rank,
  CAST(event_id % 31 = 0 AS INT) AS target_name_missing, CAST(user_id % 19 = 0 AS INT) AS s1_address_missing, event_id % 6 = 1 AS cross_script,
  CASE event_id % 5 WHEN 0 THEN 'non-latin' WHEN 1 THEN 'mixed' ELSE 'latin' END AS target_script, CASE event_id % 7 WHEN 0 THEN 'non-latin' WHEN 1 THEN 'none' ELSE 'latin' END AS s1_script,
  event_id % 2 = 0 AS other_scripts
FROM events
"""


def of(customers: DataFrame, nations: DataFrame) -> DataFrame:
    return customers.sparkSession.sql(ENTITIES.replace("FROM customer JOIN nation", "FROM {c} JOIN {n}"), c=customers, n=nations)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # dealt before anything is made of them: a table of few files is read by few tasks
    rows = of(table(spark, sf_dir, "customer").repartition("c_custkey"), table(spark, sf_dir, "nation"))
    return rows.where("source = 1"), rows.where("source > 1")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    b = b.select("truth_key", b["source"].alias("target_source"), b["id"].alias("target_id"))
    return a.select(a["id"].alias("s1_id"), "country", "truth_key").join(b, "truth_key").select("s1_id", "country", "target_source", "target_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED.replace("FROM events", "FROM {e}"), e=table(spark, sf_dir, "events"))
