"""Predictions and truth derived from the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

METHODS = ["direct", "icl", "pseudocode", "regex"]

TRUTH = """
SELECT c_custkey AS entity_id,
  CASE c_custkey % 7 WHEN 0 THEN 'Katie Roe' WHEN 1 THEN 'José M. Núñez' WHEN 2 THEN 'Tim Doe' WHEN 3 THEN 'Jane Doe' WHEN 4 THEN 'Dan A. Poe' WHEN 5 THEN 'Christopher Lee' END AS full_name,
  CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'male ' END AS gender,
  CASE c_custkey % 9 WHEN 0 THEN 'Catholic' WHEN 1 THEN 'United Methodist' WHEN 2 THEN 'Jewish' WHEN 3 THEN 'Atheist' WHEN 4 THEN 'Baptist' WHEN 5 THEN 'Methodist Church of X' WHEN 6 THEN 'Zoroastrian' WHEN 7 THEN '' END AS religion,
  CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE CAST(1950 + c_custkey % 30 AS STRING) || '-0' || CAST(1 + c_custkey % 9 AS STRING) || '-1' || CAST(c_custkey % 10 AS STRING) END AS birthdate,
  CASE c_custkey % 5 WHEN 0 THEN 'B.S.|Oak University|1985|J.D.|Yale|1990' WHEN 1 THEN 'Bachelor of Arts|University of Michigan|1979' WHEN 2 THEN 'MBA|MIT|no year given' WHEN 3 THEN '' END AS education,
  CASE c_custkey % 5 WHEN 0 THEN '["Senate Committee on Finance","Judiciary"]' WHEN 1 THEN '["Armed Services"]' WHEN 2 THEN 'Budget' WHEN 3 THEN '["Rules","Ethics","Finance"]' END AS committee_roles
FROM {customer}
"""

PREDICTIONS = """
SELECT entity_id, method,
  CASE k % 7 WHEN 0 THEN 'Katherine Roe' WHEN 1 THEN 'jose nunez' WHEN 2 THEN 'Timothy Doe' WHEN 3 THEN 'DOE, JANE' WHEN 4 THEN 'Daniel Poe' WHEN 5 THEN ' christopher lee ' END AS full_name,
  CASE k % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'F' WHEN 2 THEN 'Male' END AS gender,
  CASE k % 9 WHEN 0 THEN 'catholic' WHEN 1 THEN 'Christian' WHEN 2 THEN 'judaism' WHEN 3 THEN 'none' WHEN 4 THEN 'Lutheran' WHEN 5 THEN 'christian' WHEN 6 THEN 'unknown' WHEN 7 THEN 'no info' END AS religion,
  CASE k % 6 WHEN 0 THEN CAST(1950 + k % 30 AS STRING) || '-03-12' WHEN 1 THEN '3/15/' || CAST(50 + k % 30 AS STRING) WHEN 2 THEN 'March 5, ' || CAST(1950 + k % 30 AS STRING) WHEN 3 THEN CAST(1950 + k % 30 AS STRING) WHEN 4 THEN 'not stated' END AS birthdate,
  CASE k % 5 WHEN 0 THEN 'BS|Oak University|1985' WHEN 1 THEN 'BA|Michigan|1980' WHEN 2 THEN 'M.B.A.|Massachusetts Institute of Technology|' WHEN 3 THEN 'JD|Yale University|1990|BA|Oak|' END AS education,
  CASE k % 5 WHEN 0 THEN '["Senate Finance Committee"]' WHEN 1 THEN '["Armed Services","Budget"]' WHEN 2 THEN 'budget' WHEN 3 THEN '["Finance","rules"]' END AS committee_roles
FROM (SELECT c_custkey AS entity_id, method, c_custkey + CASE WHEN c_custkey % 11 < 6 THEN 0 ELSE shift END AS k
  FROM {customer} CROSS JOIN (SELECT 'direct' AS method, 0 AS shift UNION ALL SELECT 'icl', 1 UNION ALL SELECT 'pseudocode', 2 UNION ALL SELECT 'regex', 3) m) t
"""

#: Texts that extractors find something in, built from order keys.
BIOGRAPHIES = """
SELECT o_orderkey AS entity_id,
  'Senator ' || CASE o_orderkey % 3 WHEN 0 THEN 'Jane Q. Doe' WHEN 1 THEN 'Ann Roe' ELSE 'Tim Poe' END
  || CASE o_orderkey % 4 WHEN 0 THEN ' was born in 1965.' WHEN 1 THEN ' was born January 15, 1962.' WHEN 2 THEN ' was born March 1971.' ELSE ' lives in Ohio.' END
  || CASE o_orderkey % 5 WHEN 0 THEN ' He and his wife' WHEN 1 THEN ' She and her sister' WHEN 2 THEN ' He met her' ELSE ' They' END
  || CASE o_orderkey % 3 WHEN 0 THEN ' went to Oak University in 1985 for a B.S. and stayed.' WHEN 1 THEN ' hold a J.D. from Elm College since 1990.' ELSE ' studied.' END
  || CASE o_orderkey % 7 WHEN 0 THEN ' A Baptist,' WHEN 1 THEN ' A jewish Republican,' WHEN 2 THEN ' An orthodox democrat,' ELSE ' Quietly,' END
  || ' the member is a Member of the Senate Finance Committee' || CASE o_orderkey % 2 WHEN 0 THEN ' and serves on the Budget Committee.' ELSE '.' END
  || ' Write to a' || CAST(o_orderkey % 10 AS STRING) || '@example.org or call 202-555-01' || CAST(10 + o_orderkey % 90 AS STRING) || ' (since 200' || CAST(o_orderkey % 10 AS STRING) || ').' AS text
FROM {orders}
"""


def portable(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL whose tables stand in braces."""
    import re

    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(text: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_inputs(query: str, **inputs: str) -> str:
    """DuckDB SQL with the inputs as common table expressions."""
    return "WITH " + ",\n".join(f"{k} AS ({duck(v)})" for k, v in inputs.items()) + ("\n" + query if query.lstrip().upper().startswith("SELECT") else ",\n" + query)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, TRUTH)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, PREDICTIONS)


def biographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, BIOGRAPHIES)
