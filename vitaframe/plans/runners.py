"""Queries of the runners, list entries, text scores and earlier variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.functions.education import flat_record, parse_education, school_without_words, serialize_committees
from vitaframe.functions.text import normalize_name_early, slug_early
from vitaframe.operators import evaluate, extract, prompts, runners
from vitaframe.plans.inputs import BIOGRAPHIES, PREDICTIONS, TRUTH, biographies, predictions, truth, with_inputs
from vitaframe.plans.relational import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **inputs: str):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_inputs(sql, **inputs) if inputs else sql
        return run

    return add


_NAME = "CASE entity_id % 3 WHEN 0 THEN 'Jane Q. Doe' WHEN 1 THEN 'Ann Roe' ELSE 'Tim Poe' END"
_cues = lambda words: f"len(regexp_extract_all(text[1:2000], '(?i)\\b({words})\\b'))"
_M, _F = _cues("he|him|his|male|his career"), _cues("she|her|hers|female|her career")
_GENDER = f"CASE WHEN {_M} > {_F} THEN 'Male' WHEN {_F} > 0 THEN 'Female' END"
_BORN = "CASE entity_id % 4 WHEN 0 THEN '1965-01-01' WHEN 1 THEN '1962-01-15' WHEN 2 THEN '1971-03-01' END"
_FAITH = "CASE entity_id % 7 WHEN 0 THEN 'christian' WHEN 1 THEN 'jewish' WHEN 2 THEN 'orthodox' END"
_ROLES = "CASE WHEN entity_id % 2 = 0 THEN 'Budget Committee; Finance Committee' ELSE 'Finance Committee' END"
#: Biographies, one in eleven of them blank.
_TEXTS = f"SELECT entity_id, CASE WHEN entity_id % 11 = 0 THEN ' ' ELSE text END AS text FROM ({BIOGRAPHIES}) b"
_KNOWN = "entity_id % 11 <> 0"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biographies(spark, sf_dir).withColumn("text", F.when(F.col("entity_id") % 11 == 0, " ").otherwise(F.col("text")))


def _two() -> dict[str, runners.Method]:
    return {k: runners.METHODS[k] for k in ("regex", "keyword")}


_LONG = f"""
SELECT entity_id, 'regex' AS method, CASE WHEN {_KNOWN} THEN {_NAME} END AS full_name, CASE WHEN {_KNOWN} THEN {_GENDER} END AS gender, CASE WHEN {_KNOWN} THEN {_BORN} END AS birthdate,
  CAST(NULL AS VARCHAR) AS religion, CAST(NULL AS VARCHAR) AS committee_roles, CASE WHEN NOT ({_KNOWN}) THEN 'no text' END AS extraction_error FROM txt
UNION ALL
SELECT entity_id, 'keyword', CASE WHEN {_KNOWN} THEN {_NAME} END, NULL, NULL, CASE WHEN {_KNOWN} THEN {_FAITH} END, CASE WHEN {_KNOWN} THEN {_ROLES} END, CASE WHEN NOT ({_KNOWN}) THEN 'no text' END FROM txt"""


@query("k43_run_methods", f"SELECT * FROM ({_LONG})", txt=_TEXTS)
def _(spark, sf_dir):
    return runners.flat(runners.run_methods(_texts(spark, sf_dir), _two())).drop("education")


@query("k03_regex_record", f"SELECT entity_id, {_NAME} AS full_name, {_GENDER} AS gender, {_BORN} AS birthdate FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    return biographies(spark, sf_dir).select("entity_id", *(c.alias(k) for k, c in runners.extract_via_regex(F.col("text")).items()))


@query("k42_run_wide", f"SELECT entity_id, {_NAME} AS regex_full_name, {_BORN} AS regex_birthdate, {_FAITH} AS keyword_religion, CAST(1 + CAST(entity_id % 2 = 0 AS INTEGER) AS INTEGER) AS n_roles FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    wide = runners.run_wide(biographies(spark, sf_dir), _two())
    return wide.select("entity_id", "regex_full_name", "regex_birthdate", "keyword_religion", F.size("keyword_committee_roles").alias("n_roles"))


@query("k44_run_with_truth", f"SELECT r.entity_id, r.method, r.full_name AS pred_full_name, r.religion AS pred_religion, gt.full_name AS gt_full_name, gt.religion AS gt_religion FROM ({_LONG}) r LEFT JOIN gt USING (entity_id)", txt=_TEXTS, gt=TRUTH)
def _(spark, sf_dir):
    out = runners.run_with_truth(_texts(spark, sf_dir), truth(spark, sf_dir), _two())
    return out.select("entity_id", "method", "pred_full_name", "pred_religion", "gt_full_name", "gt_religion")


@query("k45_predictions_only", f"SELECT method, count(full_name) AS names, count(gender) AS genders, count(birthdate) AS dates, count(religion) AS religions, count(committee_roles) AS roles, count(*) AS n FROM ({_LONG}) GROUP BY method", txt=_TEXTS)
def _(spark, sf_dir):
    records, _ = runners.run_predictions_only(_texts(spark, sf_dir), _two())
    return records.groupBy("method").agg(F.count("full_name").alias("names"), F.count("gender").alias("genders"), F.count("birthdate").alias("dates"), F.count("religion").alias("religions"), F.count("committee_roles").alias("roles"), F.count("*").alias("n"))


@query("k46_quick_evaluation", f"SELECT entity_id, method, CAST((full_name IS NOT NULL)::INT + (gender IS NOT NULL)::INT + (birthdate IS NOT NULL)::INT + (religion IS NOT NULL)::INT + (committee_roles IS NOT NULL)::INT AS INTEGER) AS n_found FROM ({_LONG}) WHERE entity_id = 1", txt=_TEXTS)
def _(spark, sf_dir):
    from vitaframe.operators.evaluate import known_count

    return runners.quick_evaluation(_texts(spark, sf_dir), 1, _two()).select("entity_id", "method", known_count([x for x in runners.RECORD if x != "education"]).cast("int").alias("n_found"))


@query("d18_coverage_counts", f"SELECT 'regex' AS method, 'full_name' AS field, count(*) AS found, CAST(NULL AS DOUBLE) AS average FROM bio UNION ALL SELECT 'regex', 'birthdate', count({_BORN}), NULL FROM bio UNION ALL SELECT 'keyword', 'religion', count({_FAITH}), NULL FROM bio UNION ALL SELECT 'keyword', 'committee_roles', count(*), avg(1 + CAST(entity_id % 2 = 0 AS INTEGER)) FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    counts = runners.coverage_counts(runners.run_wide(biographies(spark, sf_dir), _two()))
    return counts.where("method = 'regex' and field in ('full_name', 'birthdate') or method = 'keyword' and field in ('religion', 'committee_roles')")


@query("k10_keyword_record", "SELECT entity_id, 'Oak ' || entity_id AS education, 'Baptist' AS religion, 'Finance' AS committee_roles, CAST(NULL AS VARCHAR) AS name FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    text = F.concat(F.lit("Education: Oak "), F.col("entity_id").cast("string"), F.lit("\nReligion\n\nBaptist\nCommittee : Finance\n"), F.col("text"))
    from vitaframe.functions import tables as T

    return biographies(spark, sf_dir).select("entity_id", *(extract.labelled_value(text, T.KEYWORDS_FOUR[k], header_too=True).alias(k) for k in T.KEYWORDS_FOUR))


_ENTITIES = "array(named_struct('text', concat('May ', entity_id % 31, ', ', 1950 + entity_id % 60), 'label', 'DATE'), named_struct('text', 'Ann Roe', 'label', 'PERSON'), named_struct('text', concat('School ', entity_id), 'label', 'ORG'), named_struct('text', 'Tim Poe', 'label', 'PERSON'))"


@query("k30_years_of_dates", "SELECT entity_id, CAST(1950 + entity_id % 60 AS VARCHAR) AS years FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    return biographies(spark, sf_dir).select("entity_id", F.array_join(extract.years_of_dates(F.expr(_ENTITIES)), ",").alias("years"))


@query("k29_first_of_types", "SELECT entity_id, 'Ann Roe' AS person, 'School ' || entity_id AS organisation, CAST(NULL AS VARCHAR) AS place FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    return biographies(spark, sf_dir).select("entity_id", *extract.first_of_types(F.expr(_ENTITIES), {"PERSON": "person", "ORG": "organisation", "GPE": "place"}))


@query("k22_entity_record", "SELECT entity_id, 'Ann Roe' AS full_name, CASE entity_id % 7 WHEN 0 THEN 'christian' WHEN 1 THEN 'jewish' WHEN 2 THEN 'orthodox' END AS religion, 0 AS n_roles FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    found = runners.run_methods(biographies(spark, sf_dir).withColumn("entities", F.expr(_ENTITIES)), {"ner": runners.extract_via_entities})
    return found.select("entity_id", "full_name", "religion", F.size("committee_roles").alias("n_roles"))


@query("i62_committees_text", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Budget; Rules' WHEN 1 THEN 'Budget' END AS roles FROM customer")
def _(spark, sf_dir):
    roles = F.expr("CASE c_custkey % 3 WHEN 0 THEN array('Budget', 'Rules') WHEN 1 THEN array('Budget') WHEN 2 THEN CAST(array() AS array<string>) END")
    return table(spark, sf_dir, "customer").select("c_custkey", serialize_committees(roles).alias("roles"))


@query(
    "i63_flat_record",
    """SELECT entity_id, CASE entity_id % 5 WHEN 0 THEN '[{"degree":"B.S.","institution":"Oak University","year":"1985"},{"degree":"J.D.","institution":"Yale","year":"1990"}]' WHEN 1 THEN '[{"degree":"Bachelor of Arts","institution":"University of Michigan","year":"1979"}]' WHEN 2 THEN '[{"degree":"MBA","institution":"MIT"}]' END AS education,
  CASE entity_id % 5 WHEN 1 THEN 'Armed Services|Budget' WHEN 2 THEN 'Role ' || CAST(entity_id AS STRING) END AS committee_roles FROM gt""",
    gt=TRUTH,
)
def _(spark, sf_dir):
    roles = F.expr("CASE entity_id % 5 WHEN 1 THEN array('Armed Services', 'Budget') WHEN 2 THEN array('Role ' || entity_id) WHEN 3 THEN CAST(NULL AS array<string>) ELSE CAST(array() AS array<string>) END")
    return truth(spark, sf_dir).select("entity_id", *flat_record(parse_education(F.col("education")), roles))


@query("s33_school_early", "SELECT s_suppkey, trim(replace(trim(replace(trim(replace(trim(lower('The University of ' || s_name)), 'university', '')), 'of', '')), 'the', '')) AS school FROM supplier")
def _(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", school_without_words(F.concat(F.lit("The University of "), F.col("s_name"))).alias("school"))


@query("s32_name_early", "SELECT entity_id, CASE entity_id % 7 WHEN 0 THEN 'katherine roe' WHEN 1 THEN 'jose m. nunez' WHEN 2 THEN 'tim doe' WHEN 3 THEN 'jane doe' WHEN 4 THEN 'daniel a. poe' WHEN 5 THEN 'chris lee' ELSE '' END AS name FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    return truth(spark, sf_dir).select("entity_id", normalize_name_early(F.col("full_name")).alias("name"))


@query("s35_slug_early", "SELECT entity_id, CASE entity_id % 7 WHEN 0 THEN 'Katie_Roe' WHEN 1 THEN 'José_Núñez' WHEN 2 THEN 'Tim_Doe' WHEN 3 THEN 'Jenny_Doe' WHEN 4 THEN 'Dan_Poe' WHEN 5 THEN 'Christopher_Lee' END AS slug FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    return truth(spark, sf_dir).select("entity_id", slug_early(F.col("full_name"), {"Jane_Doe": "Jenny_Doe"}).alias("slug"))


@query("j16_corpus_text_score", "SELECT 'full_name' AS field, avg(CASE WHEN lower(pred.full_name) = lower(gt.full_name) THEN 1.0 ELSE 0 END) AS score, count(*) AS n FROM pred JOIN gt USING (entity_id) WHERE gt.full_name IS NOT NULL", pred=PREDICTIONS, gt=TRUTH)
def _(spark, sf_dir):
    same = lambda p, t: (p == F.lower(t)).cast("double")
    joined = evaluate.join_truth(predictions(spark, sf_dir), truth(spark, sf_dir))
    return evaluate.corpus_text_score(joined, {"full_name": ("gt_full_name", "pred_full_name", F.lower)}, same)


@query("c08_join_or_names", "SELECT pred.entity_id, pred.method, gt.gender AS gt_gender FROM pred JOIN gt USING (entity_id)", pred=PREDICTIONS, gt=TRUTH)
def _(spark, sf_dir):
    return evaluate.join_truth_or_names(predictions(spark, sf_dir), truth(spark, sf_dir)).select("entity_id", "method", "gt_gender")


@query("c09_lookup_with_aliases", "SELECT entity_id, CASE entity_id % 7 WHEN 0 THEN 'A' WHEN 2 THEN 'B' END AS faith FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    names = spark.createDataFrame([("Katherine Roe", "A"), ("Doe Tim", "B"), ("Jane Doe", "C")], "full_name string, faith string")
    rows = truth(spark, sf_dir).select("entity_id", "full_name")
    return evaluate.fuzzy_lookup(rows, names, "full_name", "faith", {"Katie Roe": "Katherine Roe"}, ["Jane Doe"]).select("entity_id", "faith")


@query("e05_best_candidate_texts", "SELECT l_orderkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 1 THEN -1 ELSE l_quantity END DESC, l_returnflag) = 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("score", F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("double")))
    return evaluate.best_candidate_texts(rows, ["l_orderkey"], "score", "l_returnflag")


@query("h04_pivot_first", "SELECT o_custkey, min_by(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS F, min(o_orderkey) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    return evaluate.pivot_first(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", ["F", "O"], "o_orderkey")


@query("k35_single_entry", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'BS' WHEN 1 THEN 'JD' END AS degree, CASE c_custkey % 3 WHEN 0 THEN '1999' WHEN 2 THEN '2001' END AS year FROM customer")
def _(spark, sf_dir):
    text = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Oak College, BS, (1999)' WHEN 1 THEN 'Elm School JD' ELSE 'Ash Academy 2001' END")
    entry = extract.single_entry(text)
    return table(spark, sf_dir, "customer").select("c_custkey", entry["degree"].alias("degree"), entry["year"].cast("string").alias("year"))


@query("k33_value_cell", "SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'BA,JD,' ELSE 'BS' END AS degrees, CAST(CASE c_custkey % 2 WHEN 0 THEN 3 ELSE 1 END AS INTEGER) AS n FROM customer")
def _(spark, sf_dir):
    text = F.expr(r"CASE c_custkey % 2 WHEN 0 THEN 'Oak College (B.A., J.D.)\nElm School' ELSE 'Ash University (B.S.)' END")
    cells = extract.value_cell_entries(text)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(cells, lambda e: F.coalesce(e["degree"], F.lit(""))), ",").alias("degrees"), F.size(cells).alias("n"))


@query("k37_split_listing", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a|b|' WHEN 1 THEN 'a|b' ELSE 'a b' END AS parts FROM customer")
def _(spark, sf_dir):
    text = F.expr(r"CASE c_custkey % 3 WHEN 0 THEN 'a; b;' WHEN 1 THEN 'a\n\n b' ELSE 'a b' END")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(extract.split_listing(text), "|").alias("parts"))


@query(
    "k41_prompts",
    " UNION ALL ".join(f"SELECT entity_id, '{k}' AS style, length(text) + {len(v) - len('{text}')} AS n_chars, right(text, 20) AS ending FROM bio" for k, v in prompts.PROMPTS.items()),
    bio=BIOGRAPHIES,
)
def _(spark, sf_dir):
    """Every biography in every style's prompt."""
    asked = extract.with_prompts(biographies(spark, sf_dir), prompts.prompt_table(spark))
    full = F.replace("prompt", F.lit("{text}"), F.col("text"))
    return asked.select("entity_id", "style", F.length(full).cast("long").alias("n_chars"), F.right("text", F.lit(20)).alias("ending"))
