"""Queries of the whole-record operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.functions.education import parse_education
from vitaframe.functions.text import is_missing
from vitaframe.operators import evaluate, profile, semantic
from vitaframe.operators.evaluate import join_truth
from vitaframe.plans.inputs import BIOGRAPHIES, PREDICTIONS, TRUTH, biographies, predictions, truth, with_inputs
from vitaframe.plans.relational import _JOIN, BASE, LONG, SCORES, _score_sql, table
from vitaframe.plans.scalars import ORACLE_SQL as SCALAR_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **inputs: str):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_inputs(sql, **inputs) if inputs else sql
        return run

    return add


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_truth(predictions(spark, sf_dir), truth(spark, sf_dir))


def _scalar_sql(name: str) -> str:
    body = SCALAR_SQL[name].split("SELECT entity_id, method, ", 1)[1]
    return body[: body.rindex(" AS result FROM (SELECT entity_id, method,")]


@query("i38_standardize_records", "SELECT entity_id, method, " + ", ".join(f"(SELECT {_scalar_sql(q)} FROM (SELECT {c} AS x)) AS {n}" for q, c, n in (("i12_standardize_full_name", "full_name", "full_name"), ("i13_valid_full_name", "full_name", "full_name_valid"), ("i14_standardize_gender", "gender", "gender"), ("i19_standardize_birthdate", "birthdate", "birthdate"), ("i20_valid_birthdate", "birthdate", "birthdate_valid"), ("i33_standardize_religion", "religion", "religion"), ("i35_valid_religion", "religion", "religion_valid"))) + " FROM pred", pred=PREDICTIONS)
def _(spark, sf_dir):
    out = profile.standardize_records(predictions(spark, sf_dir), ["entity_id", "method"])
    v = "_validation."
    return out.select("entity_id", "method", "full_name", F.col(v + "full_name_valid"), "gender", "birthdate", F.col(v + "birthdate_valid"), "religion", F.col(v + "religion_valid"))


@query("i31_standardize_education")
def _(spark, sf_dir):
    return profile.standardize_records(predictions(spark, sf_dir), ["entity_id", "method"]).select("entity_id", "method", F.to_json("education").alias("education"))


@query("j21_education_alignment")
def _(spark, sf_dir):
    lists = _joined(spark, sf_dir).select("entity_id", "method", parse_education(F.col("pred_education")).alias("p"), parse_education(F.col("gt_education")).alias("t"))
    return profile.education_alignment(lists, ["entity_id", "method"], "p", "t")


@query("j22_first_entries")
def _(spark, sf_dir):
    return _joined(spark, sf_dir).select("entity_id", "method", profile.first_entries_score(F.col("pred_education"), F.col("gt_education")).alias("score"))


_N = lambda x: f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE (len(string_split({x}, '|')) + 1) // 3 END"
_EDU = _score_sql("j15_text_score").split("ELSE ", 1)[1].removesuffix(" END")
_ACC = (
    f"SELECT method, 'name' AS field, CASE WHEN pred_full_name IS NULL THEN 0.0 ELSE CAST(lower(trim(pred_full_name)) = lower(trim(gt_full_name)) AS DOUBLE) END AS accuracy FROM ({_JOIN}) WHERE gt_full_name IS NOT NULL "
    f"UNION ALL SELECT method, 'education_entries', CASE WHEN {_N('pred_education')} = {_N('gt_education')} THEN 1.0 WHEN abs({_N('pred_education')} - {_N('gt_education')}) = 1 THEN 0.5 ELSE 0.0 END FROM ({_JOIN}) WHERE gt_education IS NOT NULL"
)


@query("j28_baseline_accuracy", f"SELECT method, field, avg(accuracy) AS mean, count(*) AS n FROM ({_ACC}) GROUP BY method, field", **BASE)
def _(spark, sf_dir):
    return profile.baseline_accuracy(_joined(spark, sf_dir)).where("field <> 'education'").groupBy("method", "field").agg(F.avg("accuracy").alias("mean"), F.count("*").alias("n"))


@query("s01_baseline_summary", f"SELECT method, avg(accuracy) FILTER (field = 'name') AS name, avg(accuracy) FILTER (field = 'education_entries') AS education_entries FROM ({_ACC}) GROUP BY method", **BASE)
def _(spark, sf_dir):
    return profile.baseline_summary(profile.baseline_accuracy(_joined(spark, sf_dir)), ["name", "education_entries"])


@query("j29_row_scores")
def _(spark, sf_dir):
    return profile.row_scores(_joined(spark, sf_dir))


@query("j33_semantic_stand_in")
def _(spark, sf_dir):
    return semantic.semantic_scores(_joined(spark, sf_dir), "pred_committee_roles", "gt_committee_roles", lambda: semantic.hashed_vectors).select("entity_id", "method", "score")


_COUNTS = ", ".join(f"count(gt_{f}) AS {f}_n_gt, count(pred_{f}) AS {f}_n_pred" for f in ("gender", "religion", "education"))


@query("j36_evaluate_methods", f"SELECT * FROM (SELECT method, field, avg(score) AS mean, count(score) AS coverage_n, count(score) * 100.0 / count(*) AS coverage_pct FROM long GROUP BY method, field) JOIN (SELECT method, count(*) AS record_count, {_COUNTS} FROM ({_JOIN}) GROUP BY method) USING (method)", **SCORES, long=LONG)
def _(spark, sf_dir):
    return profile.evaluate_methods(predictions(spark, sf_dir), truth(spark, sf_dir))


@query("s03_fill_rate", "SELECT method, (count(gender) + count(religion) + count(education)) * 100.0 / (count(*) * 3) AS fill_pct FROM pred GROUP BY method", pred=PREDICTIONS)
def _(spark, sf_dir):
    return profile.fill_rate(predictions(spark, sf_dir), ["gender", "religion", "education"])


@query("s05_coverage_tier", "SELECT method, CASE WHEN count(birthdate) * 100.0 / count(*) >= 70 THEN 'high' WHEN count(birthdate) * 100.0 / count(*) >= 30 THEN 'medium' ELSE 'low' END AS tier FROM pred GROUP BY method", pred=PREDICTIONS)
def _(spark, sf_dir):
    return evaluate.coverage(predictions(spark, sf_dir), "method", ["birthdate"]).select("method", profile.coverage_tier(F.col("pct")).alias("tier"))


_YEAR = "nullif(CASE WHEN {x} LIKE '%no year%' THEN NULL ELSE string_split({x}, '|')[3] END, '')"


@query("m04_year_failures", f"SELECT method, CASE WHEN p IS NULL THEN 'missing' WHEN p = t THEN 'match' ELSE 'wrong' END AS outcome, count(*) AS n FROM (SELECT method, {_YEAR.format(x='pred_education')} AS p, {_YEAR.format(x='gt_education')} AS t FROM ({_JOIN})) WHERE t IS NOT NULL GROUP BY ALL", **BASE)
def _(spark, sf_dir):
    return profile.year_failures(_joined(spark, sf_dir))


_D = SCALAR_SQL["i23_normalize_degree"].split("SELECT entity_id, ", 1)[1].rsplit(" AS result FROM (SELECT entity_id", 1)[0]
_DEG = lambda c: f"(SELECT {_D} FROM (SELECT string_split({c}, '|')[1] AS x))"


@query("m05_degree_details", f"SELECT entity_id, method, gt_degree, pred_degree, gt_degree = pred_degree AS match FROM (SELECT entity_id, method, {_DEG('gt_education')} AS gt_degree, {_DEG('pred_education')} AS pred_degree FROM ({_JOIN}))", **BASE)
def _(spark, sf_dir):
    return profile.degree_details(_joined(spark, sf_dir))


@query("m03_clean_truth", "SELECT entity_id, CASE WHEN contains(lower(committee_roles), 'committee') THEN committee_roles ELSE '' END AS committee_roles, length(committee_roles) AS before, CAST(CASE WHEN contains(lower(committee_roles), 'committee') THEN length(committee_roles) ELSE 0 END AS BIGINT) AS after FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    return profile.clean_truth(truth(spark, sf_dir)).withColumns({"before": F.col("before").cast("long"), "after": F.col("after").cast("long")})


@query("m06_score_ranges", "SELECT field, min(score) AS low, max(score) AS high, coalesce(min(score), 0) >= 0 AS from_zero, coalesce(max(score), 0) <= 1 AS to_one FROM long GROUP BY field", **SCORES, long=LONG)
def _(spark, sf_dir):
    return profile.score_ranges(evaluate.with_scores(_joined(spark, sf_dir)))


@query("k47_religion_signal", "SELECT entity_id, CASE WHEN entity_id % 7 IN (0, 1, 2) THEN 'explicit' ELSE 'not_explicit' END AS signal FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    return biographies(spark, sf_dir).select("entity_id", profile.religion_signal(F.col("text")).alias("signal"))


@query("m02_missing_by_term", "SELECT entity_id, method, religion IS NULL OR trim(religion) = '' OR lower(trim(religion)) IN ('unknown', 'none', 'no info') AS gone FROM pred", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).select("entity_id", "method", is_missing(F.col("religion")).alias("gone"))
