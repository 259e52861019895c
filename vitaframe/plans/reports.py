"""Queries of filters, per-group reports, set differences, pivots and row counts over predictions and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.functions.dates import parse_date
from vitaframe.operators import evaluate, quality
from vitaframe.operators.evaluate import join_truth, long_scores, with_scores
from vitaframe.plans.inputs import METHODS, PREDICTIONS, predictions, truth, with_inputs
from vitaframe.plans.relational import _JOIN, _PARTS, BASE, FIELDS, LONG, SCORES, _errors_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str, **inputs: str):
    def add(run):
        QUERIES[name] = run
        ORACLE_SQL[name] = with_inputs(sql, **inputs) if inputs else sql
        return run

    return add


def _joined(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    return join_truth(predictions(spark, sf_dir), truth(spark, sf_dir), how=how)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(_joined(spark, sf_dir))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_errors(_joined(spark, sf_dir), ["gender", "religion"])


_ERRORS = _errors_sql()
_KINDS = ["missing_pred", "false_positive", "mismatch", "partial_match", "correct"]


@query("b02_prefixed_columns", _JOIN, **BASE)
def _(spark, sf_dir):
    return _joined(spark, sf_dir)


@query("b04_one_method", "SELECT entity_id, gender FROM pred WHERE method = 'icl'", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).where("method = 'icl'").select("entity_id", "gender")


@query("b06_without_missing", "SELECT entity_id, method FROM pred WHERE NOT (religion IS NULL OR birthdate IS NULL)", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).where(~(F.col("religion").isNull() | F.col("birthdate").isNull())).select("entity_id", "method")


@query("b07_some_methods", "SELECT entity_id, method FROM pred WHERE method IN ('icl', 'regex')", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).where(F.col("method").isin("icl", "regex")).select("entity_id", "method")


@query("b11_not_extracted", "SELECT entity_id, method, coalesce(religion, 'Not extracted') AS religion, substr(coalesce(education, 'Not extracted'), 1, 10) AS education FROM pred", pred=PREDICTIONS)
def _(spark, sf_dir):
    known = lambda c: F.coalesce(c, F.lit("Not extracted"))
    return predictions(spark, sf_dir).select("entity_id", "method", known("religion").alias("religion"), F.substring(known("education"), 1, 10).alias("education"))


@query("b15_known_rows", "SELECT entity_id, method, birthdate FROM pred WHERE birthdate IS NOT NULL", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).dropna(subset=["birthdate"]).select("entity_id", "method", "birthdate")


@query("c03_outer_truth", "SELECT pred.entity_id, method, pred.gender AS pred_gender, gt.gender AS gt_gender FROM pred LEFT JOIN gt ON pred.entity_id = gt.entity_id AND gt.gender IS NOT NULL", **BASE)
def _(spark, sf_dir):
    known = truth(spark, sf_dir).where("gender is not null")
    return join_truth(predictions(spark, sf_dir), known, how="left").select("entity_id", "method", "pred_gender", "gt_gender")


@query("c13_names_not_built", "SELECT DISTINCT full_name FROM pred WHERE full_name IS NOT NULL AND full_name NOT IN (SELECT full_name FROM gt WHERE full_name IS NOT NULL)", **BASE)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).where("full_name is not null").join(truth(spark, sf_dir).select("full_name"), "full_name", "left_anti").select("full_name").distinct()


@query("d02_method_means", "SELECT method, avg(religion_score) AS mean, count(religion_score) AS n FROM scored GROUP BY method", **SCORES)
def _(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("method").agg(F.avg("religion_score").alias("mean"), F.count("religion_score").alias("n"))


@query("d08_known_counts", "SELECT method, " + ", ".join(f"count({f}) AS {f}" for f in FIELDS) + " FROM pred GROUP BY method", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("method").agg(*(F.count(f).alias(f) for f in FIELDS))


@query("d09_coverage_all_rows", " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) * 100.0 / count(*) AS pct FROM pred" for f in FIELDS), pred=PREDICTIONS)
def _(spark, sf_dir):
    known = predictions(spark, sf_dir).agg(*((F.count(f) * 100.0 / F.count("*")).alias(f) for f in FIELDS))
    return known.unpivot([], FIELDS, "field", "pct")


@query("d14_field_stats", "SELECT method, field, stddev_pop(score) AS std, min(score) AS low, max(score) AS high, count(score) AS n_evaluated, count(*) FILTER (score IS NULL) AS n_skipped FROM long GROUP BY method, field", **SCORES, long=LONG)
def _(spark, sf_dir):
    s = F.col("score")
    return long_scores(_scores(spark, sf_dir)).groupBy("method", "field").agg(F.stddev_pop(s).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"), F.count(s).alias("n_evaluated"), F.count_if(s.isNull()).alias("n_skipped"))


@query("d24_flag_combinations", "SELECT religion IS NULL AS no_religion, birthdate IS NULL AS no_birthdate, education IS NULL AS no_education, count(*) AS n FROM pred GROUP BY ALL ORDER BY n DESC, no_religion, no_birthdate, no_education LIMIT 10", pred=PREDICTIONS)
def _(spark, sf_dir):
    flags = [F.col(f).isNull().alias(f"no_{f}") for f in ("religion", "birthdate", "education")]
    names = ["no_religion", "no_birthdate", "no_education"]
    return predictions(spark, sf_dir).select(*flags).groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names).limit(10)


@query("d28_error_shares", "SELECT field, e AS error_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY field) AS pct FROM errors GROUP BY field, e", **BASE, errors=_ERRORS)
def _(spark, sf_dir):
    counts = quality.error_counts(_errors(spark, sf_dir))
    long = counts.unpivot(["field", "total"], _KINDS, "error_type", "n").where("n > 0")
    return long.select("field", "error_type", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


@query("d31_field_by_error", "SELECT field, " + ", ".join(f"count(*) FILTER (e = '{k}') AS {k}" for k in _KINDS) + " FROM errors GROUP BY field", **BASE, errors=_ERRORS)
def _(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("field").pivot("error_type", _KINDS).count().na.fill(0, _KINDS)


@query("d35_component_means", "SELECT avg(religion_score) AS religion, avg(birthdate_year_score) AS birthdate_year, count(religion_score) AS n FROM scored", **SCORES)
def _(spark, sf_dir):
    return _scores(spark, sf_dir).agg(F.avg("religion_score").alias("religion"), F.avg("birthdate_year_score").alias("birthdate_year"), F.count("religion_score").alias("n"))


@query("f03_coverage_order", "SELECT method, field, pct FROM (" + " UNION ALL ".join(f"SELECT method, '{f}' AS field, count({f}) * 100.0 / count(*) AS pct FROM pred GROUP BY method" for f in FIELDS) + ") ORDER BY pct DESC, method, field", pred=PREDICTIONS)
def _(spark, sf_dir):
    return evaluate.coverage(predictions(spark, sf_dir), "method", FIELDS).select("method", "field", "pct").orderBy(F.desc("pct"), "method", "field")


@query("g03_tables_side_by_side", "SELECT field, avg(score) FILTER (method = 'icl') AS llm, avg(score) FILTER (method = 'regex') AS baseline FROM long GROUP BY field", **SCORES, long=LONG)
def _(spark, sf_dir):
    means = long_scores(_scores(spark, sf_dir)).where("method in ('icl', 'regex')").groupBy("field", "method").agg(F.avg("score").alias("mean"))
    side = lambda m, name: means.where(F.col("method") == m).select("field", F.col("mean").alias(name))
    return side("icl", "llm").join(side("regex", "baseline"), "field", "full")


@query("g04_id_difference", "SELECT entity_id FROM gt WHERE gender IS NOT NULL EXCEPT SELECT entity_id FROM pred WHERE gender IS NOT NULL", **BASE)
def _(spark, sf_dir):
    known = lambda frame: frame.where("gender is not null").select("entity_id")
    return known(truth(spark, sf_dir)).subtract(known(predictions(spark, sf_dir)))


@query("g08_known_per_row", "SELECT entity_id, method, " + " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in FIELDS) + " AS n_known, " + " + ".join(f"CAST({f} IS NULL AS INT)" for f in FIELDS) + " AS n_missing FROM pred", pred=PREDICTIONS)
def _(spark, sf_dir):
    n = evaluate.known_count(FIELDS)
    return predictions(spark, sf_dir).select("entity_id", "method", n.alias("n_known"), (F.lit(len(FIELDS)) - n).alias("n_missing"))


@query("g10_sorted_distinct", "SELECT entity_id, array_to_string(list_sort(list(DISTINCT religion)), '; ') AS religions FROM pred WHERE religion IS NOT NULL GROUP BY entity_id", pred=PREDICTIONS)
def _(spark, sf_dir):
    known = predictions(spark, sf_dir).where("religion is not null").groupBy("entity_id")
    return known.agg(F.array_join(F.array_sort(F.collect_set("religion")), "; ").alias("religions"))


@query("h07_styles_by_field", "SELECT method, " + ", ".join(f"avg({k}_score) AS {k}" for k in _PARTS) + " FROM scored WHERE method <> 'regex' GROUP BY method", **SCORES)
def _(spark, sf_dir):
    return long_scores(_scores(spark, sf_dir).where("method <> 'regex'")).groupBy("method").pivot("field", list(_PARTS)).agg(F.avg("score"))


@query("h13_detailed_comparison", "SELECT s.entity_id, s.method, j.gt_gender, j.pred_gender, gender_score, j.gt_birthdate, j.pred_birthdate, birthdate_year_score FROM scored s JOIN (" + _JOIN + ") j ON s.entity_id = j.entity_id AND s.method = j.method", **SCORES)
def _(spark, sf_dir):
    joined = _joined(spark, sf_dir)
    values = joined.select("entity_id", "method", "gt_gender", "pred_gender", "gt_birthdate", "pred_birthdate")
    return values.join(with_scores(joined).select("entity_id", "method", "gender_score", "birthdate_year_score"), ["entity_id", "method"])


@query("i22_two_digit_years", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 > 25 THEN 1900 ELSE 2000 END + o_orderkey % 100 AS year FROM orders")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return orders.select("o_orderkey", F.year(parse_date(F.concat(F.lit("3/15/"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")))).cast("long").alias("year"))


@query("j35_methods_evaluated", "SELECT field, method, avg(score) AS mean, count(score) AS n FROM long GROUP BY field, method HAVING count(score) > 0", **SCORES, long=LONG)
def _(spark, sf_dir):
    found = long_scores(_scores(spark, sf_dir)).where(F.col("method").isin(METHODS) & F.col("score").isNotNull())
    return found.groupBy("field", "method").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
