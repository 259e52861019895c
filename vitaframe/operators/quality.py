"""Error analysis and audits of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.scores import error_type, word_set_f1
from vitaframe.functions.text import is_missing


def field_errors(joined: DataFrame, fields: list[str]) -> DataFrame:
    """(entity_id, field, gt_value, pred_value, error_type, match_score), values cut to 100 characters."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"gt_{f}").cast("string").alias("gt"), F.col(f"pred_{f}").cast("string").alias("pred")) for f in fields))
    long = joined.select("entity_id", F.explode(rows).alias("r")).select("entity_id", "r.*")
    kind = error_type(F.col("pred"), F.col("gt"))
    score = F.when(kind == "correct", 1.0).otherwise(word_set_f1(F.col("pred"), F.col("gt")))
    return long.select("entity_id", "field", F.substring("gt", 1, 100).alias("gt_value"), F.substring("pred", 1, 100).alias("pred_value"), kind.alias("error_type"), score.alias("match_score"))


def error_counts(errors: DataFrame) -> DataFrame:
    """One row per field with a count for each kind, and the total."""
    kinds = ["missing_pred", "false_positive", "mismatch", "partial_match", "correct"]
    return errors.groupBy("field").agg(*(F.count_if(F.col("error_type") == k).alias(k) for k in kinds), F.count("*").alias("total"))


def missing_flags(frame: DataFrame, key: str, fields: list[str]) -> DataFrame:
    flags = [is_missing(F.col(f).cast("string")).alias(f"missing_{f}") for f in fields]
    total: Column = sum((is_missing(F.col(f).cast("string")).cast("int") for f in fields), F.lit(0))
    return frame.select(key, *flags, total.alias("missing_count"))


def missing_summary(flags: DataFrame) -> DataFrame:
    names = [c for c in flags.columns if c.startswith("missing_") and c != "missing_count"]
    long = flags.select(*(F.col(c).cast("int").alias(c) for c in names)).unpivot([], names, "field", "gone")
    out = long.groupBy(F.regexp_replace("field", "^missing_", "").alias("field")).agg(F.count("*").alias("n_total"), F.sum("gone").alias("n_missing"))
    return out.select("field", "n_total", "n_missing", (F.col("n_total") - F.col("n_missing")).alias("n_present"), (F.col("n_missing") * 100.0 / F.col("n_total")).alias("pct_missing"))


def missing_together(flags: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent combinations of missing fields."""
    names = [c for c in flags.columns if c.startswith("missing_") and c != "missing_count"]
    together = F.concat_ws("+", *(F.when(F.col(c), F.lit(c.removeprefix("missing_"))) for c in names))
    return flags.select(together.alias("fields")).groupBy("fields").count().orderBy(F.desc("count"), "fields").limit(top)


def confusion(labels: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return labels.groupBy(truth.alias("truth"), predicted.alias("predicted")).agg(F.count("*").alias("n"))
