"""Joining predictions with the truth, scoring, and tables of the results."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaframe.functions import tables as T
from vitaframe.functions.scores import SCORERS
from vitaframe.operators.fuzzy import fuzzy_matches


def prefixed(frame: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """All columns but the keys renamed, so that a join has no clashes."""
    return frame.select(*keys, *(F.col(c).alias(prefix + c) for c in frame.columns if c not in keys))


def join_truth(predictions: DataFrame, truth: DataFrame, key: str = "entity_id", how: str = "inner") -> DataFrame:
    """Predictions with pred_ columns (method stays) beside gt_ columns."""
    keys = [c for c in (key, "method") if c in predictions.columns]
    return prefixed(predictions, "pred_", keys).join(prefixed(truth, "gt_", [key]), key, how)


def first_truth(truth: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in the order given."""
    return truth.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def nearest(left: DataFrame, right: DataFrame, left_value: str, right_value: str, right_key: str) -> DataFrame:
    """Each left row with the right key whose value is nearest; ties to the smaller key, null for a null value or no right rows.

    The distinct values of both sides are sorted together by range, and each looks up and down its range;
    the ends of a range come from a table with one row a range. Repeated values meet once, so a frequent
    one makes no large range. Ranges are cut at approximate quantiles, which decide their sizes alone.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = left.select(F.col(left_value).cast("double").alias("_v")).where("_v is not null").distinct()
    offered = right.select(F.col(right_value).cast("double").alias("_v"), F.col(right_key).alias("_k")).where("_v is not null and _k is not null").groupBy("_v").agg(F.min("_k").alias("_k"))
    both = asked.withColumn("_asked", F.lit(True)).join(offered, "_v", "full")
    point = F.when(F.col("_k").isNotNull(), F.struct("_v", "_k"))
    cuts = asked.union(offered.select("_v")).approxQuantile("_v", [k / parts for k in range(1, parts)] or [0.5], 0.25 / parts)
    at = F.array_size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("_v")))
    both = both.select("_v", "_asked", point.alias("_p"), at.alias("_at"))
    here = Window.partitionBy("_at").orderBy("_v")
    ends = both.groupBy("_at").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))  # a row for each range
    over = Window.orderBy("_at")
    ends = ends.select(
        "_at",
        F.last("_last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    found = both.select(
        "_v", "_asked", "_at",
        F.last("_p", True).over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("_low"),
        F.first("_p", True).over(here.rowsBetween(0, Window.unboundedFollowing)).alias("_high"),
    ).where("_asked").join(F.broadcast(ends), "_at")
    sides = F.array(F.coalesce("_low", "_before"), F.coalesce("_high", "_after"))
    best = F.array_min(F.transform(F.filter(sides, lambda s: s.isNotNull()), lambda s: F.struct(F.abs(s["_v"] - F.col("_v")).alias("d"), s["_k"].alias("k"))))
    found = found.select("_v", best["k"].alias(right_key))
    return left.withColumn("_v", F.col(left_value).cast("double")).join(found, "_v", "left").drop("_v")


def join_truth_fuzzy(predictions: DataFrame, truth: DataFrame, key: str = "entity_id", name: str = "full_name", least: float = 85.0) -> DataFrame:
    """Exact join by key; truth rows without one join by their best-matching name."""
    exact = truth.join(predictions.select(key).distinct(), key, "left_semi")
    rest = truth.join(predictions.select(key).distinct(), key, "left_anti")
    names = fuzzy_matches(rest, predictions, name, least)
    by_name = rest.join(names, rest[name] == names["left_name"]).select(*(rest[c] for c in truth.columns), "right_name")
    p = prefixed(predictions, "pred_", ["method"]) if "method" in predictions.columns else prefixed(predictions, "pred_", [])
    fuzzy = prefixed(by_name, "gt_", [key, "right_name"]).join(p, F.col("right_name") == F.col(f"pred_{name}")).drop("right_name", f"pred_{key}")
    return join_truth(predictions, exact, key).unionByName(fuzzy, allowMissingColumns=True)


def count_truth_fuzzy(predictions: DataFrame, truth: DataFrame, key: str = "entity_id", name: str = "full_name", least: float = 85.0) -> DataFrame:
    """(method, gt_<name>, count) of the rows of join_truth_fuzzy. Rows that share a name are counted before names meet, so none of their pairs is made."""
    keys = predictions.select(key).distinct()
    gt = f"gt_{name}"
    exact = join_truth(predictions, truth.join(keys, key, "left_semi"), key).groupBy("method", gt).count()
    rest = truth.join(keys, key, "left_anti").where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_left"))
    offered = predictions.groupBy("method", name).agg(F.count("*").alias("_right")).withColumnRenamed(name, "right_name")
    names = fuzzy_matches(rest, offered.withColumnRenamed("right_name", name), name, least)
    pairs = rest.join(names, rest[name] == names["left_name"]).join(offered, "right_name")
    fuzzy = pairs.select("method", F.col(name).alias(gt), (F.col("_left") * F.col("_right")).alias("count"))
    return exact.unionByName(fuzzy).groupBy("method", gt).agg(F.sum("count").alias("count"))


def join_truth_or_names(predictions: DataFrame, truth: DataFrame, key: str = "entity_id", name: str = "full_name", least: float = 85.0) -> DataFrame:
    """Join by key; only if that finds nothing at all, by the best-matching names."""
    exact = join_truth(predictions, truth, key)
    return join_truth_fuzzy(predictions, truth, key, name, least) if exact.isEmpty() else exact


def fuzzy_lookup(frame: DataFrame, names: DataFrame, name: str, value: str, aliases: Mapping[str, str] | None = None, exclude: list[str] | None = None, least: float = 85.0) -> DataFrame:
    """frame with `value` of the best-matching name in names, or null. aliases stand in for names; excluded ones match nothing."""
    asked = F.col(name)
    if aliases:
        table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        asked = F.coalesce(F.get(F.array(table[F.col(name)]), F.lit(0)), asked)
    if exclude:
        asked = F.when(~F.col(name).isin(exclude), asked)
    asking = frame.withColumn("_asked", asked)
    found = fuzzy_matches(asking.select(F.col("_asked").alias(name)), names, name, least)
    values = names.groupBy(name).agg(F.min(value).alias(value)).select(F.col(name).alias("right_name"), value)
    best = found.join(values, "right_name").select(F.col("left_name").alias("_asked"), value)
    return asking.join(best, "_asked", "left").drop("_asked")


def corpus_text_score(joined: DataFrame, fields: Mapping[str, tuple[str, str, Callable[[Column], Column]]], scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """(field, score, n): mean over the rows with a truth. fields: (truth column, prediction column, how to read a prediction).

    A missing prediction is an empty one, and so scores 0.
    """
    parts = []
    for field, (truth, pred, parse) in fields.items():
        t = F.trim(F.coalesce(F.col(truth), F.lit("")))
        rows = joined.select(t.alias("t"), parse(F.coalesce(F.col(pred), F.lit(""))).alias("p")).where("t <> ''")
        parts.append(rows.agg(F.avg(F.coalesce(scorer(F.col("p"), F.col("t")), F.lit(0.0))).alias("score"), F.count("*").alias("n")).select(F.lit(field).alias("field"), "score", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")


def best_candidate_texts(pairs: DataFrame, keys: list[str], score: str, text: str) -> DataFrame:
    """The text of each key's best candidate, to hand to another scorer; a null score is the least, ties go to the smaller text."""
    best = F.min_by(F.col(text), F.struct(-F.coalesce(F.col(score), F.lit(-1.0)), F.col(text)))
    return pairs.groupBy(*keys).agg(best.alias(text))


def pivot_first(frame: DataFrame, row: str, column: str, value: str, columns: list[str], order: str) -> DataFrame:
    """One column for each of `columns` with the value of its first row by `order`."""
    return frame.groupBy(row).pivot(column, columns).agg(F.min_by(value, order))


def with_scores(joined: DataFrame, fields: Mapping[str, tuple[str, str]] | None = None, scorers: Mapping[str, Callable[[Column, Column], Column]] = SCORERS) -> DataFrame:
    """entity_id, method and one <field>_score for each field: {field: (prediction column, truth column)}."""
    fields = fields or {f: (f"pred_{f.removesuffix('_year')}", f"gt_{f.removesuffix('_year')}") for f in T.SCORE_FIELDS}
    return joined.select("entity_id", "method", *(scorers[f](F.col(p), F.col(t)).alias(f"{f}_score") for f, (p, t) in fields.items()))


def score_columns(scores: DataFrame) -> list[str]:
    return [c for c in scores.columns if c.endswith("_score")]


def long_scores(scores: DataFrame) -> DataFrame:
    """(entity_id, method, field, score)."""
    return scores.unpivot(["entity_id", "method"], score_columns(scores), "field", "score").withColumn("field", F.regexp_replace("field", "_score$", ""))


def summary_wide(scores: DataFrame, by: str = "method") -> DataFrame:
    """count, mean, min, max and sample deviation of every score column."""
    return scores.groupBy(by).agg(*(f(c).alias(f"{c}_{n}") for c in score_columns(scores) for n, f in (("count", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))))


def summary_long(scores: DataFrame) -> DataFrame:
    """method, field, mean, coverage_n and coverage_pct of the method's rows."""
    return long_scores(scores).groupBy("method", "field").agg(F.avg("score").alias("mean"), F.count("score").alias("coverage_n"), (F.count("score") * 100.0 / F.count("*")).alias("coverage_pct"))


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns that are not null."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def known_count(columns: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def ranking(scores: DataFrame) -> DataFrame:
    """rank, method, mean_score and std over the field means, n_fields and num_records."""
    means = scores.groupBy("method").agg(F.count("*").alias("num_records"), *(F.avg(c).alias(c) for c in score_columns(scores)))
    long = means.unpivot(["method", "num_records"], score_columns(scores), "field", "mean")
    out = long.groupBy("method", "num_records").agg(F.avg("mean").alias("mean_score"), F.stddev_samp("mean").alias("std"), F.count("mean").alias("n_fields"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_score"), "method")))  # one row a method


def best_per_field(summary: DataFrame) -> DataFrame:
    """field, method and mean of the best method; ties to the smaller name."""
    order = Window.partitionBy("field").orderBy(F.desc_nulls_last("mean"), "method")
    return summary.where("mean is not null").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("field", "method", "mean")


def delta_vs_best(summary: DataFrame, baselines: list[str]) -> DataFrame:
    """Difference of each baseline's mean to the best other method's, by field; the best method is chosen by its overall mean."""
    others = summary.where(~F.col("method").isin(baselines))
    best = others.groupBy("method").agg(F.avg("mean").alias("overall")).orderBy(F.desc("overall"), "method").limit(1).select(F.col("method").alias("best_method"))
    top = others.join(F.broadcast(best), others["method"] == best["best_method"]).select("field", "best_method", F.col("mean").alias("best_mean"))
    return summary.where(F.col("method").isin(baselines)).join(top, "field").select("field", "method", "best_method", (F.col("mean") - F.col("best_mean")).alias("delta"))


def coverage(frame: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, field, filled, total and pct."""
    long = frame.select(by, *(F.col(c).isNotNull().cast("int").alias(c) for c in columns)).unpivot([by], columns, "field", "filled")
    return long.groupBy(by, "field").agg(F.sum("filled").alias("filled"), F.count("*").alias("total"), (F.sum("filled") * 100.0 / F.count("*")).alias("pct"))


def consensus(predictions: DataFrame, firsts: list[str], modes: list[str], order: str = "method") -> DataFrame:
    """One row per entity: the first known value by method for some fields, the most frequent (smallest on ties) for others."""
    return predictions.groupBy("entity_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts), *(F.expr(f"mode() WITHIN GROUP (ORDER BY `{c}`)").alias(c) for c in modes))


def display_cells(summary: DataFrame, methods: list[str]) -> DataFrame:
    """field by method: '0.1234 (n=5)'."""
    cell = F.format_string("%.4f (n=%d)", "mean", "coverage_n")
    return summary.where("mean is not null").withColumn("cell", cell).groupBy("field").pivot("method", methods).agg(F.first("cell"))


def drop_empty_columns(frame: DataFrame) -> DataFrame:
    """Without the columns that are null in every row."""
    counts = frame.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in frame.columns)).first().asDict()
    return frame.select(*(f"`{c}`" for c in frame.columns if counts[c]))


def first_existing(frame: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in frame.columns), None)


def seeded_sample(frame: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """The k keys with the smallest digests of key and seed."""
    return frame.select(key).distinct().orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(k)
