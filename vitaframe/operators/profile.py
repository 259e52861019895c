"""Whole-record operators: standardising, row scores, accuracy of baselines, evaluation with kept results, audits of fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions import dates, education, scores, text
from vitaframe.functions import tables as T
from vitaframe.functions.udfs import ratio_udf
from vitaframe.operators import evaluate
from vitaframe.sources.writers import kept_or_computed


def _standard_education(c: Column) -> Column:
    """Entries from a JSON or printed list of records, or from |-parts of free text; none gives null."""
    trimmed = F.trim(c)
    listed = F.transform(F.from_json(education.repr_to_json(c), f"array<{education.ENTRY}>", {"allowSingleQuotes": "true"}), lambda e: education.standardize_entry(e["degree"], e["institution"], e["year"]))
    parts = F.filter(F.transform(F.split(trimmed, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    found = F.when(F.startswith(trimmed, F.lit("[")), listed).otherwise(F.transform(parts, education.entry_from_text))
    found = F.filter(found, lambda e: e.isNotNull())
    return F.when(F.size(found) > 0, found)


#: field: (candidate columns, standardiser, validator)
_STANDARD: dict[str, tuple[list[str], Callable[[Column], Column], Callable[[Column], Column]]] = {
    "full_name": (["full_name", "name"], text.standardize_full_name, text.valid_full_name),
    "gender": (["gender"], text.standardize_gender, lambda c: text.valid_in(c, ["Male", "Female"])),
    "race_ethnicity": (["race_ethnicity", "ethnicity"], text.standardize_ethnicity, lambda c: text.valid_in(c, T.VALID_ETHNICITIES)),
    "birthdate": (["birthdate"], dates.standardize_birthdate, dates.valid_birthdate),
    "education": (["education"], _standard_education, education.valid_education),
    "religion": (["religion", "religious_affiliation"], text.standardize_religion, lambda c: text.valid_in(c, T.VALID_RELIGIONS)),
    "committee_roles": (["committee_roles", "committees"], text.standardize_roles, lambda c: F.coalesce(F.forall(c, lambda r: F.length(r) > 0), F.lit(False))),
}


def standardize_records(frame: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, each field present in standard form, and `_validation` with <field>_valid."""
    out, flags, names = [], [], {}
    for name, (candidates, standard, valid) in _STANDARD.items():
        present = [c for c in candidates if c in frame.columns]
        if present:
            value = standard(F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in present)))
            names[f"std_{name}"] = name  # a plain alias would be seen by the other fields' expressions
            out.append(value.alias(f"std_{name}"))
            flags.append(valid(value).alias(f"{name}_valid"))
    return frame.select(*keep, *out, F.struct(*flags).alias("_validation")).withColumnsRenamed(names)


def education_alignment(frame: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """keys, degree, institution, year, combined, n_gt: as education_components, with institutions also equal above a ratio of 0.8.

    The ratio is computed only for pairs that no cheaper test settles. Rows without entries on a side are left out.
    """
    pairs = frame.select(*keys, F.posexplode(F.transform(truth, scores._comparable)).alias("ti", "t"), F.transform(pred, scores._comparable).alias("ps")).select(*keys, "ti", "t", F.posexplode("ps").alias("pi", "p"))
    a, b = F.col("t.institution"), F.col("p.institution")
    open_ = (a != "") & (b != "") & (a != b) & ~F.contains(a, b) & ~F.contains(b, a)
    pairs = pairs.withColumn("near", F.coalesce(ratio_udf(F.when(open_, a), F.when(open_, b)) > 0.8, F.lit(False)))
    scored = pairs.select(*keys, "ti", "pi", scores.pair_scores(F.col("p"), F.col("t"), F.col("near")).alias("s"))
    best = scored.groupBy(*keys, "ti").agg(F.max(F.struct(F.col("s.rank").alias("rank"), (-F.col("pi")).alias("first"), F.col("s").alias("s"))).alias("b"))
    mean = lambda c: F.avg(F.coalesce(F.col(f"b.s.{c}"), F.lit(0.0))).alias(c)
    return best.groupBy(*keys).agg(mean("degree"), mean("institution"), mean("year"), F.avg(F.greatest(F.col("b.rank"), F.lit(0.0))).alias("combined"), F.count("*").alias("n_gt"))


def row_scores(joined: DataFrame) -> DataFrame:
    """Scores of every field, the education components, the mean of what is scored and how many fields were predicted."""
    base = evaluate.with_scores(joined)
    parts = joined.select("entity_id", "method", scores.education_components(education.parse_education(F.col("pred_education")), education.parse_education(F.col("gt_education"))).alias("e"), evaluate.known_count([c for c in joined.columns if c.startswith("pred_")]).alias("attributes_with_predictions"))
    out = base.join(parts, ["entity_id", "method"])
    out = out.select(*base.columns, *(F.col(f"e.{k}").alias(f"education_{k}_score") for k in ("degree", "institution", "year")), "attributes_with_predictions")
    return out.withColumn("overall_match_score", evaluate.row_mean([c for c in out.columns if c.endswith("_score")]))


def baseline_accuracy(joined: DataFrame) -> DataFrame:
    """(entity_id, method, field, accuracy, value_gt, value_extracted): names exactly, education by words and by number of entries; rows with truth only."""
    n = lambda side: F.size(education.parse_education(F.col(f"{side}_education")))
    rows = F.array(
        F.struct(F.lit("name").alias("field"), scores.exact_strict(F.col("pred_full_name"), F.col("gt_full_name")).alias("accuracy"), F.col("gt_full_name").alias("value_gt"), F.col("pred_full_name").alias("value_extracted")),
        F.struct(F.lit("education").alias("field"), F.when(F.col("gt_education").isNotNull(), F.coalesce(scores.unigram_f1(F.col("pred_education"), F.col("gt_education")), F.lit(0.0))).alias("accuracy"), F.substring("gt_education", 1, 100).alias("value_gt"), F.substring("pred_education", 1, 100).alias("value_extracted")),
        F.struct(F.lit("education_entries").alias("field"), F.when(F.col("gt_education").isNotNull(), scores.entry_count(n("pred"), n("gt"))).alias("accuracy"), n("gt").cast("string").alias("value_gt"), n("pred").cast("string").alias("value_extracted")),
    )
    long = joined.select("entity_id", "method", F.explode(rows).alias("r")).select("entity_id", "method", "r.*").where("accuracy is not null")
    return long.withColumn("value_extracted", F.coalesce("value_extracted", F.lit("Not extracted")))


def baseline_summary(accuracy: DataFrame, fields: list[str]) -> DataFrame:
    """Methods by fields: mean accuracy."""
    return accuracy.groupBy("method").pivot("field", fields).agg(F.avg("accuracy"))


def evaluate_methods(predictions: DataFrame, truth: DataFrame, store: str | None = None, overwrite: bool = False) -> DataFrame:
    """Mean, coverage and counts of every field and method in one pass; kept at `store`, if given."""

    def compute() -> DataFrame:
        joined = evaluate.join_truth(predictions, truth)
        counts = joined.groupBy("method").agg(F.count("*").alias("record_count"), *(F.count(f"{side}_{f}").alias(f"{f}_{n}") for f in ("gender", "religion", "education") for side, n in (("gt", "n_gt"), ("pred", "n_pred"))))
        return evaluate.summary_long(evaluate.with_scores(joined)).join(counts, "method")

    return kept_or_computed(predictions.sparkSession, store, compute, overwrite) if store else compute()


def fill_rate(predictions: DataFrame, columns: list[str]) -> DataFrame:
    """Share of all cells that are filled, by method."""
    filled = sum((F.count(c) for c in columns), F.lit(0))
    return predictions.groupBy("method").agg((filled * 100.0 / (F.count("*") * len(columns))).alias("fill_pct"))


def coverage_tier(pct: Column) -> Column:
    return F.when(pct >= 70, "high").when(pct >= 30, "medium").otherwise("low")


def year_failures(joined: DataFrame) -> DataFrame:
    """match, wrong or missing by the first entries' years, of rows whose truth has one."""
    first = lambda side: F.get(education.parse_education(F.col(f"{side}_education")), F.lit(0))["year"]
    t, p = first("gt"), first("pred")
    kind = F.when(p.isNull(), "missing").when(p == t, "match").otherwise("wrong")
    return joined.where(t.isNotNull()).select("method", kind.alias("outcome")).groupBy("method", "outcome").agg(F.count("*").alias("n"))


def degree_details(joined: DataFrame) -> DataFrame:
    """Normalised first degrees of both sides and whether they match."""
    first = lambda side: education.normalize_degree(F.get(education.parse_education(F.col(f"{side}_education")), F.lit(0))["degree"])
    return joined.select("entity_id", "method", first("gt").alias("gt_degree"), first("pred").alias("pred_degree"), (first("gt") == first("pred")).alias("match"))


def first_entries_score(pred: Column, truth: Column) -> Column:
    """Mean of degree, institution and year equality of the first entries, zeros included; no truth: null."""
    p, t = F.get(education.parse_education(pred), F.lit(0)), F.get(education.parse_education(truth), F.lit(0))
    same = lambda f, k: F.coalesce((f(p[k]) == f(t[k])).cast("double"), F.lit(0.0))
    plain = lambda c: F.trim(c)
    return F.when(t.isNotNull(), (same(education.normalize_degree, "degree") + same(education.normalize_school, "institution") + same(plain, "year")) / 3)


def clean_truth(truth: DataFrame) -> DataFrame:
    """Committee roles cleaned, with their lengths before and after."""
    cleaned = text.clean_roles(F.col("committee_roles"))
    return truth.select("entity_id", cleaned.alias("committee_roles"), F.length("committee_roles").alias("before"), F.length(cleaned).alias("after"))


def score_ranges(score_table: DataFrame) -> DataFrame:
    """Per score column: lowest, highest, and whether all lie in [0, 1]."""
    long = evaluate.long_scores(score_table)
    return long.groupBy("field").agg(F.min("score").alias("low"), F.max("score").alias("high"), (F.coalesce(F.min("score"), F.lit(0.0)) >= 0).alias("from_zero"), (F.coalesce(F.max("score"), F.lit(0.0)) <= 1).alias("to_one"))


def religion_signal(text_: Column) -> Column:
    """Our own rule: 'explicit' where a religion word stands in the text, else 'not_explicit'."""
    return F.when(F.lower(text_).rlike(r"\b(" + "|".join(T.RELIGION_WORDS) + r")\b"), "explicit").otherwise("not_explicit")
