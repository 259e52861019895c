"""Runs of the rule-based methods over texts: one record for each text and method, with errors as empty records."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions import tables as T
from vitaframe.functions.education import religion_of_text, serialize_committees, serialize_entries
from vitaframe.functions.text import let
from vitaframe.operators import extract
from vitaframe.operators.evaluate import coverage, join_truth, known_count

RECORD = ["full_name", "gender", "birthdate", "religion", "education", "committee_roles"]
_KINDS = {"full_name": "string", "gender": "string", "birthdate": "string", "religion": "string", "education": "array<struct<degree:string,institution:string,year:int>>", "committee_roles": "array<string>"}
Method = Callable[[Column, Column], Mapping[str, Column]]


def extract_via_regex(text: Column, entities: Column | None = None) -> dict[str, Column]:
    """Name, gender and birth date by patterns."""
    return {"full_name": extract.first_match(text, T.NAME), "gender": extract.gender_by_cues(text), "birthdate": extract.birthdate_in_text(text)}


def extract_via_keywords(text: Column, entities: Column | None = None, keywords: Mapping[str, list[str]] = T.KEYWORDS_FOUR) -> dict[str, Column]:
    """Name by pattern; religion, degrees and committees in the text, else what stands after a field's label."""
    label = lambda k: extract.labelled_value(text, keywords[k], header_too=True)
    or_label = lambda found, k, read: let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(let(label(k), lambda v: F.when(v.isNotNull(), F.array(read(v))))))
    return {
        "full_name": extract.first_match(text, T.NAME),
        "religion": F.coalesce(extract.religion_in_text(text), label("religion")),
        "education": or_label(extract.degrees_in_text(text), "education", extract.single_entry),
        "committee_roles": or_label(extract.committees_in_text(text), "committee_roles", lambda v: v),
    }


def extract_via_entities(text: Column, entities: Column) -> dict[str, Column]:
    """The first person, and what stands near organisations that a recogniser found."""
    organisations = F.transform(F.filter(entities, lambda e: e["label"] == "ORG"), lambda e: e["text"])
    return {
        "full_name": extract.entity_fields(entities)[0],
        "religion": religion_of_text(text, organisations),
        "education": extract.degrees_near_entities(text, organisations),
        "committee_roles": extract.committees_of(organisations),
    }


METHODS: dict[str, Method] = {"regex": extract_via_regex, "keyword": extract_via_keywords, "ner": extract_via_entities}


def _record(fields: Mapping[str, Column]) -> list[Column]:
    return [fields.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in _KINDS.items()]


def run_methods(texts: DataFrame, methods: Mapping[str, Method] = METHODS) -> DataFrame:
    """(entity_id, method, fields, extraction_error) for each text and method. texts: entity_id, text[, entities].

    A text that is missing or blank gives empty records with an error, and stops nothing else.
    """
    if "entities" not in texts.columns:
        texts = texts.withColumn("entities", F.lit(None).cast("array<struct<text:string,label:string>>"))
    bad = F.col("text").isNull() | (F.trim("text") == "")
    out = None
    for name, method in methods.items():
        cells = [F.when(~bad, c).alias(k) for k, c in zip(RECORD, _record(method(F.col("text"), F.coalesce("entities", F.array().cast("array<struct<text:string,label:string>>")))), strict=True)]
        rows = texts.select("entity_id", F.lit(name).alias("method"), *cells, F.when(bad, "no text").alias("extraction_error"))
        out = rows if out is None else out.unionByName(rows)
    return out


def run_wide(texts: DataFrame, methods: Mapping[str, Method] = METHODS) -> DataFrame:
    """One row for each text, with a column <method>_<field> for each field that the method finds."""
    if "entities" not in texts.columns:
        texts = texts.withColumn("entities", F.array().cast("array<struct<text:string,label:string>>"))
    cells = [c.cast(_KINDS[k]).alias(f"{name}_{k}") for name, method in methods.items() for k, c in method(F.col("text"), F.col("entities")).items()]
    return texts.select("entity_id", *cells)


def flat(records: DataFrame) -> DataFrame:
    """The records with lists as text."""
    return records.withColumns({"education": F.when(F.size("education") > 0, serialize_entries(F.col("education"))), "committee_roles": serialize_committees(F.col("committee_roles"))})


def run_with_truth(texts: DataFrame, truth: DataFrame, methods: Mapping[str, Method] = METHODS) -> DataFrame:
    """Flat records of all methods beside their truth, where there is one."""
    return join_truth(flat(run_methods(texts, methods)), truth, how="left")


def run_predictions_only(texts: DataFrame, methods: Mapping[str, Method] = METHODS) -> tuple[DataFrame, DataFrame]:
    """Flat records, and their coverage by method."""
    records = flat(run_methods(texts, methods))
    return records, coverage(records, "method", RECORD)


def quick_evaluation(texts: DataFrame, entity_id: object, methods: Mapping[str, Method] = METHODS) -> DataFrame:
    """What each method finds for one entity, with the number of fields found."""
    return flat(run_methods(texts.where(F.col("entity_id") == F.lit(entity_id)), methods)).withColumn("n_found", known_count(RECORD))


def coverage_counts(wide: DataFrame) -> DataFrame:
    """(method, field, found, average): texts with a value, and the mean length of lists."""
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    cells = []
    for c in (x for x in wide.columns if x != "entity_id"):
        method, field = c.split("_", 1)
        is_list = kinds[c].startswith("array")
        found = F.count_if(F.size(c) > 0) if is_list else F.count(c)
        average = F.avg(F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("double")) if is_list else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(method).alias("method"), F.lit(field).alias("field"), found.alias("found"), average.alias("average")))
    return wide.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def coverage_text(counts: DataFrame) -> str:
    """The counts as lines to print; a few rows."""
    rows = sorted(counts.collect(), key=lambda r: (r.method, r.field))
    return "\n".join(f"{r.method:<8} {r.field:<16} {r.found:>8}" + (f"  {r.average:.2f} each" if r.average is not None else "") for r in rows)
