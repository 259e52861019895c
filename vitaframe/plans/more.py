"""Further queries: variants of joins, aggregates, orders, sets, reshapes and extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaframe.functions import scores, udfs
from vitaframe.functions import tables as T
from vitaframe.functions.education import normalize_degree, parse_education, repr_to_json
from vitaframe.functions.text import dedupe_ignoring_case, readable_text
from vitaframe.operators import evaluate, extract, quality, robustness
from vitaframe.operators.evaluate import join_truth, long_scores, summary_long, with_scores
from vitaframe.plans.inputs import BIOGRAPHIES, METHODS, PREDICTIONS, TRUTH, biographies, portable, predictions, truth, with_inputs
from vitaframe.plans.relational import _ENT, _JOIN, _PARTS, BASE, LONG, SCORES, SUMMARY, _entities, _score_sql, table
from vitaframe.streaming.resume import pending

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


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(_joined(spark, sf_dir))


@query("a06_first_column_as_key", "SELECT s_suppkey AS entity_id, s_name FROM supplier")
def _(spark, sf_dir):
    frame = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return frame.withColumnRenamed(frame.columns[0], "entity_id") if "entity_id" not in frame.columns else frame


@query("a15_json_summary", "SELECT field, mean, coverage_n FROM (" + SUMMARY + ") WHERE method = 'direct'", **SCORES, long=LONG)
def _(spark, sf_dir):
    shape = "struct<field:string,mean:double,coverage_n:bigint>"
    return summary_long(_scores(spark, sf_dir)).where("method = 'direct'").select(F.from_json(F.to_json(F.struct("field", "mean", "coverage_n")), shape).alias("j")).select("j.*")


@query("b08_contains_filter", "SELECT doc_id FROM documents WHERE contains(text, 'the') AND NOT contains(text, '%%%')")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")) & ~F.contains("text", F.lit("%%%"))).select("doc_id")


@query("b10_first_existing_column", "SELECT entity_id, religion AS value FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    frame = truth(spark, sf_dir)
    return frame.select("entity_id", F.col(evaluate.first_existing(frame, ["religious_affiliation", "religion"])).alias("value"))


@query("b13_derived_columns", "SELECT event_id, value > 50 AS high, CASE WHEN value > 75 THEN 'top' WHEN value > 25 THEN 'mid' ELSE 'low' END AS tier FROM events")
def _(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (v > 50).alias("high"), F.when(v > 75, "top").when(v > 25, "mid").otherwise("low").alias("tier"))


@query("b18_type_histogram", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN committee_roles IS NULL THEN 'null' WHEN starts_with(committee_roles, '[') THEN 'list' ELSE 'text' END AS kind FROM pred) GROUP BY kind", pred=PREDICTIONS)
def _(spark, sf_dir):
    c = F.col("committee_roles")
    return predictions(spark, sf_dir).select(F.when(c.isNull(), "null").when(F.startswith(c, F.lit("[")), "list").otherwise("text").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("c05_attach_scores", f"SELECT entity_id, method, pred_gender, gender_score FROM ({_JOIN}) LEFT JOIN (SELECT entity_id, method, gender_score FROM scored WHERE entity_id % 3 = 0) USING (entity_id, method)", **SCORES)
def _(spark, sf_dir):
    some = _scores(spark, sf_dir).where("entity_id % 3 = 0").select("entity_id", "method", "gender_score")
    return _joined(spark, sf_dir).select("entity_id", "method", "pred_gender").join(some, ["entity_id", "method"], "left")


@query("c06_coverage_join", "SELECT avg(CASE WHEN a.gender IS NULL THEN 0 ELSE 1 END) AS llm, avg(CASE WHEN b.gender IS NULL THEN 0 ELSE 1 END) AS baseline, count(*) AS n FROM pred a JOIN pred b ON a.entity_id = b.entity_id WHERE a.method = 'direct' AND b.method = 'regex'", pred=PREDICTIONS)
def _(spark, sf_dir):
    p = predictions(spark, sf_dir)
    known = lambda m, n: p.where(F.col("method") == m).select("entity_id", F.col("gender").isNotNull().cast("int").alias(n))
    return known("direct", "a").join(known("regex", "b"), "entity_id").agg(F.avg("a").alias("llm"), F.avg("b").alias("baseline"), F.count("*").alias("n"))


@query("c11_attribute_lookup", "SELECT pred.entity_id, method, gt.gender FROM pred LEFT JOIN (SELECT * FROM gt WHERE entity_id % 2 = 0) gt ON pred.entity_id = gt.entity_id", **BASE)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).select("entity_id", "method").join(truth(spark, sf_dir).where("entity_id % 2 = 0").select("entity_id", "gender"), "entity_id", "left")


@query("c14_pending_conditions", "SELECT entity_id, method FROM pred WHERE NOT (entity_id % 2 = 0 AND method = 'icl')", pred=PREDICTIONS)
def _(spark, sf_dir):
    tasks = predictions(spark, sf_dir).select("entity_id", "method")
    return pending(tasks, tasks.where("entity_id % 2 = 0 and method = 'icl'"), ["entity_id", "method"])


@query("c17_best_alignment", "SELECT a.c_custkey, b.s_suppkey FROM customer a, LATERAL (SELECT s_suppkey FROM supplier ORDER BY abs(s_acctbal - a.c_acctbal), s_suppkey LIMIT 1) b")
def _(spark, sf_dir):
    found = evaluate.nearest(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_acctbal", "s_acctbal", "s_suppkey")
    return found.select("c_custkey", "s_suppkey")


@query("d05_mean_of_means", f"SELECT method, avg(mean) AS overall FROM ({SUMMARY}) GROUP BY method", **SCORES, long=LONG)
def _(spark, sf_dir):
    means = _scores(spark, sf_dir).groupBy("method").agg(*(F.avg(f"{k}_score").alias(f"{k}_score") for k in _PARTS))
    return means.select("method", evaluate.row_mean([f"{k}_score" for k in _PARTS]).alias("overall"))


@query("d10_ranges", "SELECT least(min(c_acctbal), min(c_custkey)) AS low, greatest(max(c_acctbal), max(c_custkey)) AS high FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.least(F.min("c_acctbal"), F.min("c_custkey")).alias("low"), F.greatest(F.max("c_acctbal"), F.max("c_custkey")).alias("high"))


@query("d19_coverage_mean", "SELECT method, avg(CASE WHEN religion IS NULL THEN 0 ELSE 1 END) AS religion, avg(CASE WHEN birthdate IS NULL THEN 0 ELSE 1 END) AS birthdate FROM pred GROUP BY method", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("method").agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in ("religion", "birthdate")))


@query("d22_average_coverage", "SELECT method, avg(pct) AS average FROM (" + " UNION ALL ".join(f"SELECT method, count({f}) * 100.0 / count(*) AS pct FROM pred WHERE entity_id % 13 <> 0 GROUP BY method" for f in ("gender", "religion", "education")) + ") GROUP BY method", pred=PREDICTIONS)
def _(spark, sf_dir):
    return evaluate.coverage(predictions(spark, sf_dir).where("entity_id % 13 <> 0"), "method", ["gender", "religion", "education"]).groupBy("method").agg(F.avg("pct").alias("average"))


@query("d26_entities_with_missing", "SELECT count(*) FILTER (n > 0) AS any_missing, count(*) FILTER (n = 2) AS all_missing FROM (SELECT CAST(gender IS NULL AS INT) + CAST(religion IS NULL OR religion = '' AS INT) AS n FROM gt)", gt=TRUTH)
def _(spark, sf_dir):
    flags = quality.missing_flags(truth(spark, sf_dir), "entity_id", ["gender", "religion"])
    return flags.agg(F.count_if(F.col("missing_count") > 0).alias("any_missing"), F.count_if(F.col("missing_count") == 2).alias("all_missing"))


@query("d27_distinct_count", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("d30_errors_per_entity", "SELECT entity_id, count(*) AS n FROM long WHERE score < 1 OR score IS NULL GROUP BY entity_id", **SCORES, long=LONG)
def _(spark, sf_dir):
    return long_scores(_scores(spark, sf_dir)).where("score < 1 or score is null").groupBy("entity_id").agg(F.count("*").alias("n"))


@query("d32_list_totals", "SELECT CASE WHEN education IS NULL OR education = '' THEN 'none' ELSE 'found' END AS status, count(*) AS n, CAST(sum(CASE WHEN education IS NULL OR education = '' THEN 0 ELSE len(string_split(education, '|')) // 3 END) AS BIGINT) AS entries FROM gt GROUP BY 1", gt=TRUTH)
def _(spark, sf_dir):
    n = F.size(parse_education(F.col("education")))
    return truth(spark, sf_dir).select(F.when(n == 0, "none").otherwise("found").alias("status"), n.alias("k")).groupBy("status").agg(F.count("*").alias("n"), F.sum("k").alias("entries"))


@query("d34_education_entries", "SELECT count(*) AS n, count(DISTINCT entity_id) AS entities FROM (SELECT entity_id, unnest(range(0, len(string_split(education, '|')) // 3)) AS i FROM gt WHERE education <> '')", gt=TRUTH)
def _(spark, sf_dir):
    return truth(spark, sf_dir).select("entity_id", F.explode(parse_education(F.col("education")))).agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))


@query("d36_corpus_mean", "SELECT method, avg(committee_roles_score) AS mean, count(committee_roles_score) AS n FROM scored GROUP BY method", **SCORES)
def _(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("method").agg(F.avg("committee_roles_score").alias("mean"), F.count("committee_roles_score").alias("n"))


@query("e02_best_overall", f"SELECT method, avg(mean) AS overall FROM ({SUMMARY}) GROUP BY method ORDER BY overall DESC, method LIMIT 1", **SCORES, long=LONG)
def _(spark, sf_dir):
    return summary_long(_scores(spark, sf_dir)).groupBy("method").agg(F.avg("mean").alias("overall")).orderBy(F.desc("overall"), "method").limit(1)


@query("e04_best_candidate", "SELECT entity_id, method, gender_score FROM (SELECT entity_id, method, gender_score, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(gender_score, -1) DESC, method) AS nth FROM scored) WHERE nth = 1", **SCORES)
def _(spark, sf_dir):
    order = Window.partitionBy("entity_id").orderBy(F.desc(F.coalesce("gender_score", F.lit(-1.0))), "method")
    return _scores(spark, sf_dir).select("entity_id", "method", "gender_score", F.row_number().over(order).alias("nth")).where("nth = 1").drop("nth")


@query("f04_fixed_order", "SELECT event_type, n, CAST(row_number() OVER (ORDER BY list_position(['purchase', 'view', 'click'], event_type) NULLS LAST, event_type) AS INT) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def _(spark, sf_dir):
    place = F.array_position(F.array(F.lit("purchase"), F.lit("view"), F.lit("click")), F.col("event_type"))
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.when(place > 0, place).asc_nulls_last(), "event_type")))


@query("f05_first_of_list", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS head FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("head"))


@query("g05_set_sizes", "SELECT o_custkey, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS together FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS a, ['F', 'X'] AS b FROM orders GROUP BY o_custkey)")
def _(spark, sf_dir):
    b = F.array(F.lit("F"), F.lit("X"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a")).select("o_custkey", F.size(F.array_intersect("a", b)).cast("long").alias("common"), F.size(F.array_union("a", b)).cast("long").alias("together"))


@query("g06_dedupe_ignoring_case", "SELECT entity_id, CASE WHEN religion IS NULL THEN '' WHEN lower(religion) = 'x' THEN 'x' ELSE 'x|' || religion END AS items FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    items = F.filter(F.array(F.lit("x"), "religion", F.upper("religion"), F.lit("X")), lambda x: x.isNotNull())
    return truth(spark, sf_dir).select("entity_id", F.when(F.col("religion").isNull(), "").otherwise(F.array_join(dedupe_ignoring_case(items), "|")).alias("items"))


@query("h02_styles_with_errors", "SELECT entity_id, method, CASE WHEN entity_id % 5 <> 0 THEN gender END AS gender, CASE WHEN entity_id % 5 = 0 THEN 'bad' END AS extraction_error FROM pred", pred=PREDICTIONS)
def _(spark, sf_dir):
    record = F.struct(F.when(F.col("entity_id") % 5 == 0, "bad").alias("error"), "gender")
    nested = predictions(spark, sf_dir).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("method", record))).alias("s"))
    return nested.select("entity_id", F.explode("s").alias("method", "r")).select("entity_id", "method", F.when(F.col("r.error").isNull(), F.col("r.gender")).alias("gender"), F.col("r.error").alias("extraction_error"))


@query("h03_pivot_rates", "SELECT o_orderstatus, " + ", ".join(f"avg(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH")) + " FROM orders GROUP BY o_orderstatus")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("r", (F.col("o_totalprice") > 100000).cast("int")).groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).agg(F.avg("r"))


@query("h11_methods_as_rows", "SELECT method, " + ", ".join(f"avg({k}_score) AS {k}" for k in _PARTS) + " FROM scored GROUP BY method", **SCORES)
def _(spark, sf_dir):
    return long_scores(_scores(spark, sf_dir)).groupBy("method").pivot("field", list(_PARTS)).agg(F.avg("score"))


@query("h14_side_by_side", "SELECT entity_id, method, pred_full_name, gt_full_name, pred_birthdate, gt_birthdate FROM (" + _JOIN + ") WHERE method IN ('direct', 'regex')", **BASE)
def _(spark, sf_dir):
    return _joined(spark, sf_dir).where(F.col("method").isin(METHODS[0], METHODS[3])).select("entity_id", "method", "pred_full_name", "gt_full_name", "pred_birthdate", "gt_birthdate")


@query("i40_repr_to_json", "SELECT entity_id, '[{''degree'': null, ''institution'': ''' || full_name || '''}]' AS j FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    return truth(spark, sf_dir).select("entity_id", repr_to_json(F.concat(F.lit("[{'degree': None, 'institution': '"), "full_name", F.lit("'}]"))).alias("j"))


@query("i46_prepared_education")
def _(spark, sf_dir):
    entries = F.transform(parse_education(F.col("education")), lambda e: F.struct(normalize_degree(e["degree"]).alias("degree"), F.lower(e["institution"]).alias("institution")))
    return predictions(spark, sf_dir).select("entity_id", "method", F.to_json(entries).alias("education"))


@query("i47_key_synonyms", "SELECT entity_id, coalesce(a, b, c) AS degree FROM (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN 'BA' END AS a, CASE WHEN entity_id % 3 = 1 THEN 'MA' END AS b, CASE WHEN entity_id % 3 = 2 THEN 'JD' END AS c FROM gt)", gt=TRUTH)
def _(spark, sf_dir):
    raw = F.when(F.col("entity_id") % 3 == 0, '{"degree": "BA"}').when(F.col("entity_id") % 3 == 1, '{"degree_type": "MA"}').otherwise('{"type": "JD"}')
    return truth(spark, sf_dir).select("entity_id", F.from_json(raw, "map<string,string>").alias("m")).select("entity_id", F.coalesce("m.degree", "m.degree_type", "m.type").alias("degree"))


@query("i56_truncated_text")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(readable_text(F.col("html"), 10_000)).alias("n"))


@query("i65_pattern_counts", "SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS emails, len(regexp_extract_all(text, '(?:\\+\\d+\\s?)?(?:\\d{3}[\\-\\s]?\\d{3,}[\\-\\s]?\\d{4})')) AS phones FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(T.EMAIL)).cast("long").alias("emails"), F.regexp_count("text", F.lit(T.PHONE)).cast("long").alias("phones"))


@query(
    "j19_two_committee_scores",
    "SELECT entity_id, method, " + ", ".join(f"(SELECT {_score_sql(q)} FROM (SELECT pred_committee_roles AS p, gt_committee_roles AS t)) AS {n}" for q, n in (("j18_committee_score", "with_sets"), ("j13_flattened_f1", "words_only"))) + f" FROM ({_JOIN})",
    **BASE,
)
def _(spark, sf_dir):
    """The score of model answers beside the one of baselines, which differ wherever the sets of roles do."""
    pred, gt = F.col("pred_committee_roles"), F.col("gt_committee_roles")
    return _joined(spark, sf_dir).select("entity_id", "method", scores.committee_score(pred, gt).alias("with_sets"), scores.flattened_f1(pred, gt).alias("words_only"))


@query("k09_header_label", "SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN 'School ' || id WHEN 1 THEN 'Own ' || id WHEN 2 THEN 'After ' || id END AS value FROM (SELECT entity_id, CAST(entity_id AS STRING) AS id FROM bio)", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    """A header line with its value below, a label with its own, a label with its value below, and neither."""
    text = F.expr(r"CASE entity_id % 4 WHEN 0 THEN 'Intro\nEducation and career\n\nSchool ' || entity_id || '\nx' WHEN 1 THEN 'Intro\n education : Own ' || entity_id || '\nNext' WHEN 2 THEN 'education:\n \n\nAfter ' || entity_id ELSE 'An education ' || entity_id || '\nNext' END")
    return biographies(spark, sf_dir).select("entity_id", extract.labelled_value(text, ["education"], header_too=True).alias("value"))


@query("k10_dispatch")
def _(spark, sf_dir):
    is_html = F.col("html").rlike(r"<[a-zA-Z][\s\S]*?>")
    return table(spark, sf_dir, "pages").select("page_id", F.when(is_html, readable_text(F.col("html"))).otherwise(F.col("html")).alias("text"), is_html.alias("is_html"))


_ROLE_TEXTS = f"SELECT entity_id, replace(text, 'the member is a Member of', CASE entity_id % 4 WHEN 0 THEN 'they are Chair of' WHEN 1 THEN 'they are Ranking Member of' WHEN 2 THEN 'they are a MEMBER of' ELSE 'they sit on' END) AS text FROM ({BIOGRAPHIES}) b"


@query(
    "k18_roles_near",
    "SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN 'Chair' WHEN 1 THEN 'Ranking Member' WHEN 2 THEN 'MEMBER' ELSE 'Member' END || ' of Finance Committee' || CASE WHEN entity_id % 2 = 0 THEN '|' || CASE entity_id % 4 WHEN 0 THEN 'Chair' ELSE 'MEMBER' END || ' of Budget Committee' ELSE '|Budget Committee' END AS roles FROM role_texts",
    role_texts=_ROLE_TEXTS,
)
def _(spark, sf_dir):
    """The first role word around each committee; a committee that the text doesn't name stands alone."""
    roles = extract.roles_near(F.col("text"), F.array(F.lit("Finance Committee"), F.lit("Elm"), F.lit("Budget Committee")))
    return portable(spark, sf_dir, _ROLE_TEXTS).select("entity_id", F.array_join(roles, "|").alias("roles"))


@query("k23_entity_buckets", f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(entities, lambda e: e.label = 'PERSON'), lambda e: e.text)))[1:5], '|'), '') AS persons FROM ({_ENT})")
def _(spark, sf_dir):
    return _entities(spark, sf_dir).select("doc_id", F.array_join(F.slice(extract.of_label(F.col("entities"), "PERSON"), 1, 5), "|").alias("persons"))


@query("k25_religion_of_entities", "SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'christian' ELSE CASE entity_id % 7 WHEN 0 THEN 'christian' WHEN 1 THEN 'jewish' WHEN 2 THEN 'orthodox' END END AS religion FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    name = F.when(F.col("entity_id") % 2 == 0, "First Baptist Church").otherwise("Oak University")
    entities = F.array(F.struct(name.alias("text"), F.lit("ORG").alias("label")))
    return biographies(spark, sf_dir).select("entity_id", extract.religion_of_entities(F.col("text"), entities, entities_first=True).alias("religion"))


@query("k31_infobox_row")
def _(spark, sf_dir):
    box = F.concat(F.lit("<table><tr><th>Alma mater</th><td>"), F.substring("url", 1, 20), F.lit("<br>Elm</td></tr></table>"), "html")

    def alma_mater(html):
        return udfs.infobox_row(html, "alma mater")

    return table(spark, sf_dir, "pages").select("page_id", udfs.html_udf(alma_mater)(box).alias("education"))


@query(
    "k34_degree_lists",
    "SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN 'BA/Oak College|MA/Oak College|JD/Elm ' || CAST(entity_id AS STRING) WHEN 1 THEN 'PhD/School ' || CAST(entity_id AS STRING) WHEN 2 THEN '' ELSE 'BS/A|MD/B' END AS entries FROM bio",
    bio=BIOGRAPHIES,
)
def _(spark, sf_dir):
    text = F.expr("CASE entity_id % 4 WHEN 0 THEN 'Oak College (B.A., M.A.); Elm ' || entity_id || ' (J.D.)' WHEN 1 THEN 'School ' || entity_id || ' ( Ph.D. )' WHEN 2 THEN 'No degree ' || entity_id ELSE 'A (B.S.), B (M.D.)' END")
    shown = F.transform(extract.degree_list_entries(text), lambda e: F.concat(F.trim(e["degree"]), F.lit("/"), e["institution"]))
    return biographies(spark, sf_dir).select("entity_id", F.array_join(shown, "|").alias("entries"))


@query("k36_degree_offsets", "SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN CAST(instr(text, 'B.S.') AS INT) - 1 WHEN 1 THEN CAST(instr(text, 'J.D.') AS INT) - 1 END AS start FROM bio", bio=BIOGRAPHIES)
def _(spark, sf_dir):
    from vitaframe.functions.text import match_offsets

    return biographies(spark, sf_dir).select("entity_id", F.get(match_offsets(F.col("text"), T.DEGREE), F.lit(0))["start"].alias("start"))


@query("k44_runner_coverage", " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(count(*) FILTER ({c}) AS BIGINT) AS filled, count(*) AS total FROM bio" for f, c in (("name", "true"), ("birthdate", "entity_id % 4 <> 3"), ("religion", "entity_id % 7 < 3"))), bio=BIOGRAPHIES)
def _(spark, sf_dir):
    t = F.col("text")
    found = biographies(spark, sf_dir).select(F.lit("rules").alias("method"), extract.first_match(t, T.NAME).alias("name"), extract.birthdate_in_text(t).alias("birthdate"), extract.religion_in_text(t).alias("religion"))
    return evaluate.coverage(found, "method", ["name", "birthdate", "religion"]).select("field", "filled", "total")


@query("l02_factual_note", f"SELECT entity_id, CASE WHEN lower(gender) = 'female' THEN '{T.FACTUAL_FEMALE}' ELSE '{T.FACTUAL_OTHER}' END || '\n\n' || religion AS text FROM gt", gt=TRUTH)
def _(spark, sf_dir):
    return truth(spark, sf_dir).select("entity_id", robustness.injected(F.col("religion"), robustness.note_for(F.lit("factual"), F.col("gender")), F.lit("start")).alias("text"))


@query("l04_evasion_substitution", "SELECT entity_id, method, religion IS NULL OR lower(trim(religion)) IN ('', 'null', 'unknown', 'none', 'n/a') AS evasion, coalesce(contains(lower(religion), 'athei'), false) AS substitution FROM pred", pred=PREDICTIONS)
def _(spark, sf_dir):
    r = F.col("religion")
    return predictions(spark, sf_dir).select("entity_id", "method", robustness.is_evasion(r).alias("evasion"), robustness.is_substitution(r).alias("substitution"))


@query("o04_resume_conditions", "SELECT entity_id, injection_type, position, style FROM (SELECT s_suppkey AS entity_id FROM supplier WHERE s_suppkey % 2 = 1) CROSS JOIN (VALUES ('direct'), ('factual')) a(injection_type) CROSS JOIN (VALUES ('start'), ('middle'), ('end')) b(position) CROSS JOIN (VALUES ('icl')) c(style)")
def _(spark, sf_dir):
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"))
    done = robustness.conditions(entities.where("entity_id % 2 = 0"), ["icl"]).drop("style")
    return robustness.conditions(entities, ["icl"], done).select("entity_id", "injection_type", "position", "style")


@query("s02_rows_per_entity", "SELECT count(religion) * 100.0 / count(DISTINCT entity_id) AS pct FROM pred", pred=PREDICTIONS)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).agg((F.count("religion") * 100.0 / F.count_distinct("entity_id")).alias("pct"))


@query("s15_consensus_with_truth", "SELECT gt.entity_id, gt.gender AS gt_gender, f.gender AS pred_gender FROM gt LEFT JOIN (SELECT entity_id, min_by(gender, method) FILTER (gender IS NOT NULL) AS gender FROM pred GROUP BY entity_id) f ON gt.entity_id = f.entity_id", **BASE)
def _(spark, sf_dir):
    agreed = evaluate.consensus(predictions(spark, sf_dir), ["gender"], []).select("entity_id", F.col("gender").alias("pred_gender"))
    return truth(spark, sf_dir).select("entity_id", F.col("gender").alias("gt_gender")).join(agreed, "entity_id", "left")
