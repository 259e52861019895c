"""Queries of the scalar functions and scores, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.functions import dates, education, scores, tables, text, udfs
from vitaframe.operators.evaluate import join_truth
from vitaframe.plans.inputs import PREDICTIONS, TRUTH, predictions, truth, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _map(table) -> str:
    """CASE for a whole-text lookup."""
    return lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _inside(table, both: bool = False) -> str:
    """CASE for an ordered substring lookup."""
    return lambda x: "CASE " + " ".join(f"WHEN contains({x}, '{k}')" + (f" OR contains('{k}', {x})" if both else "") + f" THEN '{v}'" for k, v in table.items()) + " END"


def scalar(name: str, field: str, function: Callable[[Column], Column], sql: str | None) -> None:
    """A function of one predicted field; sql: its result from column x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predictions(spark, sf_dir).select("entity_id", "method", function(F.col(field)).alias("result"))

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = with_inputs(f"SELECT entity_id, method, {sql} AS result FROM (SELECT entity_id, method, {field} AS x FROM pred)", pred=PREDICTIONS)


def score(name: str, field: str, function: Callable[[Column, Column], Column], sql: str | None) -> None:
    """A score of one field; sql: its result from prediction p and truth t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        joined = join_truth(predictions(spark, sf_dir), truth(spark, sf_dir))
        result = joined.select("entity_id", "method", function(F.col(f"pred_{field}"), F.col(f"gt_{field}")).alias("result"))
        return result.select("entity_id", "method", "result.*") if result.schema["result"].dataType.typeName() == "struct" else result

    QUERIES[name] = run
    if sql is not None:
        columns = sql if " AS " in sql.upper().rsplit(")", 1)[-1] else f"{sql} AS result"
        ORACLE_SQL[name] = with_inputs(f"SELECT entity_id, method, {columns} FROM (SELECT pred.entity_id, method, pred.{field} AS p, gt.{field} AS t FROM pred JOIN gt ON pred.entity_id = gt.entity_id)", pred=PREDICTIONS, gt=TRUTH)


def _norm(x: str, expand: bool = True) -> str:
    out = f"trim(regexp_replace(strip_accents(lower(trim(coalesce({x}, '')))), '\\s+[A-Za-z]\\.\\s*', ' ', 'g'))"
    for short, full in tables.NICKNAMES if expand else []:
        out = f"regexp_replace({out}, '\\b{short}\\b', '{full}', 'g')"
    return f"trim({out})"


def _caps(x: str) -> str:
    return f"array_to_string(list_transform(string_split(trim({x}), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), '_')"


def _words(x: str, sep: str = " ") -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || lower(w[2:])), '{sep}')"


OVERRIDES = {"Tim_Doe": "Timothy_R._Doe", "Jose_Nunez": "Pepe_Nunez"}
_over = lambda s: "CASE " + " ".join(f"WHEN contains(lower({s}), '{k.lower()}') THEN '{v}'" for k, v in OVERRIDES.items()) + " END"
_plain = f"replace({_norm('x', False)}, ' ', '_')"

scalar("i01_remove_accents", "full_name", text.remove_accents, "strip_accents(x)")
scalar("i02_normalize_name", "full_name", text.normalize_name, _norm("x"))
scalar("i02_normalize_name_plain", "full_name", lambda c: text.normalize_name(c, expand_nicknames=False), _norm("x", False))
scalar("i04_slug", "full_name", lambda c: text.slug(c, OVERRIDES), f"coalesce({_over('replace(' + _norm('x') + ', chr(32), chr(95))')}, replace({_norm('x')}, ' ', '_'))")
scalar("i06_page_url_overrides", "full_name", lambda c: text.page_url(c, "https://en.wikipedia.org/wiki/", OVERRIDES), f"'https://en.wikipedia.org/wiki/' || coalesce({_over(_plain)}, {_caps(_norm('x', False))})")
scalar("i07_page_url", "full_name", lambda c: text.page_url(c, "https://ballotpedia.org/"), f"'https://ballotpedia.org/' || {_caps(_norm('x', False))}")
scalar("i08_entity_id", "full_name", lambda c: text.entity_id(c, F.lit("oh")), f"replace({_norm('x')}, ' ', '_') || '_OH'")
scalar("i09_entity_id_capitals", "full_name", lambda c: text.entity_id(c, F.lit("oh"), capitals=True), f"{_caps(_norm('x'))} || '_OH'")
scalar("i10_name_from_stem", "full_name", lambda c: text.name_from_stem(F.concat(F.replace(c, F.lit(" "), F.lit("_")), F.lit("_OH"))), "replace(regexp_replace(replace(x, ' ', '_') || '_OH', '_[A-Z]{2}$', ''), '_', ' ')")
_full = "lower(regexp_replace(CASE WHEN contains(x, ',') THEN array_to_string(list_reverse(list_transform(string_split(trim(x), ','), lambda p: trim(p))), ' ') ELSE trim(x) END, '\\s+', ' ', 'g'))"
for _title in tables.TITLES:
    _full = f"trim(replace({_full}, '{_title}', ''))"
scalar("i12_standardize_full_name", "full_name", text.standardize_full_name, f"nullif({_words(_full)}, '')")
scalar("i13_valid_full_name", "full_name", lambda c: text.valid_full_name(text.standardize_full_name(c)), f"coalesce(len(string_split_regex(nullif({_words(_full)}, ''), '\\s+')) >= 2, false)")
scalar("i14_standardize_gender", "gender", text.standardize_gender, f"CASE WHEN lower(trim(x)) IN ({_list(tables.MALE_WORDS)}) THEN 'Male' WHEN lower(trim(x)) IN ({_list(tables.FEMALE_WORDS)}) THEN 'Female' END")
scalar("i15_valid_gender", "gender", lambda c: text.valid_in(c, ["Male", "Female"]), "coalesce(x IN ('Male', 'Female'), false)")
scalar("i16_standardize_ethnicity", "religion", lambda c: text.standardize_ethnicity(F.when(F.contains(c, F.lit("a")), F.concat(F.lit("x african american "), c)).otherwise(c)), f"(SELECT coalesce({_map(tables.ETHNICITIES)('y')}, {_inside(tables.ETHNICITIES)('y')}) FROM (SELECT lower(trim(CASE WHEN contains(x, 'a') THEN 'x african american ' || x ELSE x END)) AS y))")
scalar("i18_valid_ethnicity", "religion", lambda c: text.valid_in(text.standardize_ethnicity(c), tables.VALID_ETHNICITIES), f"coalesce(coalesce({_map(tables.ETHNICITIES)('lower(trim(x))')}, {_inside(tables.ETHNICITIES)('lower(trim(x))')}) IN ({_list(tables.VALID_ETHNICITIES)}), false)")
_us = lambda x: f"CASE WHEN regexp_matches({x}, '^\\d+/\\d+/\\d\\d$') THEN make_date(CASE WHEN CAST(regexp_extract({x}, '(\\d+)$', 1) AS INT) >= 69 THEN 1900 ELSE 2000 END + CAST(regexp_extract({x}, '(\\d+)$', 1) AS INT), CAST(regexp_extract({x}, '^(\\d+)', 1) AS INT), CAST(regexp_extract({x}, '/(\\d+)/', 1) AS INT)) END"
_std_date = f"strftime(coalesce(CASE WHEN regexp_matches(trim(x), '^\\d+$') THEN CAST(DATE '1899-12-30' + CAST(trim(x) AS INT) AS DATE) END, {_us('trim(x)')}, CAST(try_strptime(trim(x), ['%Y-%m-%d', '%B %d, %Y']) AS DATE)), '%Y-%m-%d')"
scalar("i19_standardize_birthdate", "birthdate", dates.standardize_birthdate, _std_date)
scalar("i20_valid_birthdate", "birthdate", lambda c: dates.valid_birthdate(dates.standardize_birthdate(c)), f"coalesce(year(CAST({_std_date} AS DATE)) BETWEEN 1900 AND 2010, false)")
_parsed = lambda x: f"(SELECT CASE WHEN year(d) > 2025 THEN CAST(d - INTERVAL 100 YEAR AS DATE) ELSE d END FROM (SELECT CAST(coalesce({_us(f'trim({x})')}, try_strptime(trim({x}), ['%Y-%m-%d', '%B %d, %Y', '%Y'])) AS DATE) AS d))"
scalar("i21_parse_date", "birthdate", lambda c: dates.parse_date(c).cast("string"), f"CAST({_parsed('x')} AS STRING)")
_deg = lambda x: f"(SELECT CASE WHEN y IN ({_list(tables.DEGREES_EXACT)}) THEN y ELSE coalesce({_inside(dict(tables.DEGREE_PHRASES))('y')}, y) END FROM (SELECT replace(replace(replace(trim(upper(coalesce({x}, ''))), '.', ''), ',', ''), '''', '') AS y))"
DEGREE_INPUT = "CASE entity_id % 6 WHEN 0 THEN 'B.S.' WHEN 1 THEN 'bachelor''s degree' WHEN 2 THEN 'Juris Doctorate' WHEN 3 THEN 'Ph.D.' WHEN 4 THEN 'M.I.A.' END"
SCHOOL_INPUT = "CASE entity_id % 7 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Massachusetts Institute of Technology' WHEN 2 THEN 'University of Michigan' WHEN 3 THEN 'U. of Texas' WHEN 4 THEN 'the O''Brien College, Ohio' WHEN 5 THEN 'Stanford' END"


def derived(name: str, expression: str, function: Callable[[Column], Column], sql: str | None) -> None:
    """A function of an expression over entity_id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return truth(spark, sf_dir).select("entity_id", F.expr(expression.replace("''", "\\'")).alias("x")).select("entity_id", function(F.col("x")).alias("result"))

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = with_inputs(f"SELECT entity_id, {sql} AS result FROM (SELECT entity_id, {expression} AS x FROM gt)", gt=TRUTH)


derived("i23_normalize_degree", DEGREE_INPUT, education.normalize_degree, _deg("x"))
derived("i24_degree_from_dotted", DEGREE_INPUT, education.degree_from_dotted, f"coalesce({_map(tables.DEGREES_DOTTED)('lower(trim(x))')}, upper(replace(trim(x), '.', '')))")
derived("i25_degree_family", DEGREE_INPUT, education.degree_family, "CASE WHEN contains(lower(x), 'b.a.') OR contains(lower(x), 'bachelor') THEN 'ba' WHEN contains(lower(x), 'j.d.') OR contains(lower(x), 'juris doctor') THEN 'jd' WHEN contains(lower(x), 'b.s.') THEN 'bs' ELSE lower(x) END")
_school = lambda x: f"(SELECT coalesce({_map(tables.SCHOOL_ALIASES)('y')}, {_map(tables.SCHOOL_ALIASES)('z')}, z) FROM (SELECT y, array_to_string(list_filter(string_split_regex(y, '\\s+'), lambda w: w <> '' AND w NOT IN ({_list(tables.SCHOOL_STOP_WORDS)})), ' ') AS z FROM (SELECT replace(replace(trim(lower(coalesce({x}, ''))), '.', ''), ',', '') AS y)))"
derived("i26_normalize_school", SCHOOL_INPUT, education.normalize_school, _school("x"))
derived("i28_institution_family", SCHOOL_INPUT, education.institution_family, "CASE WHEN contains(lower(x), 'stanford') THEN 'stanford university' ELSE lower(trim(x)) END")
derived("i29_standardize_entry", SCHOOL_INPUT, lambda c: F.to_json(education.standardize_entry(F.lit("b.s."), c, F.lit("1985"))), None)
derived("i30_entry_from_text", SCHOOL_INPUT, lambda c: F.to_json(education.entry_from_text(F.concat(F.lit("b.a. "), c, F.lit(" 1990")))), None)
derived("i32_valid_education", SCHOOL_INPUT, lambda c: education.valid_education(F.array(F.struct(F.lit(None).cast("string").alias("degree"), c.alias("institution")))), "x IS NOT NULL")
scalar("i33_standardize_religion", "religion", text.standardize_religion, f"coalesce({_map(tables.RELIGION_TITLES)('lower(trim(x))')}, {_inside(tables.RELIGION_TITLES)('lower(trim(x))')})")
scalar("i35_valid_religion", "religion", lambda c: text.valid_in(text.standardize_religion(c), tables.VALID_RELIGIONS), f"coalesce({_map(tables.RELIGION_TITLES)('lower(trim(x))')}, {_inside(tables.RELIGION_TITLES)('lower(trim(x))')}) IS NOT NULL")
_roles = "list_transform(CASE WHEN starts_with(x, '[') THEN CAST(x AS JSON)::VARCHAR[] ELSE string_split(x, '|') END, lambda r: " + "array_to_string(list_transform(string_split(trim(r), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' '))"
scalar("i36_standardize_roles", "committee_roles", lambda c: F.array_join(text.standardize_roles(c), "|"), f"array_to_string({_roles}, '|')")
scalar("i37_valid_roles", "committee_roles", lambda c: F.coalesce(F.forall(text.standardize_roles(c), lambda r: F.length(r) > 0), F.lit(False)), "x IS NOT NULL")
scalar("i41_parse_education", "education", lambda c: F.size(education.parse_education(c)), "CASE WHEN x IS NULL OR x = '' THEN 0 ELSE CAST((len(string_split(x, '|')) + 1) // 3 AS INT) END")
scalar("i42_institutions", "education", lambda c: F.array_join(education.institutions(education.parse_education(c)), ";"), "CASE WHEN x IS NULL THEN '' ELSE array_to_string(list_filter([string_split(x, '|')[2], string_split(x, '|')[5]], lambda y: y IS NOT NULL), ';') END")
scalar("i43_education_text", "education", education.education_text, "coalesce(x, '')")
scalar("i44_roles_text", "committee_roles", education.roles_text, "CASE WHEN starts_with(x, '[') THEN array_to_string(CAST(x AS JSON)::VARCHAR[], '|') ELSE coalesce(x, '') END")
scalar("i45_json_list", "committee_roles", lambda c: F.size(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))), "CASE WHEN starts_with(x, '[') THEN len(CAST(x AS JSON)::VARCHAR[]) ELSE 0 END::INT")
_cat = lambda x, t=tables.RELIGION_CATEGORIES: f"(SELECT coalesce({_map(t)('y')}, {_inside(t, True)('y')}) FROM (SELECT nullif(lower(trim({x})), '') AS y))"
scalar("i48_religion_category", "religion", text.religion_category, f"coalesce({_cat('x')}, nullif(lower(trim(x)), ''))")
scalar("i49_religion_category_or_null", "religion", lambda c: text.religion_category(c, fallback=False), _cat("x"))
scalar("i50_is_absent", "religion", text.is_absent, f"x IS NULL OR trim(x) = '' OR lower(trim(x)) IN ({_list(tables.ABSENCE_TERMS)}) OR contains(lower(x), 'not ') OR contains(lower(x), 'no ') OR contains(lower(x), 'unavail')")
scalar("i51_is_missing", "religion", text.is_missing, f"x IS NULL OR trim(x) = '' OR lower(trim(x)) IN ({_list(tables.AUDIT_TERMS)})")
_leaves = lambda x: f"CASE WHEN starts_with({x}, '[') THEN CAST({x} AS JSON)::VARCHAR[] WHEN {x} IS NOT NULL THEN [{x}] END"
_flat = lambda x: f"nullif(array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(array_to_string({_leaves(x)}, ' ')), '[^a-z0-9\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ({_list(tables.TEXT_STOP_WORDS)})), ' '), '')"
scalar("i52_comparison_text", "committee_roles", lambda c: text.comparison_text(text.string_leaves(c)), _flat("x"))
_set = lambda x: f"list_sort(list_distinct(list_transform({_leaves(x)}, lambda s: lower(trim(s)))))"
scalar("i53_string_set", "committee_roles", lambda c: F.array_join(text.string_set(text.string_leaves(c)), "|"), f"array_to_string({_set('x')}, '|')")
scalar("i58_likely_role", "committee_roles", text.likely_role, f"coalesce(length(trim(x)) BETWEEN 3 AND 150 AND contains(lower(x), 'committee') AND NOT regexp_matches(lower(x), '{'|'.join(tables.NOISE_WORDS)}'), false)")
scalar("i59_clean_roles", "religion", lambda c: text.clean_roles(F.concat(F.lit("House Committee|"), c, F.lit("|house committee|District 5"))), "CASE WHEN x IS NULL THEN '' ELSE 'House Committee|District 5' END")
scalar("i60_serialize_entries", "education", lambda c: education.serialize_entries(education.parse_education(c)), "CASE WHEN x IS NULL THEN '' ELSE array_to_string(list_transform(range(1, (len(string_split(x, '|')) + 1) // 3 + 1), lambda i: array_to_string([coalesce(nullif(string_split(x, '|')[3 * i - 2], ''), 'None'), string_split(x, '|')[3 * i - 1], coalesce(nullif(string_split(x, '|')[3 * i], ''), 'None')], '|')), '; ') END")
scalar("i64_religion_lower", "religion", lambda c: F.lower(F.trim(c)), "lower(trim(x))")

_same = "CAST(lower(trim(p)) = lower(trim(t)) AS DOUBLE)"
score("j01_exact_strict", "gender", scores.exact_strict, f"CASE WHEN t IS NULL THEN NULL WHEN p IS NULL THEN 0.0::DOUBLE ELSE {_same} END")
score("j02_exact_soft", "gender", scores.exact_soft, _same)
score("j03_birth_year", "birthdate", scores.birth_year, "CAST(substring(trim(p), 1, 4) = substring(trim(t), 1, 4) AS DOUBLE)")
score("j04_birthdate_parts", "birthdate", scores.birthdate_parts, f"CAST({_parsed('p')} = {_parsed('t')} AS DOUBLE) AS exact, CAST(year({_parsed('p')}) = year({_parsed('t')}) AS DOUBLE) AS year, CAST(month({_parsed('p')}) = month({_parsed('t')}) AS DOUBLE) AS month")
score("j05_name_match", "full_name", scores.name_match, f"CAST({_norm('p')} = {_norm('t')} AS DOUBLE)")
score("j06_name_ratio", "full_name", lambda p, t: (udfs.ratio_udf(text.normalize_name(p), text.normalize_name(t)) > 0.9).cast("double"), None)
score("j07_name_match_known", "full_name", scores.name_match_known, f"CASE WHEN p IS NOT NULL AND t IS NOT NULL THEN CAST({_norm('p')} = {_norm('t')} AS DOUBLE) END")
score("j08_gender_match", "gender", scores.gender_match, f"CASE WHEN coalesce(trim(t), '') = '' THEN NULL WHEN coalesce(trim(p), '') = '' THEN 0.0::DOUBLE ELSE {_same} END")
_rel = lambda a, b: f"CASE WHEN trim(p) <> '' AND trim(t) <> '' THEN CASE WHEN lower(trim(p)) = lower(trim(t)) THEN 1.0::DOUBLE WHEN {a} = {b} THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END END"
_catf = lambda x, t=tables.RELIGION_CATEGORIES: f"coalesce({_cat(x, t)}, lower(trim({x})))"
_exact = lambda x: f"coalesce({_map(tables.RELIGION_CATEGORIES)(f'lower(trim({x}))')}, lower(trim({x})))"
score("j09_religion_match", "religion", scores.religion_match, _rel(_catf("p"), _catf("t")))
score("j10_religion_match_exact", "religion", lambda p, t: scores.religion_match(p, t, by_substring=False), _rel(_exact("p"), _exact("t")))
score("j11_religion_match_protestant", "religion", lambda p, t: scores.religion_match(p, t, tables.RELIGION_PROTESTANT), _rel(_catf("p", tables.RELIGION_PROTESTANT), _catf("t", tables.RELIGION_PROTESTANT)))
score("j12_stemmed_f1", "committee_roles", udfs.stemmed_f1_udf, None)
_tokens = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
_overlap = lambda a, b: f"CAST(coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda y: y = w)), len(list_filter({b}, lambda y: y = w))))), 0) AS DOUBLE)"


def _f1(a: str, b: str) -> str:
    return f"(SELECT CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN len(a) = 0 OR len(b) = 0 OR o = 0 THEN 0.0::DOUBLE ELSE 2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)) END FROM (SELECT a, b, {_overlap('a', 'b')} AS o FROM (SELECT {a} AS a, {b} AS b)))"


_flat_f1 = _f1(_tokens(_flat("p")), _tokens(_flat("t")))
_jac = f"(SELECT CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END FROM (SELECT {_set('p')} AS a, {_set('t')} AS b))"
score("j13_flattened_f1", "committee_roles", scores.flattened_f1, _flat_f1)
_wset = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''))"
_wf1 = lambda p="p", t="t": f"(SELECT CASE WHEN a IS NULL OR b IS NULL THEN 0.0::DOUBLE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 OR o = 0 THEN 0.0::DOUBLE ELSE 2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)) END FROM (SELECT a, b, CAST(len(list_intersect(a, b)) AS DOUBLE) AS o FROM (SELECT {_wset(p)} AS a, {_wset(t)} AS b)))"
score("j14_word_set_f1", "committee_roles", scores.word_set_f1, _wf1())
score("j15_text_score", "education", scores.text_score, f"CASE WHEN p IS NULL AND t IS NULL THEN 1.0::DOUBLE WHEN p IS NULL OR t IS NULL THEN 0.0::DOUBLE ELSE {_f1(_tokens('p'), _tokens('t'))} END")
score("j17_set_jaccard", "committee_roles", scores.set_jaccard, _jac)
score("j18_committee_score", "committee_roles", scores.committee_score, f"(SELECT CASE WHEN f IS NOT NULL OR j IS NOT NULL THEN round(0.5 * coalesce(f, 0) + 0.5 * coalesce(j, 0), 4) END FROM (SELECT {_flat_f1} AS f, {_jac} AS j))")
score("j21_education_components", "education", lambda p, t: scores.education_components(education.parse_education(p), education.parse_education(t)), None)
score("j24_token_sort_ratio", "full_name", udfs.token_sort_udf, None)
score("j25_strict_on_known", "full_name", lambda p, t: scores.exact_strict(p, t), f"CASE WHEN t IS NULL THEN NULL WHEN p IS NULL THEN 0.0::DOUBLE ELSE {_same} END")
_n = lambda x: f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE (len(string_split({x}, '|')) + 1) // 3 END"
score("j27_entry_count", "education", lambda p, t: scores.entry_count(F.size(education.parse_education(p)), F.size(education.parse_education(t))), f"CASE WHEN {_n('p')} = {_n('t')} THEN 1.0::DOUBLE WHEN abs({_n('p')} - {_n('t')}) = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END")
score("j30_accuracy", "religion", lambda p, t: scores.accuracy(p, t, skip_missing=True), f"CASE WHEN p IS NULL THEN NULL WHEN t IS NULL THEN 0.0::DOUBLE ELSE {_same} END")
_lst = lambda x: f"coalesce(list_distinct(list_transform(CASE WHEN starts_with({x}, '[') THEN CAST({x} AS JSON)::VARCHAR[] END, lambda s: trim(lower(s)))), [])"
_prf = f"FROM (SELECT a, b, CAST(len(list_intersect(a, b)) AS DOUBLE) AS o FROM (SELECT {_lst('p')} AS a, {_lst('t')} AS b))"
_edge = lambda v: f"(SELECT CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE {v} END {_prf})"
score("j31_set_precision_recall", "committee_roles", lambda p, t: scores.set_precision_recall(F.from_json(p, "array<string>"), F.from_json(t, "array<string>")), f"{_edge('o / len(a)')} AS precision, {_edge('o / len(b)')} AS recall, {_edge('CASE WHEN o = 0 THEN 0.0::DOUBLE ELSE 2 * (o / len(a)) * (o / len(b)) / (o / len(a) + o / len(b)) END')} AS f1")
score("j32_education_shares", "education", lambda p, t: scores.education_shares(education.parse_education(p), education.parse_education(t)), None)
score("m01_error_type", "religion", scores.error_type, f"CASE WHEN p IS NULL THEN 'missing_pred' WHEN t IS NULL THEN 'false_positive' WHEN lower(trim(p)) = lower(trim(t)) THEN 'correct' WHEN {_wf1()} > 0.8 THEN 'partial_match' WHEN {_wf1()} > 0 THEN 'mismatch' ELSE 'false_positive' END")
