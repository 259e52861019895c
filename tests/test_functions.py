"""Golden cases of the functions, the UDFs and their properties."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaframe.functions import dates, education, scores, text, udfs
from vitaframe.operators import evaluate, extract


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("r")).first().r


@pytest.mark.parametrize(("name", "normal"), [("José M. Núñez", "jose nunez"), ("Timothy Doe", "tim doe"), ("Katie Roe", "katherine roe"), (None, "")])
def test_normalize_name(spark, name, normal):
    assert one(spark, text.normalize_name(F.col("x")), x=name) == normal


@pytest.mark.parametrize(("name", "full"), [("Doe, Jane", "Jane Doe"), ("Adams. Jo", "Ada Jo"), ("", None)])
def test_full_name(spark, name, full):
    assert one(spark, text.standardize_full_name(F.col("x")), x=name) == full


@pytest.mark.parametrize(("raw", "day"), [("1965", "1905-05-18"), ("19650315", "1965-03-15"), ("15/03/1965", "1965-03-15"), ("3/15/75", "1975-03-15"), ("3/15/65", "2065-03-15")])
def test_birthdate(spark, raw, day):
    assert one(spark, dates.standardize_birthdate(F.col("x")), x=raw) == day


@pytest.mark.parametrize(("raw", "day"), [("3/15/65", "1965-03-15"), ("Sep 5, 1965", "1965-09-05"), ("1965", "1965-01-01"), ("nan", None)])
def test_parse_date(spark, raw, day):
    assert one(spark, dates.parse_date(F.col("x")).cast("string"), x=raw) == day


@pytest.mark.parametrize(("a", "b", "parts"), [("1965-03-15", "1965-03-14", (0, 1, 1)), ("1965-03-15", "1965", (0, 1, 0)), (None, "1965", (None,) * 3)])
def test_birthdate_parts(spark, a, b, parts):
    assert tuple(one(spark, scores.birthdate_parts(F.col("p"), F.col("t")), t=a, p=b)) == parts


@pytest.mark.parametrize(("raw", "degree"), [("B.S.", "BS"), ("bachelor's degree", "BA"), ("Juris Doctorate", "JD"), ("M.I.A.", "MIA"), (None, "")])
def test_degree(spark, raw, degree):
    assert one(spark, education.normalize_degree(F.col("x")), x=raw) == degree


def test_dotted_degrees_and_schools(spark):
    assert one(spark, education.degree_from_dotted(F.col("x")), x="Ph.D.") == "PhD"
    assert one(spark, education.degree_from_dotted(F.col("x")), x="LL.B.") == "LLB"
    school = lambda x: one(spark, education.normalize_school(F.col("x")), x=x)
    assert school("MIT") == school("Massachusetts Institute of Technology")
    assert school("University of Michigan") == "university michigan"
    assert one(spark, education.title_case(F.col("x")), x="o'brien college") == "O'Brien College"


@pytest.mark.parametrize(
    ("raw", "entries"),
    [
        ("B.S.|Oak University|1985", [("B.S.", "Oak University", "1985")]),
        ("BA|X|1980; JD|Y|1986", [("BA", "X", "1980; JD"), ("Y", "1986", None)]),
        ('[{"degree": null, "institution": "X", "year": null}]', []),
        ("[{'degree': None, 'institution': \"O'Brien\", 'year': '1990'}]", [(None, "O'Brien", "1990")]),
        (None, []),
    ],
)
def test_parse_education(spark, raw, entries):
    assert [tuple(e) for e in one(spark, education.parse_education(F.col("x")), x=raw)] == entries


def test_education_components(spark):
    both = scores.education_components(education.parse_education(F.col("p")), education.parse_education(F.col("t")))
    assert tuple(one(spark, both, t="BA|Stanford University|", p="B.A.|Stanford|")) == (1, 1, 0, 1)
    assert tuple(one(spark, both, t="BA|Stanford University|", p="")) == (None,) * 4


@pytest.mark.parametrize(("t", "p", "score"), [("Methodist", "Christian", 0.7), ("Catholic", "Baptist", 0), ("Atheist", "Agnostic", 0.7), ("x", None, None)])
def test_religion(spark, t, p, score):
    assert one(spark, scores.religion_match(F.col("p"), F.col("t")), t=t, p=p) == score


def test_religion_by_substring_or_exact(spark):
    values = {"t": "Methodist Church of X", "p": "christian"}
    assert one(spark, scores.religion_match(F.col("p"), F.col("t")), **values) == 0.7
    assert one(spark, scores.religion_match(F.col("p"), F.col("t"), by_substring=False), **values) == 0


@pytest.mark.parametrize(("t", "p", "score"), [(None, "M", None), ("Male", None, 0), ("Male", "male", 1)])
def test_gender(spark, t, p, score):
    assert one(spark, scores.gender_match(F.col("p"), F.col("t")), t=t, p=p) == score


def test_committee_scores(spark):
    values = {"t": "['Senate Committee on Finance','Judiciary']", "p": "Senate Finance Committee"}
    assert one(spark, scores.flattened_f1(F.col("p"), F.col("t")), **values) == pytest.approx(2 / 3)
    assert one(spark, scores.set_jaccard(F.col("p"), F.col("t")), **values) == 0
    assert one(spark, scores.committee_score(F.col("p"), F.col("t")), **values) == 0.3333


@pytest.mark.parametrize(("raw", "absent"), [("no info", True), ("Not stated", True), ("Nottingham", False), ("casino royale", True), (None, True)])
def test_absence(spark, raw, absent):
    assert one(spark, text.is_absent(F.col("x")), x=raw) is absent


def test_comparison_text_drops_numbers_of_records(spark):
    raw = "[{'degree': 'BA', 'institution': 'Stanford University', 'year': 1980}]"
    assert one(spark, text.comparison_text(text.string_leaves(F.col("x"))), x=raw) == "ba stanford university"


@pytest.mark.parametrize(("raw", "gender"), [("He met her.", "Female"), ("He and him, she", "Male"), ("none", None)])
def test_gender_cues(spark, raw, gender):
    assert one(spark, extract.gender_by_cues(F.col("x")), x=raw) == gender


@pytest.mark.parametrize(("raw", "day"), [("born January 15, 1965", "1965-01-15"), ("born in 1965", "1965-01-01"), ("born March 1965", "1965-03-01"), ("born Jan 5, 1965", "1965-01-01"), ("born on January 15, 1965", None)])
def test_born(spark, raw, day):
    assert one(spark, extract.birthdate_in_text(F.col("x")), x=raw) == day


def test_labels_and_pages(spark):
    assert one(spark, extract.labelled_value(F.col("x"), ["education"]), x="Education:\n\nOak University") == "Oak University"
    html = "<html><script>var x=1;</script><body>Hello</body></html>"
    assert one(spark, text.readable_text(F.col("x")), x=html) == udfs.readable(html) == "Hello"


def test_readable_text_paths_agree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    both = pages.select(text.readable_text(F.col("html")).alias("a"), udfs.html_udf(udfs.readable)("html").alias("b"))
    assert both.where("a <> b").count() == 0


@pytest.mark.parametrize(("raw", "found"), [('```json\n{"a":1}\n```', '{"a":1}'), ('Here: {"a":1} ok', '{"a":1}'), ("nope", None)])
def test_json_recovery(spark, raw, found):
    assert one(spark, text.recover_json(F.col("x")), x=raw) == found


def test_degrees_in_text(spark):
    raw = "She left Oak University in 1985 with a B.S. and later took a J.D. from Elm College in 1990."
    found = one(spark, extract.degrees_in_text(F.col("x")), x=raw)
    assert [(d.degree, d.institution) for d in found] == [("BS", "Oak University"), ("JD", "Oak University")]


def test_ratios_and_stems():
    assert udfs.sequence_ratio("tide", "diet") != udfs.sequence_ratio("diet", "tide")
    assert udfs.token_sort_ratio("Roe Ann", "Ann Roe") == 100
    stem = udfs.Stemmer()
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "probate", "committees", "generalization")] == ["caress", "poni", "relat", "hop", "agre", "probat", "committe", "gener"]
    assert udfs.stemmed_f1("banks investing", "bank invest") == 1


def test_dom():
    html = "<h2>Education</h2><p>Oak</p><table><tr><th>Alma mater</th><td>Oak (BA)<br>Elm</td></tr></table><h2>Committee assignments</h2><h4>2025-2026</h4><ul><li>Budget</li></ul><h4>older</h4><li>x</li>"
    assert udfs.after_heading(html, ["education"]) == "Oak"
    assert udfs.infobox_row(html, "alma mater") == "Oak (BA)\nElm"
    assert udfs.listed_under(html, "committee assignments", "2025-2026") == ["Budget"]


def test_model_calls():
    waits, answers = [], iter([extract.QuotaError("slow"), '{"a": 1}'])

    def model(prompt, text):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert extract.call_model(model, "p {text}", "t", extract.CallPolicy(sleep=waits.append)) == ('{"a": 1}', None)
    assert waits == [1.0]

    def broken(prompt, text):
        raise ValueError("bad")

    assert extract.call_model(broken, "p", "t", extract.CallPolicy()) == (None, "bad")


def test_ranking_golden(spark):
    row = spark.createDataFrame([(1, "regex", 0.73, 0.88, 0.3333, None)], "entity_id int, method string, a_score double, b_score double, c_score double, d_score double")
    got = evaluate.ranking(row).first()
    assert (round(got.mean_score, 4), round(got["std"], 4), got.n_fields) == (0.6478, 0.2825, 3)


def test_fuzzy_join(spark):
    gt = spark.createDataFrame([(1, "Ann Roe"), (2, "Tim Poe"), (3, "Nobody")], "entity_id long, full_name string")
    pred = spark.createDataFrame([(1, "direct", "X"), (9, "direct", "Poe Tim")], "entity_id long, method string, full_name string")
    got = evaluate.join_truth_fuzzy(pred, gt)
    assert sorted((r.entity_id, r.gt_full_name) for r in got.collect()) == [(1, "Ann Roe"), (2, "Tim Poe")]


def test_fuzzy_matches_beyond_one_block(spark):
    left = spark.createDataFrame([("Catherine",), ("Zed",)], "full_name string")
    right = spark.range(10_001).selectExpr("concat('q', id) AS full_name").union(spark.createDataFrame([("Katherine",)], "full_name string"))
    got = evaluate.fuzzy_matches(left, right, "full_name").collect()
    assert [(r.left_name, r.right_name, round(r.ratio)) for r in got] == [("Catherine", "Katherine", 89)]


def test_whole_queries_read_long_texts(spark, tmp_path):
    import re

    from vitaframe.plans.registry import QUERIES

    texts = {1: "Ann met Acme Bob", 2: "word " * 1000 + "Zed Omaha Ohio " + "x" * 9000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r.doc_id: r for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("l01_injected", "k19_entity_fields", "k23_entity_buckets", "k26_entities_by_label")}
    for i, t in texts.items():
        by = lambda k: [w for w in re.findall("[A-Z][a-z]+", t) if len(w) % 3 == k]  # noqa: B023, E731
        half = len(t) // 2
        assert got["l01_injected"][i][1:] == (f"X\n\n{t}", f"{t[:half]}\n\nX\n\n{t[half:]}", f"{t}\n\nX")
        assert got["k19_entity_fields"][i].person == next(iter(by(1)), None)
        assert got["k23_entity_buckets"][i].persons == "|".join(sorted(set(by(1)))[:5])
        assert got["k26_entities_by_label"][i].orgs == "|".join(sorted(set(by(0))))


def test_nearest_against_brute_force(spark):
    import random

    rng = random.Random(3)
    for left, right in ((400, 300), (50, 1), (50, 0), (0, 5)):
        mine = [(i, rng.choice([None, 7.0, rng.randrange(2000) / 100])) for i in range(left)]
        theirs = [(k, rng.choice([None, 5.0, rng.randrange(2000) / 100])) for k in range(right)]
        a, b = spark.createDataFrame(mine, "id long, v double"), spark.createDataFrame(theirs, "k long, w double")
        got = {r.id: r.k for r in evaluate.nearest(a, b, "v", "w", "k").collect()}
        assert got == {i: min(((abs(w - v), k) for k, w in theirs if w is not None), default=(0, None))[1] if v is not None else None for i, v in mine}


def test_every_prompt_and_biography_is_asked(spark, sf_dir):
    from vitaframe.plans.relational import QUERIES

    texts = spark.createDataFrame([(1, "a"), (2, None)], "entity_id long, text string")
    prompts = spark.range(70).selectExpr("CAST(id AS string) AS style", "'p' AS prompt")
    assert extract.ask(texts, prompts, lambda: lambda prompt, text: "{}").count() == 140
    assert QUERIES["k39_stand_in_model"](spark, sf_dir).count() == 2 * spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_fuzzy_fallback_joins_all_truth_rows(spark, sf_dir):
    from collections import Counter

    from vitaframe.plans.inputs import predictions, truth
    from vitaframe.plans.relational import QUERIES

    rows = {r.entity_id: r.full_name for r in predictions(spark, sf_dir).where("method = 'direct' and entity_id % 2 = 0").collect()}
    names, expected = Counter(x for x in rows.values() if x), Counter()
    for r in truth(spark, sf_dir).collect():
        if r.entity_id in rows:
            expected[r.full_name] += 1
        elif r.full_name and (best := udfs.best_token_sorts([r.full_name], list(names), 85.0)):
            expected[r.full_name] += names[best[0][1]]
    assert {r.gt_full_name: r["count"] for r in QUERIES["c07_fuzzy_fallback"](spark, sf_dir).collect()} == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=9), max_size=5), st.lists(st.text(alphabet="ab c", max_size=9), max_size=5), st.sampled_from([0.0, 60.0, 85.0]))
def test_best_token_sorts_against_all_pairs(lefts, rights, least):
    best = ((a, min(((-udfs.token_sort_ratio(a, b), b) for b in rights if udfs.token_sort_ratio(a, b) > least), default=None)) for a in lefts)
    assert udfs.best_token_sorts(lefts, rights, least) == [(a, m[1], -m[0]) for a, m in best if m]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab c", max_size=12), st.text(alphabet="ab c", max_size=12))
def test_token_sort_is_symmetric(a, b):
    assert udfs.token_sort_ratio(a, b) == pytest.approx(udfs.token_sort_ratio(b, a))
    assert 0 <= udfs.token_sort_ratio(a, b) <= 100


def test_scores_stay_in_range(spark, sf_dir):
    from vitaframe.plans.relational import _scores

    frame = _scores(spark, sf_dir)
    for c in evaluate.score_columns(frame):
        assert frame.where(~F.col(c).between(0, 1)).count() == 0, c
    assert json.dumps(frame.columns)


def test_config():
    from vitaframe.operators import session

    nested = session.load_config('{"model": {"model": "m", "temperature": 0.5}, "subset": {"size": 3}, "styles": {"direct": true, "icl": false}, "other": 1}')
    assert (nested.model.model, nested.model.temperature, nested.subset.size, nested.active_styles()) == ("m", 0.5, 3, ["direct"])
    assert session.load_config('{"model": "flat", "tries": 2}').model.tries == 2
    assert '"pages": 4' in session.summary(nested, 4)
    assert session.logger("x").name == "vitaframe.x"
    for bad in ('{"temperature": 3}', '{"size": 0}'):
        with pytest.raises(ValueError, match="must"):
            session.load_config(bad)
