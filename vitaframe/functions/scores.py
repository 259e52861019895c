"""Scores of a prediction against the truth as Column functions; null means not scored."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaframe.functions import tables as T
from vitaframe.functions.dates import parse_date
from vitaframe.functions.education import normalize_degree, normalize_school
from vitaframe.functions.text import comparison_text, let, normalize_name, religion_category, religion_category_exact, string_leaves, string_set



def _zero() -> Column:
    return F.lit(0.0)


def _one() -> Column:
    return F.lit(1.0)


def _same(a: Column, b: Column) -> Column:
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")


def exact_strict(pred: Column, truth: Column) -> Column:
    """No truth: null; no prediction: 0."""
    return F.when(truth.isNotNull(), F.when(pred.isNull(), _zero()).otherwise(_same(pred, truth)))


def exact_soft(pred: Column, truth: Column) -> Column:
    """Either side missing: null."""
    return _same(pred, truth)


def birth_year(pred: Column, truth: Column) -> Column:
    return (F.substring(F.trim(pred), 1, 4) == F.substring(F.trim(truth), 1, 4)).cast("double")


def birthdate_parts(pred: Column, truth: Column) -> Column:
    """struct<exact, year, month>; month alone, whatever the year."""
    a, b = parse_date(pred), parse_date(truth)
    return F.struct((a == b).cast("double").alias("exact"), (F.year(a) == F.year(b)).cast("double").alias("year"), (F.month(a) == F.month(b)).cast("double").alias("month"))


def name_match(pred: Column, truth: Column) -> Column:
    """Equality of normal forms; both empty 1, one empty 0."""
    return (normalize_name(pred) == normalize_name(truth)).cast("double")


def name_match_known(pred: Column, truth: Column) -> Column:
    return F.when(pred.isNotNull() & truth.isNotNull(), name_match(pred, truth))


def gender_match(pred: Column, truth: Column) -> Column:
    """Blank truth: null; blank prediction: 0."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~blank(truth), F.when(blank(pred), _zero()).otherwise(_same(pred, truth)))


def religion_match(pred: Column, truth: Column, table: Mapping[str, str] = T.RELIGION_CATEGORIES, by_substring: bool = True) -> Column:
    """1 if equal, 0.7 if of one category, else 0; a blank side: null."""
    category = religion_category if by_substring else religion_category_exact

    def score(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return F.when((a != "") & (b != ""), F.when(a == b, _one()).when(category(a, table) == category(b, table), F.lit(0.7)).otherwise(_zero()))

    return let(F.struct(F.lower(F.trim(pred)).alias("a"), F.lower(F.trim(truth)).alias("b")), score)


def _f1(overlap: Column, n_pred: Column, n_truth: Column) -> Column:
    p, r = overlap / n_pred, overlap / n_truth
    return F.when(overlap == 0, _zero()).otherwise(2 * p * r / (p + r))


def unigram_f1(pred: Column, truth: Column) -> Column:
    """ROUGE-1 F over the tokens [a-z0-9]+ as multisets; for short fields (the overlap is found per distinct token)."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))

    def score(w: Column) -> Column:
        a, b = w["a"], w["b"]
        overlap = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
        value = let(overlap, lambda o: _f1(o, F.greatest(F.size(a), F.lit(1)), F.greatest(F.size(b), F.lit(1))))
        return F.when(a.isNotNull() & b.isNotNull(), F.when((F.size(a) == 0) | (F.size(b) == 0), _zero()).otherwise(value))

    return let(F.struct(tokens(pred).alias("a"), tokens(truth).alias("b")), score)


def flattened_f1(pred: Column, truth: Column) -> Column:
    """unigram_f1 of the comparison texts of lists or plain texts; a side without words: null."""
    return unigram_f1(comparison_text(string_leaves(pred)), comparison_text(string_leaves(truth)))


def word_set_f1(pred: Column, truth: Column) -> Column:
    """F of the sets of words between white space; a missing side: 0; both without words: 1."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))

    def score(w: Column) -> Column:
        a, b = w["a"], w["b"]
        both_empty = (F.size(a) == 0) & (F.size(b) == 0)
        value = let(F.size(F.array_intersect(a, b)), lambda o: _f1(o, F.greatest(F.size(a), F.lit(1)), F.greatest(F.size(b), F.lit(1))))
        known = F.when(both_empty, _one()).when((F.size(a) == 0) | (F.size(b) == 0), _zero()).otherwise(value)
        return F.when(a.isNull() | b.isNull(), _zero()).otherwise(known)

    return let(F.struct(words(pred).alias("a"), words(truth).alias("b")), score)


def text_score(pred: Column, truth: Column) -> Column:
    """unigram_f1; both missing 1, one missing 0."""
    return F.when(pred.isNull() & truth.isNull(), _one()).when(pred.isNull() | truth.isNull(), _zero()).otherwise(unigram_f1(pred, truth))


def set_jaccard(pred: Column, truth: Column) -> Column:
    """Of string sets; no truth: null; no prediction: 0."""

    def score(w: Column) -> Column:
        a, b = w["a"], w["b"]
        return F.when(b.isNotNull(), F.when(a.isNull(), _zero()).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))

    return let(F.struct(string_set(string_leaves(pred)).alias("a"), string_set(string_leaves(truth)).alias("b")), score)


def committee_score(pred: Column, truth: Column) -> Column:
    """Half flattened_f1, half set_jaccard, to four places; null if neither is scored."""
    both = F.struct(flattened_f1(pred, truth).alias("f"), set_jaccard(pred, truth).alias("j"))
    return let(both, lambda x: F.when(x["f"].isNotNull() | x["j"].isNotNull(), F.bround(0.5 * F.coalesce(x["f"], _zero()) + 0.5 * F.coalesce(x["j"], _zero()), 4)))


def entry_count(pred: Column, truth: Column) -> Column:
    """From numbers of entries: equal 1, off by one 0.5, else 0."""
    return F.when(pred == truth, _one()).when(F.abs(pred - truth) == 1, F.lit(0.5)).otherwise(_zero())


def accuracy(pred: Column, truth: Column, skip_missing: bool = False) -> Column:
    """0 for a missing side; skip_missing: null for a missing prediction."""
    return F.when(pred.isNull(), F.lit(None).cast("double") if skip_missing else _zero()).when(truth.isNull(), _zero()).otherwise(_same(pred, truth))


def set_precision_recall(pred: Column, truth: Column) -> Column:
    """struct<precision, recall, f1> of lists of texts; both empty 1, one empty 0. Null lists count as empty."""
    clean = lambda c: F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.trim(F.lower(x))))
    a, b = clean(pred), clean(truth)
    n, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    edge = lambda value: F.when((na == 0) & (nb == 0), _one()).when((na == 0) | (nb == 0), _zero()).otherwise(value)
    one = lambda x: F.greatest(x, F.lit(1))
    return F.struct(edge(n / one(na)).alias("precision"), edge(n / one(nb)).alias("recall"), edge(_f1(n, one(na), one(nb))).alias("f1"))


def education_shares(pred: Column, truth: Column) -> Column:
    """struct<degree_count, institution, year, overall>: equal numbers of entries, and filled shares of the prediction."""
    na, nb = F.size(pred), F.size(truth)
    filled = lambda f: F.size(F.filter(pred, lambda e: ~F.coalesce(e[f], F.lit("")).isin("", "None"))) / F.greatest(na, F.lit(1))
    edge = lambda value: F.when((na == 0) & (nb == 0), _one()).when((na == 0) | (nb == 0), _zero()).otherwise(value)
    count = (na == nb).cast("double")
    i, y = filled("institution"), filled("year")
    return F.struct(edge(count).alias("degree_count"), edge(i).alias("institution"), edge(y).alias("year"), edge((count + i + y) / 3).alias("overall"))


def _comparable(entry: Column) -> Column:
    return F.struct(normalize_degree(entry["degree"]).alias("degree"), normalize_school(entry["institution"]).alias("institution"), F.trim(F.coalesce(entry["year"], F.lit(""))).alias("year"))


def _part(a: Column, b: Column, equal: Column) -> Column:
    return F.when((a != "") & (b != ""), equal.cast("double")).when((a != "") | (b != ""), _zero())


def pair_scores(p: Column, t: Column, near: Column | None = None) -> Column:
    """struct<rank, degree, institution, year> of comparable entries; rank is the mean of the parts that count, or -1. near: institutions that are equal besides."""
    same = (p["institution"] == t["institution"]) | F.contains(t["institution"], p["institution"]) | F.contains(p["institution"], t["institution"])
    parts = F.array(_part(t["degree"], p["degree"], t["degree"] == p["degree"]), _part(t["institution"], p["institution"], same if near is None else same | near), _part(t["year"], p["year"], t["year"] == p["year"]))

    def ranked(x: Column) -> Column:
        known = F.filter(x, lambda y: y.isNotNull())
        mean = F.when(F.size(known) > 0, F.aggregate(known, _zero(), lambda s, y: s + y) / F.size(known))
        return F.struct(F.coalesce(mean, F.lit(-1.0)).alias("rank"), x[0].alias("degree"), x[1].alias("institution"), x[2].alias("year"))

    return let(parts, ranked)


def education_components(pred: Column, truth: Column) -> Column:
    """struct<degree, institution, year, combined>: means over the true entries of their best predicted one's parts.

    An empty list on either side: nulls. Institutions are equal as normal forms or if one holds the other;
    operators.profile.education_alignment also takes similar ones.
    """

    def best(ps: Column, t: Column) -> Column:
        return F.array_max(F.transform(ps, lambda p, i: let(pair_scores(p, t), lambda s: F.struct(s["rank"].alias("rank"), (-i).alias("first"), s.alias("scores")))))["scores"]

    def means(found: Column) -> Column:
        mean = lambda f: F.aggregate(found, _zero(), lambda s, x: s + F.coalesce(f(x), _zero())) / F.size(found)
        return F.struct(*(mean(lambda x, k=k: x[k]).alias(k) for k in ("degree", "institution", "year")), mean(lambda x: F.greatest(x["rank"], _zero())).alias("combined"))

    scored = (F.size(pred) > 0) & (F.size(truth) > 0)
    aligned = let(F.transform(pred, _comparable), lambda ps: F.transform(F.transform(truth, _comparable), lambda t: best(ps, t)))
    none = F.lit(None).cast("struct<degree:double,institution:double,year:double,combined:double>")
    out = F.when(scored, let(aligned, means)).otherwise(none)
    return F.struct(*(out[k].alias(k) for k in ("degree", "institution", "year", "combined")))


def error_type(pred: Column, truth: Column) -> Column:
    """missing_pred, false_positive, correct, partial_match or mismatch."""
    f = word_set_f1(pred, truth)
    return F.when(pred.isNull(), "missing_pred").when(truth.isNull(), "false_positive").when(_same(pred, truth) == 1, "correct").when(f > 0.8, "partial_match").when(f > 0, "mismatch").otherwise("false_positive")


#: Scorers by field; others can be added under a new name.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "full_name": name_match_known, "gender": gender_match, "religion": religion_match, "birthdate_year": birth_year,
    "education": flattened_f1, "committee_roles": committee_score,
}


def register(name: str, scorer: Callable[[Column, Column], Column]) -> None:
    SCORERS[name] = scorer
