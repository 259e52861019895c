"""Best matches by signatures against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaframe.functions import udfs
from vitaframe.operators import fuzzy

LETTERS = "abcdefghijklmnopqrstuvwxyzéñ"


def random_names(n, seed, words=3, alphabet=LETTERS):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(alphabet) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, words + 1))) for _ in range(n)]


def changed(name, r, most=6):
    out = list(name)
    for _ in range(r.randrange(most)):
        p = r.randrange(len(out) + 1)
        if r.random() < 0.5 and out:
            del out[min(p, len(out) - 1)]
        else:
            out.insert(p, r.choice(LETTERS + " "))
    return "".join(out)


def ratio(a, b):
    masks = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    return 200.0 * fuzzy.common_letters(a, masks, b) / (len(a) + len(b))


def test_pairs_above_the_ratio_meet_in_one_way():
    r, met = random.Random(7), 0
    for name in random_names(2500, 1, alphabet="abcdé") + random_names(300, 2, words=20):
        a, b = fuzzy.form_of(name), fuzzy.form_of(changed(name, r, 9))
        for least in (0.0, 40.0, 60.0, 75.0, 85.0, 92.5):
            if b and ratio(a, b) > least:
                met += 1
                by_length = fuzzy.length_class(len(b)) in fuzzy.classes(len(a), least)
                assert by_length != bool(fuzzy.signatures(a, least, False) & fuzzy.signatures(b, least, True)), (a, b, least)
    assert met > 5000


def test_near_pairs_share_a_rare_gram():
    r, met, rng = random.Random(17), 0, np.random.default_rng(1)
    for name in random_names(3000, 11, alphabet="abcdé"):
        a, b = fuzzy.form_of(name), fuzzy.form_of(changed(name, r, 3))
        for least in (92.0, 96.0, 99.0):
            if 0 < len(a) <= fuzzy.LONGEST and 0 < len(b) <= fuzzy.LONGEST and ratio(a, b) > least:
                met += 1
                mine, theirs = fuzzy.all_grams(a, least), fuzzy.rare_grams(b, least, rng.integers(0, 99, fuzzy.COUNTERS))
                most = fuzzy.grams_of(len(b), least)[0]
                assert any(x == y and abs(p - q) <= most for x, p in mine for y, q in theirs), (a, b, least)
    assert met > 3000


def test_a_word_in_common_makes_few_pairs(spark):
    """2,000 names that share their longest word: before, 2,000 * 2,000 pairs met at the first step."""
    names = [f"{reversed_} Bartholomew" for reversed_ in (str(1000003 * k)[::-1] for k in range(1, 2001))]
    left = spark.createDataFrame([(fuzzy.form_of(x + "x"),) for x in names], "left_form string")
    right = spark.createDataFrame([(fuzzy.form_of(x), x) for x in names], "form string, right_name string")
    assert fuzzy._near_pairs(left, right, fuzzy.STEPS[0]).count() < 100_000


def test_matches_share_a_chosen_piece():
    r, rng, met = random.Random(7), np.random.default_rng(7), 0
    for least in (80.0, 85.0):
        for _ in range(1500):
            a = "Ann Roe" + "".join(r.choices("ab01", k=r.randint(0, 24)))
            b = list(a)
            for _ in range(r.randint(0, 8)):
                b.insert(r.randrange(len(b) + 1), r.choice("ab01")) if r.random() < 0.5 else b.pop(r.randrange(len(b)))
            b = "".join(b)
            if b and 200.0 * fuzzy.common_letters(a, fuzzy.masks_of(a), b) / (len(a) + len(b)) > least:
                held = {(s, by) for s, by, _ in fuzzy.all_pieces(a, least, [len(b)])}
                chosen = fuzzy.rare_pieces(b, least, [len(a)], rng.integers(0, 99, fuzzy.COUNTERS))
                assert any((s, by) in held for s, low, high in chosen for by in range(low, high + 1)), (a, b, least)
                met += 1
    assert met > 500


def test_a_part_in_common_makes_few_pairs(spark):
    """By segments each pair meets at its first one."""
    names = spark.range(3000).select(F.concat(F.lit("Ann Roe"), F.substring(F.md5(F.col("id").cast("string")), 1, 24)).alias("form"))
    left, right = names.limit(1000).withColumnRenamed("form", "left_form"), names.select("form", F.col("form").alias("right_name"))
    assert fuzzy._piece_pairs(left, right, 85.0).count() < 1000 * 3000 // 10


def test_large_tables_are_not_broadcast(spark):
    """Sizes before mapInArrow say nothing of those after it."""
    found = fuzzy.fuzzy_matches(*(spark.createDataFrame([("Jane Doe",), ("Tim Poe",)], "name string") for _ in range(2)), "name", 60.0)
    assert "Broadcast" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize(("least", "alphabet"), [(60.0, LETTERS), (85.0, LETTERS), (60.0, "ab"), (85.0, "ab"), (0.0, LETTERS)])
def test_against_all_pairs(spark, least, alphabet):
    r = random.Random(3)
    rights = random_names(150, 4, alphabet=alphabet) + ["Doe Jane", "Jane Doe", "x" * 70, "  ", "Zoë Ångström"]
    lefts = [changed(x, r) for x in rights[:90]] + random_names(40, 5, alphabet=alphabet) + ["jane doe", "Jane Doe", "x" * 68 + "yy", "", "Angstrom Zoe"]
    rows = lambda names: spark.createDataFrame([(x,) for x in names] + [(None,)], "name string")
    found = fuzzy.fuzzy_matches(rows(lefts), rows(rights), "name", least)
    got = {(x.left_name, x.right_name, round(x.ratio, 9)) for x in found.collect()}
    assert got == {(a, b, round(x, 9)) for a, b, x in udfs.best_token_sorts(sorted(set(lefts)), sorted(set(rights)), least)}
    assert found.count() == len(got)
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_work_grows_slower_than_pairs(spark):
    """Signatures and candidates of random names at 85: four times the names on both sides give less than six times the rows; pairs, sixteen."""

    def rows(n):
        r = random.Random(n)
        name = lambda: " ".join("".join(r.choice(LETTERS) for _ in range(r.randrange(4, 9))) for _ in range(2))
        a, b = (spark.createDataFrame([(fuzzy.form_of(name()),) for _ in range(n)], "form string") for _ in range(2))
        mine, theirs = fuzzy._signed(a, 85.0, False), fuzzy._signed(b, 85.0, True)
        candidates = mine.join(theirs, "signature").count()
        assert candidates < n * n / 300
        return mine.count() + theirs.count() + candidates

    assert rows(6000) < 6 * rows(1500)


def test_ratios_out_of_range(spark):
    names = spark.createDataFrame([("a",)], "name string")
    for least in (-1.0, 100.0):
        with pytest.raises(ValueError, match="least ratio"):
            fuzzy.fuzzy_matches(names, names, "name", least)


def test_counts_of_fuzzy_joins_need_no_pairs(spark):
    """200,000 rows of one name on each side are 40 billion pairs; few rows against the join itself."""
    from vitaframe.operators import evaluate

    side = lambda low, high, name: spark.range(low, high).select(F.col("id").alias("entity_id"), F.lit(name).alias("full_name"))
    predictions = lambda n: side(0, n, "Jane Doe").unionByName(side(n, n + 3, None)).withColumn("method", F.lit("direct"))
    truth = lambda n: side(0, 2, "Tim Poe").unionByName(side(n + 10, 2 * n + 10, "Doe, Janes"[:8] + " Jane")).unionByName(side(n * 3 + 20, n * 3 + 22, None)).unionByName(side(n * 4 + 30, n * 5 + 30, "Doe Jane"))
    found = lambda frame: {tuple(r) for r in frame.collect()}
    assert found(evaluate.count_truth_fuzzy(predictions(20), truth(20))) == found(evaluate.join_truth_fuzzy(predictions(20), truth(20)).groupBy("method", "gt_full_name").count())
    assert ("direct", "Doe Jane", 200_000**2) in found(evaluate.count_truth_fuzzy(predictions(200_000), truth(200_000)))
