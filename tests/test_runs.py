"""Runs that are stopped and go on: stores by key, streams, conditions; pace of calls; semantic scores."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaframe.operators import extract, robustness, semantic
from vitaframe.streaming.store import KeyedStore, run_in_steps, stream_into

PROMPTS = [("direct", "Read: {text}"), ("icl", "Learn: {text}")]


def logged(folder, fail_after=None):
    """Work that writes a file for each key it is asked for, and fails once that many are there."""

    def work(tasks):
        def run(frames):
            import uuid

            for frame in frames:
                for k in frame["k"]:
                    (folder / f"{k}-{uuid.uuid4().hex}").touch()
                yield frame.assign(v=frame["k"] * 2)

        if fail_after is not None and len(list(folder.iterdir())) >= fail_after:
            raise KeyboardInterrupt
        return tasks.mapInPandas(run, "k long, v long")

    return work


def asked(folder):
    return collections.Counter(int(p.name.split("-")[0]) for p in folder.iterdir())


def test_a_stopped_run_repeats_nothing(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    tasks = spark.range(60).withColumnRenamed("id", "k").union(spark.range(5).withColumnRenamed("id", "k"))
    store = KeyedStore(spark, str(tmp_path / "store"), "k long, v long", ["k"])
    assert store.done().count() == 0
    with pytest.raises(KeyboardInterrupt):
        run_in_steps(tasks, store, logged(log, 25), 10)
    kept = store.done().count()
    assert 0 < kept < 60 and len(asked(log)) == kept
    (tmp_path / "store" / "part-killed").mkdir()  # what a killed writer leaves
    (tmp_path / "store" / "part-killed" / "junk.parquet").write_bytes(b"x")
    got = run_in_steps(tasks, KeyedStore(spark, str(tmp_path / "store"), "k long, v long", ["k"]), logged(log), 10)
    assert sorted(map(tuple, got.collect())) == [(k, 2 * k) for k in range(60)]
    assert set(asked(log).values()) == {1} and len(asked(log)) == 60


def test_steps_do_not_meet_what_steps_before_them_added(spark, tmp_path, monkeypatch):
    """With every step reading all parts so far, a run's work grows with the square of its steps."""
    store, read = KeyedStore(spark, str(tmp_path / "store"), "k long, v long", ["k"]), []
    done = KeyedStore.done
    monkeypatch.setattr(KeyedStore, "done", lambda self: read.append(len(self.parts())) or done(self))
    double = lambda tasks: tasks.selectExpr("k", "2 * k as v")
    run_in_steps(spark.range(20).withColumnRenamed("id", "k"), store, double, 10)
    read.clear()
    got = run_in_steps(spark.range(60).selectExpr("cast(id as int) as k"), store, double, 10)  # ids of another type than the store's
    assert sorted(map(tuple, got.collect())) == [(k, 2 * k) for k in range(60)]
    assert len(read) == 2 and read[0] == 2


def test_a_stopped_stream_repeats_nothing(spark, tmp_path):
    log, source, checkpoint = tmp_path / "log", str(tmp_path / "in"), str(tmp_path / "ck")
    log.mkdir()
    for n in range(6):
        spark.range(n * 10, n * 10 + 12).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(source)  # neighbours share keys
    frames = lambda: spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(source)
    store = KeyedStore(spark, str(tmp_path / "store"), "k long, v long", ["k"])

    def stops(tasks):
        if len(asked(log)) >= 30:
            raise ValueError("killed")
        return logged(log)(tasks)

    query = stream_into(frames(), store, checkpoint, stops)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    assert 30 <= store.done().count() < 62
    stream_into(frames(), store, checkpoint, logged(log)).awaitTermination()
    stream_into(frames(), store, checkpoint, logged(log)).awaitTermination()
    assert sorted(map(tuple, store.done().collect())) == [(k, 2 * k) for k in range(62)]
    assert set(asked(log).values()) == {1}
    stream_into(frames(), store, str(tmp_path / "other"), logged(log)).awaitTermination()  # a lost checkpoint costs no call either
    assert set(asked(log).values()) == {1} and store.done().count() == 62


def test_conditions_go_on_where_they_stopped(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def model():
        def answer(prompt, text):
            import hashlib
            import uuid

            (log / f"{hashlib.md5(prompt.encode()).hexdigest()}-{uuid.uuid4().hex}").touch()
            return "no" if prompt.startswith("Learn") else '{"religion": "%s"}' % ("atheist" if "\n\n" in text[:400] and text.startswith("Note") else "Baptist")

        return answer

    texts = spark.createDataFrame([(k, f"text {k}" if k else None, "female" if k % 2 else None) for k in range(12)], "entity_id long, text string, gender string")
    prompts = spark.createDataFrame(PROMPTS, "style string, prompt string")
    run = lambda t, path: robustness.run_conditions(t, prompts, ["direct", "icl"], model, str(tmp_path / path), slots=3, step_rows=40)
    whole = sorted(map(tuple, run(texts, "whole").collect()), key=str)
    assert len(whole) == 12 * 2 * 3 * 2 and {r[-1] for r in whole} >= {"format_break", "clean"}
    for p in log.iterdir():
        p.unlink()
    run(texts.where("entity_id < 5"), "parts")
    assert len(list(log.iterdir())) == 60
    got = run(texts, "parts")
    assert sorted(map(tuple, got.collect()), key=str) == whole
    assert len(list(log.iterdir())) == 144


def test_pace_of_all_tasks_together():
    """Tasks with clocks of their own start late, call slowly or fast, and never exceed the budget in any minute."""
    import random

    r, times = random.Random(1), []
    for lease in range(7):
        clock = [1000.0 + r.random() * 50]
        pace = extract.Pace(30, 7, lambda c=clock: c[0], lambda s, c=clock: c.__setitem__(0, c[0] + s))
        for _ in range(40):
            pace.wait(lease)
            times.append(clock[0])
            clock[0] += r.choice([0.0, 0.1, 5.0, 90.0])
    times.sort()
    assert all(b - a > 1.9 for a, b in zip(times, times[1:], strict=False))
    assert max(sum(t <= x < t + 60 for x in times) for t in times) <= 30


@pytest.mark.parametrize("slots", [2, 8])
def test_budget_holds_for_any_number_of_tasks(spark, tmp_path, slots):
    log = tmp_path / "log"
    log.mkdir()

    def model():
        def answer(prompt, text):
            import time
            import uuid

            (log / f"{time.time()}-{uuid.uuid4().hex}").touch()
            return "{}"

        return answer

    texts = spark.range(24).selectExpr("id AS entity_id", "'t' AS text").repartition(12)
    prompts = spark.createDataFrame(PROMPTS[:1], "style string, prompt string")
    assert extract.ask(texts, prompts, model, extract.CallPolicy(calls_per_minute=600), slots).count() == 24
    times = sorted(float(p.name.split("-")[0]) for p in log.iterdir())
    assert len(times) == 24 and max(sum(t <= x < t + 1 for x in times) for t in times) <= 12  # ten a second, and one at each border


def test_too_many_prompts(spark):
    texts = spark.createDataFrame([(1, "a")], "entity_id long, text string")
    with pytest.raises(ValueError, match="prompts"):
        extract.ask(texts, spark.range(1001).selectExpr("CAST(id AS string) AS style", "'p' AS prompt"), lambda: None)


def test_semantic_scores(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()

    def embedder():
        def embed(tokens):
            import uuid

            from vitaframe.operators.semantic import hashed_vectors

            for t in tokens:
                (log / f"{t}-{uuid.uuid4().hex}").touch()
            return hashed_vectors(tokens)

        return embed

    texts = ["Finance committee", "committee of FINANCE", "budget", "budget budget committee", "", "  ", None, "rules and ethics " * 400, "ethics"]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in texts for b in texts)] + [(99, texts[0], texts[1])]
    got = {r.k: r.score for r in semantic.semantic_scores(spark.createDataFrame(rows, "k int, a string, b string").repartition(4), "a", "b", embedder).collect()}

    def brute(a, b):
        if not a or not b or not a.split() or not b.split():
            return None
        va, vb = (semantic.hashed_vectors(x.lower().split()) for x in (a, b))
        like = np.array([[x @ y / np.linalg.norm(x) / np.linalg.norm(y) for y in vb] for x in va]) if len(va) * len(vb) < 1e5 else None
        if like is None:
            va, vb = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (va, vb))
            like = va @ vb.T
        p, q = like.max(1).mean(), like.max(0).mean()
        return 2 * p * q / (p + q) if p + q > 0 else 0.0

    for k, a, b in rows:
        expected = brute(a, b)
        assert got[k] is None if expected is None else got[k] == pytest.approx(expected, abs=1e-9), (a[:20], b[:20])
    calls = collections.Counter(p.name.split("-")[0] for p in log.iterdir())
    assert set(calls) == {"finance", "committee", "of", "budget", "rules", "and", "ethics"} and set(calls.values()) == {1}


def test_blocks_of_cosines(monkeypatch):
    r = np.random.default_rng(0)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(50, 8)), r.normal(size=(37, 8))))
    whole = semantic.greedy_f1(a, b, np.ones(50), np.ones(37))
    monkeypatch.setattr(semantic, "BLOCK", 7)
    assert semantic.greedy_f1(a, b, np.ones(50), np.ones(37)) == pytest.approx(whole)


def test_offsets_of_matches(spark):
    from vitaframe.functions.text import match_offsets

    frame = spark.createDataFrame([("a12b3",), ("",), ("777",), ("x",), (None,), ("é1é22",)], "t string")
    got = [[(m["start"], m["match"]) for m in r.m] if r.m is not None else None for r in frame.select(match_offsets(F.col("t"), r"\d+").alias("m")).collect()]
    assert got == [[(1, "12"), (4, "3")], [], [(0, "777")], [], None, [(1, "1"), (3, "22")]]
