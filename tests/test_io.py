"""Sources, sinks, kept results and resumption."""

from vitaframe.sources import readers, writers
from vitaframe.streaming.resume import resume, stream_files


def test_pages(spark, tmp_path):
    (tmp_path / "Ann_Roe_OH.html").write_bytes(b"<p>Hi</p>")
    (tmp_path / "Tim_Poe_UT.html").write_bytes(b"<p>\xffHi</p>")
    got = {r.entity_id: r.html for r in readers.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"Ann_Roe_OH": "<p>Hi</p>", "Tim_Poe_UT": "<p>Hi</p>"}
    assert readers.read_pages(spark, str(tmp_path), strict=True).count() == 1


def test_csv_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "quoted"\nline', ["x"])], "entity_id int, t string, l array<string>")
    writers.write_csv(frame, str(tmp_path / "c"))
    row = readers.read_csv(spark, str(tmp_path / "c"), key="entity_id").first()
    assert row.t == 'a "quoted"\nline'
    assert row.l == '["x"]'
    (tmp_path / "d.csv").write_text("id,v\n7,a\n")
    assert readers.read_csv(spark, str(tmp_path / "d.csv"), key="entity_id").columns == ["entity_id", "v"]


def test_json_styles(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"entity_id": "a", "task1": {"direct": {"gender": "F"}, "icl": {"gender": null}}}]')
    got = readers.flatten_styles(readers.read_json(spark, str(tmp_path / "r.json"), "entity_id string, task1 map<string,struct<gender:string>>"))
    assert sorted((r.method, r.gender) for r in got.collect()) == [("direct", "F"), ("icl", None)]
    writers.write_json(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("- name: Finance\n  thomas_id: SSFI\n  subcommittees:\n  - name: Trade\n    thomas_id: '10'\n")
    (tmp_path / "m.yaml").write_text("SSFI:\n- name: Ann Roe\n  party: majority\n  rank: 1\n")
    names = {r.committee_id: r.name for r in readers.committee_names(readers.read_yaml(spark, str(tmp_path / "c.yaml"))).collect()}
    assert names == {"SSFI": "Finance", "SSFI10": "Trade"}
    assert readers.memberships(readers.read_yaml(spark, str(tmp_path / "m.yaml"))).first()["rank"] == 1


def test_sheets_and_kept_results(spark, tmp_path):
    writers.write_sheets({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s/b")).count() == 3
    calls = []

    def compute():
        calls.append(1)
        return spark.range(4)

    path = str(tmp_path / "kept")
    assert [writers.kept_or_computed(spark, path, compute).count() for _ in range(2)] == [4, 4]
    assert len(calls) == 1
    writers.kept_or_computed(spark, path, compute, overwrite=True)
    assert len(calls) == 2


def test_resume_equals_full_run(spark):
    tasks = spark.range(10).withColumnRenamed("id", "k")
    work = lambda t: t.selectExpr("k", "k * 2 AS v")
    done = work(tasks.where("k < 4"))
    assert sorted(map(tuple, resume(tasks, done, ["k"], work).collect())) == sorted(map(tuple, work(tasks).collect()))


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n in range(2):
        spark.range(n * 10, n * 10 + 5).write.mode("append").parquet(src)
        stream_files(spark, src, "id long", out, ck, lambda f: f.selectExpr("id + 1 AS id")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(1, 6), *range(11, 16)]
