import json
import re

import pytest
from pyspark.sql import functions as F

from curlew.sources import readers, writers
from curlew.streaming import resume


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"id": "1", "n": 2}\n\nnot json\n{"id": "é"}\n')
    assert [r.id for r in readers.json_lines(spark, p, "id string, n int").collect()] == ["1", "é"]
    assert readers.bad_lines(spark, p, "id string, n int").collect()[0].value == "not json"
    assert readers.json_lines(spark, p, "id string, n int", "keep").cache().filter("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, p, "id string, n int", "fail").collect()


@pytest.mark.parametrize("body", ['[{"id": "1"}, 5, {"id": "2"}]', '{"items": [{"id": "1"}, {"id": "2"}]}', '{"data": [{"id": "1"}, {"id": "2"}], "x": 1}'])
def test_json_document(spark, tmp_path, body):
    p = put(tmp_path / "a.json", body)
    assert sorted(r.id for r in readers.records(spark, p, "id string").collect()) == ["1", "2"]


def test_json_single_object_and_suffix(spark, tmp_path):
    assert [r.id for r in readers.records(spark, put(tmp_path / "b.json", '{"id": "9"}'), "id string").collect()] == ["9"]
    with pytest.raises(ValueError, match="no reader"):
        readers.records(spark, "x.xml", "id string")


def test_tagged_files(spark, tmp_path):
    a = put(tmp_path / "qa.json", '[{"id": "1", "source": ""}, {"id": "2", "source": "web"}]')
    got = readers.tagged_files(spark, {"qa": a, "cs": str(tmp_path / "none.json")}, "id string, source string")
    assert sorted((r.id, r.source) for r in got.collect()) == [("1", "qa"), ("2", "web")]
    got = readers.tagged_files(spark, {"qa": a}, "id string, source string", always=True)
    assert {r.source for r in got.collect()} == {"qa"}


def test_benchmark_readers(spark, tmp_path):
    p = put(tmp_path / "gsm.jsonl", json.dumps({"question": "q", "answer": "so #### 1,200"}) + "\n")
    assert readers.number_questions(spark, p).first().answer == "1200"
    put(tmp_path / "mmlu/abstract_algebra_test.csv", '"What, x?",1,2,3,4,B\n')
    row = readers.subject_questions(spark, str(tmp_path / "mmlu")).first()
    assert (row.subject, row.answer) == ("abstract_algebra", "B")
    put(tmp_path / "bbh/date.json", json.dumps({"examples": [{"input": "i", "target": "t"}]}))
    assert tuple(readers.task_examples(spark, str(tmp_path / "bbh")).first()) == ("date", "i", "t")
    nested = {"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "fi-1", "question": "q", "answers": [{"text": "a"}]}]}]}]}
    row = readers.reading_questions(spark, put(tmp_path / "tydi.json", json.dumps(nested))).first()
    assert (row.lang, row.answers) == ("fi", ["a"])
    p = put(tmp_path / "tq.csv", "Question,Empty\nq1,\nq2,\n")
    assert readers.question_table(spark, p).columns == ["Question"]


def test_a_question_does_not_carry_its_paragraph(spark, tmp_path):
    asked = [{"id": f"fi-{i}", "question": f"q{i}", "answers": [{"text": str(i)}]} for i in range(300)]
    path = put(tmp_path / "tydi.json", json.dumps({"data": [{"paragraphs": [{"context": "c", "qas": asked}]}, {"paragraphs": []}]}))
    rows = readers.reading_questions(spark, path)
    assert re.search(r"explode\(qas#\d+\), \[context#\d+\]", rows._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.question, r.context, r.answers[0]) for r in rows.collect()) == sorted((f"q{i}", "c", str(i)) for i in range(300))


def test_merged_lines(spark, tmp_path):
    put(tmp_path / "m/qa_x.jsonl", '{"a": 1}\n\n')
    put(tmp_path / "m/cs_x.jsonl", '{"a": 2}\n')
    rows = readers.merged_lines(spark, str(tmp_path / "m"), "x").orderBy("task_order").collect()
    assert [(r.task, r.value) for r in rows] == [("cs", '{"a": 2}'), ("qa", '{"a": 1}')]


def test_tables(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, k string")
    assert sorted(r.x for r in readers.standardised(df, ["x"]).collect()) == [-1.0, 1.0]
    assert readers.one_hot(df, "k", ["a", "b"]).orderBy("x").collect()[0].k_a == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", "x")], "row_id long, t string, n string")
    writers.json_lines(df.coalesce(1), str(tmp_path / "a"))
    text = "".join(f.read_text() for f in (tmp_path / "a").glob("part*"))
    assert '"t":"é"' in text
    assert '"n":null' in text
    writers.by_suffix(df, str(tmp_path / "b.json"))
    assert sum(len(json.loads(f.read_text())) for f in (tmp_path / "b.json").glob("part*")) == 2
    writers.json_array(spark.range(25), str(tmp_path / "e.json"), rows=4)
    found = [json.loads(f.read_text()) for f in (tmp_path / "e.json").glob("part*")]
    assert max(map(len, found)) <= 4
    assert sorted(r["id"] for f in found for r in f) == list(range(25))
    writers.split_folders(df, str(tmp_path / "c"), "t")
    assert len([p for p in (tmp_path / "c").iterdir() if p.is_dir()]) == 2
    writers.shards(df.coalesce(1), str(tmp_path / "d"), rows=1)
    assert len(list((tmp_path / "d").glob("*.parquet"))) == 2
    for step in (1, 2):
        writers.metrics(spark.createDataFrame([("loss", 0.5)], "key string, value double"), str(tmp_path / "m"), step)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    writers.rows_at(df, df.filter("row_id = 2"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().t == "b"


def test_resumed_stream(spark, tmp_path):
    src, sink, mark = tmp_path / "src", str(tmp_path / "sink"), str(tmp_path / "mark")
    put(src / "1.jsonl", '{"id": 1, "source": "qa"}\n{"id": 2, "source": "cs"}\n')
    work = lambda df: df.withColumn("y", F.col("id") * 10)
    args = (spark, str(src), "id long, source string", work, sink, mark)
    resume.run_new_files(*args, by="source")
    resume.run_new_files(*args, by="source")
    put(src / "2.jsonl", '{"id": 3, "source": "qa"}\n')
    resume.run_new_files(*args, by="source")
    assert sorted(r.y for r in spark.read.json(sink).collect()) == [10, 20, 30]


def test_batch_resume_cache_and_quota(spark, tmp_path):
    items = spark.createDataFrame([(i,) for i in range(4)], "id long")
    log = str(tmp_path / "log")
    resume.run_pending(items.filter("id < 2"), None, "id", lambda d: d, log)
    resume.run_pending(items, spark.read.json(log), "id", lambda d: d, log)
    assert sorted(r.id for r in spark.read.json(log).collect()) == [0, 1, 2, 3]
    cache = spark.createDataFrame([(0, "old")], "id long, response string")
    got = resume.with_cache(items, cache, "id", lambda d: d.withColumn("response", F.lit("new")))
    assert sorted((r.id, r.response) for r in got.collect()) == [(0, "old"), (1, "new"), (2, "new"), (3, "new")]
    assert resume.until_quota(lambda i: items, lambda d: d.filter("id > 1"), 3, 5).count() == 3
    with pytest.raises(RuntimeError, match="after 1 draws"):
        resume.until_quota(lambda i: items, lambda d: d, 9, 1)
