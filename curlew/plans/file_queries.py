"""Queries that write tables with the sinks and read them back with the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dataset_from_path
from ..operators import bayes, batches
from ..sources import readers, writers
from ..storage import fresh_folder
from ..streaming import resume
from .carriers import PAIRS_SQL, pairs, rated, table, vectors
from .catalog import CLASSES, query


def _named(df: DataFrame, column: str, folder: str, suffix: str, kind: str = "text", **options) -> str:
    """One file for each value of ``column``, named by it: ``<value><suffix>``. There are as
    many files as values; the driver sees their names alone."""
    spark = df.sparkSession
    df.repartition(column).write.mode("overwrite").options(**options).partitionBy(column).format(kind).save(f"{folder}/parts")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at(f"{folder}/named"))
    for part in files.listStatus(at(f"{folder}/parts")):
        name = part.getPath().getName()
        if part.isDirectory() and "=" in name:
            inner = [f.getPath() for f in files.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            for i, f in enumerate(inner):
                files.rename(f, at(f"{folder}/named/{name.partition('=')[2]}{'' if not i else '-' + str(i)}{suffix}"))
    return f"{folder}/named"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


def _json_lists(df: DataFrame, by: str) -> DataFrame:
    """One row for each value of ``by`` (few rows each): its rows as a JSON array."""
    names = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*names))), ","), F.lit("]")).alias("j"))


# Lines with their bad ones: every fifth record is cut off, and there are blank lines.
_LINES = "CASE WHEN doc_id % 5 = 0 THEN '{\"doc_id\": ' || doc_id ELSE '{\"doc_id\": ' || doc_id || ', \"lang\": \"' || lang || '\"}' END"
_LINE_SCHEMA = "doc_id long, lang string"


def _lines(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_folder(spark, "lines") + ".jsonl"
    rows = _documents(spark, sf_dir)
    lines = rows.select(F.expr(_LINES).alias("value")).unionByName(rows.filter("doc_id % 7 = 0").select(F.lit("  ").alias("value")))
    lines.write.text(path)
    return path


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 5 != 0")
def read_lines_dropping_bad(spark, sf_dir):
    return readers.json_lines(spark, _lines(spark, sf_dir), _LINE_SCHEMA)


@query(f"SELECT {_LINES} AS value FROM documents WHERE doc_id % 5 = 0")
def read_bad_lines(spark, sf_dir):
    return readers.bad_lines(spark, _lines(spark, sf_dir), _LINE_SCHEMA)


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 5 != 0) AS good, count(*) FILTER (doc_id % 5 = 0) AS bad FROM documents")
def read_lines_keeping_bad(spark, sf_dir):
    rows = readers.json_lines(spark, _lines(spark, sf_dir), _LINE_SCHEMA, "keep")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("good"), F.count("_corrupt_record").alias("bad"))


@query("SELECT doc_id, NULLIF(lang, 'de') AS lang, n_chars FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """Null fields are kept; any malformed line would fail."""
    path = fresh_folder(spark, "lines") + ".jsonl"
    writers.json_lines(_documents(spark, sf_dir).withColumn("lang", F.nullif("lang", F.lit("de"))), path)
    return readers.records(spark, path, "doc_id long, lang string, n_chars long", "fail")


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_array_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "array") + ".json"
    writers.by_suffix(_documents(spark, sf_dir), path)
    return readers.records(spark, path, "doc_id long, lang string, n_chars long")


@query("SELECT doc_id, lang FROM documents")
def read_json_containers(spark, sf_dir):
    """Lists, objects that hold a list under one of three names, single records; items that
    are no objects are skipped."""
    rows = _documents(spark, sf_dir).select("doc_id", "lang", F.when(F.col("doc_id") % 50 == 0, F.col("doc_id") + 10).otherwise(F.col("doc_id") % 4).alias("k"))
    lists = _json_lists(rows, "k")
    one = F.regexp_replace("j", r"^\[|\]$", "")
    body = F.when(F.col("k") >= 10, one).when(F.col("k") == 1, F.concat(F.lit('{"data": '), "j", F.lit("}"))).when(F.col("k") == 2, F.concat(F.lit('{"items": '), "j", F.lit("}")))
    body = body.when(F.col("k") == 3, F.concat(F.lit('{"rows": [1, "x", '), F.substring("j", F.lit(2), F.length("j")), F.lit("}"))).otherwise(F.col("j"))
    folder = fresh_folder(spark, "containers")
    lists.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return readers.json_document(spark, folder, _LINE_SCHEMA)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source ELSE 'tag-' || lang END AS source FROM documents WHERE lang IN ('en', 'fr')")
def read_tagged_files(spark, sf_dir):
    """A tag fills sources that are missing or empty; a file that is not there is left out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 2, F.col("source")).when(F.col("doc_id") % 3 == 1, "").alias("source"))
    folder, paths = fresh_folder(spark, "tagged"), {}
    for lang in ("en", "fr"):
        paths[f"tag-{lang}"] = f"{folder}-{lang}.jsonl"
        writers.json_lines(rows.filter(F.col("lang") == lang).drop("lang"), paths[f"tag-{lang}"])
    return readers.tagged_files(spark, paths | {"none": f"{folder}-none.jsonl"}, "doc_id long, source string")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'fr')")
def read_any_format(spark, sf_dir):
    """A split of a folder of CSV files, and a folder of Parquet files."""
    rows = _documents(spark, sf_dir)
    folder = _named(rows.filter("lang IN ('en', 'de')").withColumn("split", F.when(F.col("lang") == "en", "train").otherwise("test")), "split", fresh_folder(spark, "any"), ".csv", "csv", header=True)
    whole = fresh_folder(spark, "any")
    writers.by_suffix(rows.filter("lang = 'fr'"), whole)
    kinds = [F.col("doc_id").cast("long"), "lang", F.col("n_chars").cast("long")]
    return readers.any_format(spark, f"{folder}@train").select(*kinds).unionByName(readers.any_format(spark, whole).select(*kinds))


@query("SELECT c_custkey, c_name, '\"' || c_mktsegment || '\", ' || c_custkey AS remark FROM customer")
def read_delimited(spark, sf_dir):
    """Comma- and tab-separated files with quoted fields."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit('", '), F.col("c_custkey").cast("string")).alias("remark"))
    comma, tab = fresh_folder(spark, "delimited") + ".csv", fresh_folder(spark, "delimited") + ".tsv"
    rows.filter("c_custkey % 2 = 0").write.csv(comma, header=True, escape='"')
    rows.filter("c_custkey % 2 = 1").write.csv(tab, header=True, sep="\t", escape='"')
    schema = "c_custkey long, c_name string, remark string"
    return readers.delimited(spark, comma, schema).unionByName(readers.delimited(spark, tab, schema))


@query("SELECT doc_id AS row_id, lang, quality AS score FROM documents JOIN labels USING (doc_id)")
def conversations_with_scores(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("score"))
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "lang").join(labels.select("row_id"), "row_id", "left_semi")
    return readers.with_scores(rows, labels)


@query(f"""WITH p AS ({PAIRS_SQL}) SELECT regexp_replace(prompt, '^\\s+|\\s+$', '', 'g') AS asked, regexp_replace(completion, '^\\s+|\\s+$', '', 'g') AS answered,
    CASE WHEN turn % 2 = 0 THEN 'no' ELSE 'yes' END AS refused FROM p""")
def read_preference_transcripts(spark, sf_dir):
    talk = lambda a: F.concat(F.lit("\n\nHuman: "), "prompt", F.lit("\n\nAssistant: "), a)
    rows = pairs(spark, sf_dir).select(talk(F.col("completion")).alias("chosen"), talk(F.when(F.col("turn") % 2 == 0, "no").otherwise("yes")).alias("rejected"))
    path = fresh_folder(spark, "preferences") + ".jsonl"
    rows.write.option("compression", "gzip").json(path)
    found = readers.preference_transcripts(spark, path)
    said = lambda c, role: F.element_at(F.element_at(c, role), 1)
    return found.select(said("chosen_turns", "Human").alias("asked"), said("chosen_turns", "Assistant").alias("answered"), said("rejected_turns", "Assistant").alias("refused"))


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def embedding_shards_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "shards")
    writers.shards(vectors(spark, sf_dir), path, 100)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return readers.embedding_shards(spark, path).select("vec_id", "label", F.round(total, 4).alias("total"))


@query("SELECT toxic AS label FROM labels")
def read_labels(spark, sf_dir):
    path = fresh_folder(spark, "labels") + ".csv"
    writers.by_suffix(table(spark, sf_dir, "labels"), path)
    return readers.labels_of(spark, path, "toxic")


@query("SELECT 'lang=' || lang AS label, lang || ' ' || count(*) AS content FROM documents GROUP BY lang")
def read_image_folders(spark, sf_dir):
    """Binary files whose folder is their label."""
    path = fresh_folder(spark, "images")
    rows = _documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows.select("lang", F.concat_ws(" ", "lang", "n").alias("value")).write.partitionBy("lang").text(path)
    return readers.images(spark, path).select("label", F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "\n", "")).alias("content"))


@query(f"""SELECT y AS y, count(*) AS n FROM (SELECT label::INT AS y FROM embeddings WHERE label IS NOT NULL) GROUP BY y""")
def library_round_trip(spark, sf_dir):
    folder = fresh_folder(spark, "library")
    bayes.write_library(bayes.build_library(vectors(spark, sf_dir), "vec_id", "embedding", "label", CLASSES), "qa", folder)
    rows, _, _ = bayes.read_library(spark, folder, "qa")
    return rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey || ' "?"' AS question, c_name AS A, c_mktsegment AS B, 'C' AS C, 'D' AS D, 'A' AS answer, lower(c_mktsegment) AS subject FROM customer""")
def read_subject_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    asked = rows.select(F.concat(F.col("c_custkey").cast("string"), F.lit(' "?"')).alias("question"), F.col("c_name").alias("A"), F.col("c_mktsegment").alias("B"), F.lit("C").alias("C"), F.lit("D").alias("D"), F.lit("A").alias("answer"), F.lower("c_mktsegment").alias("subject"))
    return readers.subject_questions(spark, _named(asked, "subject", fresh_folder(spark, "subjects"), "_test.csv", "csv", escape='"'))


@query("SELECT 'q' || doc_id AS question, (n_chars + 1)::VARCHAR AS answer FROM documents")
def read_number_questions(spark, sf_dir):
    """The number after ####, without thousands separators."""
    path = fresh_folder(spark, "numbers") + ".jsonl"
    told = F.concat(F.lit("First 3, then 4.\n#### "), F.format_number(F.col("n_chars") + 1, 0))
    writers.json_lines(_documents(spark, sf_dir).select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), told.alias("answer")), path)
    return readers.number_questions(spark, path)


@query("SELECT lang AS task, 'in ' || doc_id AS input, 'out ' || n_chars AS target, 'Think about ' || lang || '.' AS task_prompt FROM documents")
def read_task_examples(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("lang", F.concat(F.lit("in "), F.col("doc_id").cast("string")).alias("input"), F.concat(F.lit("out "), F.col("n_chars").cast("string")).alias("target"))
    lists = _json_lists(rows, "lang").select("lang", F.concat(F.lit('{"examples": '), "j", F.lit("}")).alias("value"))
    found = readers.task_examples(spark, _named(lists, "lang", fresh_folder(spark, "tasks"), ".json"))
    heads = rows.select("lang").distinct().select("lang", F.concat(F.lit("canary\n-----\nThink about "), "lang", F.lit(".")).alias("value"))
    return readers.with_task_prompts(spark, found, _named(heads, "lang", fresh_folder(spark, "prompts"), ".txt")).select("task", "input", "target", F.rtrim(F.regexp_replace("task_prompt", r"\n$", "")).alias("task_prompt"))


@query("SELECT lang || '-' || doc_id AS id, lang, 'ctx ' || lang AS context, 'q ' || doc_id AS question, n_chars::VARCHAR AS answer FROM documents")
def read_reading_questions(spark, sf_dir):
    qas = F.struct(F.concat_ws("-", "lang", "doc_id").alias("id"), F.concat_ws(" ", F.lit("q"), "doc_id").alias("question"), F.array(F.struct(F.col("n_chars").cast("string").alias("text"))).alias("answers"))
    # A file for each language and 40,000 ids: none grows with the table.
    rows = _documents(spark, sf_dir).groupBy("lang", F.floor(F.col("doc_id") / 40_000)).agg(F.collect_list(qas).alias("qas"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.concat_ws(" ", F.lit("ctx"), "lang").alias("context"), "qas")).alias("paragraphs"))).alias("data")))
    folder = fresh_folder(spark, "reading")
    rows.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return readers.reading_questions(spark, folder).select("id", "lang", "context", "question", F.element_at("answers", 1).alias("answer"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def read_question_table(spark, sf_dir):
    """Columns that hold nothing are left out."""
    path = fresh_folder(spark, "table") + ".csv"
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("empty")).write.csv(path, header=True)
    return readers.question_table(spark, path)


@query("""SELECT 'line ' || doc_id AS value, CASE lang WHEN 'en' THEN 'cs' WHEN 'fr' THEN 'qa' ELSE 'mcq' END AS task, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 4 ELSE 2 END AS task_order FROM documents WHERE lang != 'es'""")
def read_merged_lines(spark, sf_dir):
    task = F.when(F.col("lang") == "en", "cs").when(F.col("lang") == "fr", "qa").when(F.col("lang") == "es", "other").otherwise("mcq")
    rows = _documents(spark, sf_dir).select(F.concat(F.lit("line "), F.col("doc_id").cast("string")).alias("value"), task.alias("task"))
    rows = rows.unionByName(rows.withColumn("value", F.lit(" ")))
    return readers.merged_lines(spark, _named(rows, "task", fresh_folder(spark, "merge"), "_t.jsonl"), "t").select("value", "task", F.col("task_order").cast("int").alias("task_order"))


@query("""SELECT 'Q: ' || doc_id || chr(10) || 'A: ' || lang AS text FROM documents""")
def read_library_records(spark, sf_dir):
    path = fresh_folder(spark, "records") + ".jsonl"
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("question"), F.col("lang").alias("answer"), F.col("n_chars").cast("string").alias("score"))
    writers.json_lines(rows.unionByName(rows.limit(1).withColumn("question", F.lit(" "))), path)
    return readers.library_records(spark, path, "qa").select("text")


@query("SELECT doc_id, lang FROM documents")
def split_folders_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "split")
    writers.split_folders(_documents(spark, sf_dir), path, "lang")
    return spark.read.schema("doc_id long, n_chars long, lang string").json(path).select("doc_id", "lang")


@query("SELECT doc_id, lang AS source FROM documents")
def append_log_round_trip(spark, sf_dir):
    """Two appends, a folder per source; the second goes on where the first ended."""
    path, rows = fresh_folder(spark, "log"), _documents(spark, sf_dir).select("doc_id", F.col("lang").alias("source"))
    writers.append_log(rows.filter("doc_id % 3 = 0"), path, "source")
    schema = "doc_id long, source string"
    resume.run_pending(rows, spark.read.schema(schema).json(path), "doc_id", lambda d: d, f"{path}/source=rest")
    first = spark.read.schema(schema).json(path).filter("source != 'rest'")
    return first.unionByName(spark.read.schema(schema).json(f"{path}/source=rest"))


@query("SELECT doc_id AS row_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def chosen_rows_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "rows")
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "lang")
    writers.rows_at(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id")), path)
    return readers.json_lines(spark, path, "row_id long, lang string")


@query("SELECT s::INT AS step, lang AS key, count(*)::DOUBLE AS value FROM documents, range(2) t(s) GROUP BY ALL")
def metrics_round_trip(spark, sf_dir):
    path, rows = fresh_folder(spark, "metrics"), _documents(spark, sf_dir).groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    for step in (0, 1):
        writers.metrics(rows, path, step)
    return spark.read.parquet(path)


@query("SELECT 2 AS steps, 2 * least(20, (SELECT count(*) FROM documents)) AS n, least(20, (SELECT count(*) FROM documents)) AS inputs")
def generations_round_trip(spark, sf_dir):
    """The same sample at every step."""
    path = fresh_folder(spark, "generations")
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("input"), F.col("lang").alias("output"), F.lit(1.0).alias("score"))
    for step in (1, 2):
        writers.generations(rows, path, step, 20)
    return spark.read.parquet(path).agg(F.countDistinct("step").cast("int").alias("steps"), F.count(F.lit(1)).alias("n"), F.countDistinct("input").alias("inputs"))


@query("SELECT doc_id, lang AS dataset FROM documents")
def datasets_of_files(spark, sf_dir):
    """The file's name, without ``_low``, as the data set of its rows."""
    folder = _named(_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("value"), "lang"), "lang", fresh_folder(spark, "datasets"), "_low.txt")
    rows = readers.with_dataset(spark.read.text(folder).select("value", "_metadata"))
    return rows.select(F.col("value").cast("long").alias("doc_id"), "dataset")


@query("SELECT doc_id, lang, n_chars * 2 AS doubled FROM documents")
def incremental_run(spark, sf_dir):
    """Two runs over a growing folder: each file is processed once, per source."""
    source, sink, checkpoint = (fresh_folder(spark, k) for k in ("source", "sink", "checkpoint"))
    rows = _documents(spark, sf_dir)
    for part in (0, 1):
        rows.filter(F.col("doc_id") % 2 == part).write.mode("append").json(source)
        resume.run_new_files(spark, source, "doc_id long, lang string, n_chars long", lambda d: d.withColumn("doubled", F.col("n_chars") * 2).drop("n_chars"), sink, checkpoint, by="lang")
    return spark.read.option("basePath", sink).schema("doc_id long, doubled long, batch int, lang string").json(sink).select("doc_id", "lang", "doubled")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'cached ' ELSE 'asked ' END || doc_id AS response FROM documents")
def cached_requests(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id")
    cache = rows.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("cached "), F.col("doc_id").cast("string")).alias("response"))
    return resume.with_cache(rows, cache, "doc_id", lambda d: d.select("doc_id", F.concat(F.lit("asked "), F.col("doc_id").cast("string")).alias("response")))


@query("SELECT row_id FROM (SELECT doc_id AS row_id FROM documents WHERE doc_id % 10 < 3 ORDER BY doc_id % 10, doc_id) ORDER BY row_id LIMIT 30")
def until_quota(spark, sf_dir):
    """Draws of a tenth each until 30 rows are there, of three draws at most."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"))
    return resume.until_quota(lambda i: rows.filter(F.col("row_id") % 10 < 3), lambda d: d, 30, 3)


@query("SELECT doc_id, lang, n_chars FROM documents")
def batch_save_and_load(spark, sf_dir):
    path = fresh_folder(spark, "batch")
    writers.shards(_documents(spark, sf_dir), path)
    return batches.select(spark.read.parquet(path), ["doc_id", "lang", "n_chars", "unknown"])


def _rater(prompt: str) -> str:
    """Rates by length; every reply is an object in prose."""
    return f'Here: {{"Rarity": {len(prompt) % 10}, "Complexity": 1, "Informativeness": 2, "Overall rating": 0, "Overall": {len(prompt) % 7}}}'


@query("""WITH r AS (SELECT doc_id, 'ask ' || lang AS output FROM documents)
    SELECT doc_id, 'qa' AS rated_task_type, 1 AS complexity, 2 AS informativeness FROM r""")
def rating_run(spark, sf_dir):
    from ..operators import ratings

    rows = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("ask "), "lang").alias("output"))
    found = ratings.rate(rows, _rater, delay=0.1, timeout=30.0)
    return found.select("doc_id", "rated_task_type", F.col("rating_detail.Complexity").alias("complexity"), F.col("rating_detail.Informativeness").alias("informativeness"))
