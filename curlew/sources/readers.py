"""Readers of records, conversations, benchmarks, scores and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dataset_from_path, split_by_roles

SchemaLike = str | T.StructType

RATED_RECORD = (
    "id string, source string, prompt string, completion string, answer string, generated_output string, output string, "
    "rating_detail struct<Rarity: int, Complexity: int, Informativeness: int, Overall: int, Overall_compressed: int>, rated_task_type string"
)
MESSAGES = "array<struct<role: string, content: string>>"


def _typed(schema: SchemaLike) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def json_lines(spark: SparkSession, path: str, schema: SchemaLike, bad: str = "drop") -> DataFrame:
    """One record per line; blank lines are skipped. ``bad``: drop malformed lines, ``fail``
    on them, or ``keep`` them in ``_corrupt_record``."""
    mode = {"drop": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[bad]
    fields = _typed(schema)
    if bad == "keep":
        fields = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(fields).option("mode", mode).json(path)


def bad_lines(spark: SparkSession, path: str, schema: SchemaLike) -> DataFrame:
    """The malformed lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    fields = T.StructType([*_typed(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    return lines.filter(F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()).select("value")


def json_document(spark: SparkSession, path: str, schema: SchemaLike, containers: tuple[str, ...] = ("data", "items", "rows")) -> DataFrame:
    """A list of records, an object that holds them under one of ``containers``, or one
    record. Items that are no objects are skipped."""
    fields = _typed(schema)
    text = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    found = F.when(body.startswith("["), body)
    for name in containers:
        inner = F.get_json_object(body, f"$.{name}")
        found = found.when(inner.startswith("["), inner)
    listed = F.coalesce(found, F.concat(F.lit("["), body, F.lit("]")))
    items = F.from_json(listed, T.ArrayType(T.StringType()))
    rows = text.select(F.explode(items).alias("item")).filter(F.col("item").startswith("{"))
    return rows.select(F.from_json("item", fields).alias("r")).select("r.*")


def records(spark: SparkSession, path: str, schema: SchemaLike, bad: str = "drop") -> DataFrame:
    """By suffix: ``.jsonl`` (also compressed) or ``.json``."""
    stem = path.removesuffix(".gz")
    if stem.endswith(".jsonl"):
        return json_lines(spark, path, schema, bad)
    if stem.endswith(".json"):
        return json_document(spark, path, schema)
    raise ValueError(f"no reader for {path}")


def tagged_files(spark: SparkSession, paths: dict[str, str], schema: SchemaLike, always: bool = False, blank_too: bool = True) -> DataFrame:
    """Several files, each with a source tag. The tag fills a missing (``blank_too``: also
    an empty) source, or replaces every source if ``always``. Files that are not there are
    left out."""
    out = None
    for tag, path in paths.items():
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            continue
        rows = records(spark, path, schema)
        own = F.col("source") if "source" in rows.columns else F.lit(None).cast("string")
        own = F.nullif(own, F.lit("")) if blank_too else own
        rows = rows.withColumn("source", F.lit(tag) if always else F.coalesce(own, F.lit(tag)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], _typed(schema))


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder that hold data; none if it is a file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = [(f.getPath().getName(), f.isDirectory()) for f in found]
    return sorted(n for n, folder in names if not folder and n[0] not in "._") if names and names[0][0] != path.rstrip("/").rsplit("/", 1)[-1] else []


def any_format(spark: SparkSession, path: str, **options) -> DataFrame:
    """``path`` or ``path@split``. A file's format is that of its suffix, a folder's that of its
    first file; a split is the folder's files (or sub-folder) of that name."""
    path, _, wanted = path.partition("@")
    kinds = {"jsonl": "json", "json": "json", "csv": "csv", "tsv": "csv", "parquet": "parquet", "orc": "orc", "txt": "text"}
    suffix_of = lambda name: name.removesuffix(".gz").rsplit(".", 1)[-1].lower() if "." in name else ""
    suffix = suffix_of(path.rstrip("/").rsplit("/", 1)[-1])
    names: list[str] = []
    if suffix not in kinds:
        names = _files(spark, path)
        mine = [n for n in names if n.startswith(wanted)] if wanted else names
        if wanted and not mine:  # a folder of its own
            path = f"{path}/{wanted}"
            mine = names = _files(spark, path)
        suffix = suffix_of(mine[0]) if mine else "parquet"
        if wanted and len(mine) < len(names):
            options["pathGlobFilter"] = f"{wanted}*"
    reader = spark.read.options(**options)
    if suffix in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="," if suffix == "csv" else "\t", inferSchema=True)
    return reader.format(kinds.get(suffix, suffix)).load(path)


def delimited(spark: SparkSession, path: str, schema: SchemaLike | None = None, sep: str | None = None, header: bool = True) -> DataFrame:
    sep = sep or ("\t" if path.endswith(".tsv") else ",")
    reader = spark.read.options(header=header, sep=sep, multiLine=True, escape='"')
    return reader.schema(_typed(schema)).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def with_dataset(df: DataFrame) -> DataFrame:
    """The name of the file that a row comes from, as its data set."""
    return df.withColumn("dataset", dataset_from_path(F.col("_metadata.file_path")))


def with_scores(conversations: DataFrame, scores: DataFrame, id: str = "row_id") -> DataFrame:  # noqa: A002
    """Scores joined by row; both sides must have the same rows. Values may be null."""
    joined = conversations.withColumn("_left", F.lit(1)).join(scores.withColumn("_right", F.lit(1)), id, "full")
    if not joined.filter(F.col("_left").isNull() | F.col("_right").isNull()).isEmpty():
        raise ValueError("conversations and scores have different rows")
    return joined.drop("_left", "_right")


def preference_transcripts(spark: SparkSession, path: str, roles: tuple[str, ...] = ("Human", "Assistant")) -> DataFrame:
    """Chosen and rejected transcripts (plain or gzip), each split by role."""
    rows = json_lines(spark, path, "chosen string, rejected string")
    return rows.select("chosen", "rejected", split_by_roles("chosen", list(roles)).alias("chosen_turns"), split_by_roles("rejected", list(roles)).alias("rejected_turns"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; 0 where all are equal. One broadcast row."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)))
    return out.drop(*(f"_m_{c}" for c in columns), *(f"_s_{c}" for c in columns))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.select("*", *((F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in values)).drop(column)


def embedding_shards(spark: SparkSession, path: str, doubled: bool = False) -> DataFrame:
    """Embeddings of all shards; ``doubled`` repeats every row, for runs that expect it."""
    rows = spark.read.parquet(path)
    return rows.unionAll(rows) if doubled else rows


def labels_of(spark: SparkSession, path: str, column: str = "label") -> DataFrame:
    return any_format(spark, path).select(F.col(column).alias("label"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files of an image folder; the folder's name is the label."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.withColumn("label", F.element_at(F.split("path", "/"), -2))


def subject_questions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless question files, one per subject: question, four choices, answer."""
    schema = "question string, A string, B string, C string, D string, answer string"
    rows = delimited(spark, path, schema, header=False).withColumn("_path", F.col("_metadata.file_path"))
    stem = F.regexp_extract("_path", r"([^/]+?)(?:_test|_dev|_val)?\.csv$", 1)
    return rows.withColumn("subject", stem).drop("_path")


def number_questions(spark: SparkSession, path: str) -> DataFrame:
    """question and the number after ``####``; fails on an answer that is no number, or 0."""
    from ..functions.text import reference_number

    rows = json_lines(spark, path, "question string, answer string", "fail").withColumn("answer", reference_number("answer"))
    return rows.withColumn("answer", F.when(F.col("answer").try_cast("double") != 0, F.col("answer")).otherwise(F.raise_error(F.lit("an answer is no number, or 0"))))


def task_examples(spark: SparkSession, path: str) -> DataFrame:
    """``{"examples": [{input, target}]}`` files, one per task."""
    text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("task"))
    kind = "struct<examples: array<struct<input: string, target: string>>>"
    return text.select("task", F.explode(F.from_json("value", kind)["examples"]).alias("e")).select("task", "e.input", "e.target")


def with_task_prompts(spark: SparkSession, examples: DataFrame, path: str) -> DataFrame:
    """Each task's prompt text (files ``<task>.txt``, without their first two lines) beside its
    examples. Fails unless examples and prompts have the same tasks."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("task"), F.regexp_replace("value", r"^[^\n]*\n[^\n]*\n", "").alias("task_prompt"))
    tasks = examples.select("task").distinct()
    if not tasks.join(text, "task", "left_anti").isEmpty() or not text.join(tasks, "task", "left_anti").isEmpty():
        raise ValueError("examples and prompts have different tasks")
    return examples.join(F.broadcast(text), "task")  # one row for each task


def reading_questions(spark: SparkSession, path: str) -> DataFrame:
    """article > paragraph > question JSON as rows; the language is the id's first part."""
    kind = "struct<data: array<struct<paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string>>>>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["data"]).alias("a"))
    # Exploded as a column of its own: else each question would carry its paragraph's whole list.
    rows = rows.select(F.explode("a.paragraphs").alias("p")).select(F.col("p.context").alias("context"), F.col("p.qas").alias("qas"))
    rows = rows.select("context", F.explode("qas").alias("q"))
    return rows.select("q.id", F.split("q.id", "-")[0].alias("lang"), "context", "q.question", F.transform("q.answers", lambda a: a["text"]).alias("answers"))


def question_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, without the columns that hold nothing."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    counts = rows.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in rows.columns)).first()
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if counts[c]))


def merged_lines(spark: SparkSession, folder: str, tag: str, order: tuple[str, ...] = ("cs", "mcq", "para", "qa", "tfq")) -> DataFrame:
    """Lines of the files ``<task>_<tag>.jsonl``, tasks in order, blank lines left out."""
    rows = spark.read.text(f"{folder}/*_{tag}.jsonl").select("value", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)_{tag}\.jsonl$", 1).alias("task"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("task"))
    return rows.filter((F.trim("value") != "") & (place > 0)).withColumn("task_order", place)


def library_records(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Records of one library task with their text."""
    from ..functions.text import library_text

    schema = "question string, answer string, fine_mcq string, tfq_part string, paragraph string, category string, summarised_text string, score string"
    rows = records(spark, path, schema)
    body = {"mcq": "fine_mcq", "tfq": "tfq_part"}.get(task, "paragraph")
    text = library_text(F.lit(task), "question", "answer", body, "category", "summarised_text")
    return rows.withColumn("text", text).filter("text IS NOT NULL")


