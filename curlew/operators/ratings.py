"""Rating runs: text choice, rubric prompts, plug-in raters, summaries.

Defined cases: rows without a rated text are left out; a reply that cannot be read counts as
zeros; null scores are a value of their own in counts; an empty table gives no row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import compress, rating_detail, task_type
from ..functions.text import rated_text

# What is rated, per task.
RATED = {
    "qa": ("**single** QA pair", "QA Pair"),
    "mcq": ("**single** MCQ item", "MCQ Item"),
    "para": ("**single** merged paragraph", "Paragraph"),
    "tfq": ("**single** True/False question", "TFQ"),
    "cs": ("**single** category–statement example", "CS Example"),
}
RUBRIC = (
    "You are a data-quality estimator. Rate this {what} on Rarity, Complexity, Informativeness, and Overall (1-10 integers).\n"
    "Return ONLY a JSON object like:\n"
    '{{ "Rarity": <int>, "Complexity": <int>, "Informativeness": <int>, "Overall rating": <int> }}\n\n'
    "### {name}:\n"
)


def rating_prompt(task, text):
    """The rubric of the task and the text."""
    out = F.lit(RUBRIC.format(what=RATED["qa"][0], name=RATED["qa"][1]))
    for t, (what, name) in RATED.items():
        out = F.when(task == t, F.lit(RUBRIC.format(what=what, name=name))).otherwise(out)
    return F.concat(out, text)


def rate(df: DataFrame, rater: Callable[[str], str], field: str = "output", others: tuple[str, ...] = (), strict: bool = False, threads: int = 16, retries: int = 3, delay: float = 0.0, timeout: float | None = None) -> DataFrame:
    """Adds prompt, raw reply and rating_detail. ``rater`` is called from a thread pool in
    each task; it is asked again ``delay`` seconds after it failed or took longer than
    ``timeout`` seconds, and after ``retries`` failures the reply is ``exception``, which
    reads as zeros. Rows without a rated text are left out."""
    text = rated_text(field, *others, strict=strict)
    rows = df.withColumn("_text", text).filter(F.col("_text").isNotNull())
    kind = task_type("source" if "source" in df.columns else F.lit(None).cast("string"), "id" if "id" in df.columns else F.lit(None).cast("string"))
    rows = rows.withColumn("rated_task_type", kind).withColumn("rating_prompt", rating_prompt(F.col("rated_task_type"), F.col("_text"))).drop("_text")
    at = rows.columns.index("rating_prompt")

    def ask(prompt: str) -> str:
        for i in range(retries):
            try:
                return rater(prompt)
            except Exception:  # noqa: BLE001  a rater may fail in any way; the reply says so
                if i + 1 < retries and delay:
                    time.sleep(delay)
        return "exception"

    def reply(asked: Future) -> str:
        try:
            return asked.result(timeout and retries * (timeout + delay))
        except TimeoutError:
            return "exception"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(threads)
        try:
            for b in batches:
                asked = [pool.submit(ask, p) for p in b.column(at).to_pylist()]
                yield pa.record_batch([*b.columns, pa.array(map(reply, asked), pa.string())], names=[*b.schema.names, "raw_reply"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    asked = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("raw_reply", T.StringType())]))
    return asked.withColumn("rating_detail", rating_detail("raw_reply"))


def rating_summary(df: DataFrame, task: str, raw: str) -> DataFrame:
    """Rows, mean raw and mean compressed score, of each task and of all (grouping sets)."""
    rows = df.select(F.col(task).alias("task"), F.col(raw).alias("raw"), compress(raw).alias("compressed"))
    sets = rows.groupingSets([("task",), ()], "task")
    return sets.agg(F.grouping("task").alias("overall"), F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean_raw"), F.avg("compressed").alias("mean_compressed"))


def score_counts(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def before_after(before: DataFrame, after: DataFrame, task: str) -> DataFrame:
    """Rows of each task before and after a step."""
    a = before.groupBy(F.coalesce(task, F.lit("unknown")).alias("task")).agg(F.count(F.lit(1)).alias("before"))
    b = after.groupBy(F.coalesce(task, F.lit("unknown")).alias("task")).agg(F.count(F.lit(1)).alias("after"))
    return a.join(b, "task", "full").select("task", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
