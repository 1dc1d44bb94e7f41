"""Few-shot prompts: demonstrations of each group, then the question.

Defined cases: null texts are left out of demonstrations; a group without examples has none; an
empty table gives no row; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import sample_per


def demonstrations(examples: DataFrame, by: str, id: str, text: Column, n: int, separator: str = "", seed: int | None = None) -> DataFrame:  # noqa: A002
    """One row per group: the texts of its first ``n`` examples by id (or a fixed sample of
    ``n``, if there is a seed), joined in order of id."""
    rows = examples.withColumn("_text", text)
    if seed is None:
        rows = rows.groupBy(by).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col(id).alias("k"), F.col("_text").alias("t")))), 1, n).alias("_d"))
    else:
        rows = sample_per(rows, by, id, n, seed).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(id).alias("k"), F.col("_text").alias("t")))).alias("_d"))
    return rows.select(by, F.array_join(F.transform("_d", lambda d: d["t"]), separator).alias("demonstrations"))


def few_shot(questions: DataFrame, shots: DataFrame, by: str, question: Column, opening: Column | str = "", out: str = "prompt") -> DataFrame:
    """Opening text, the group's demonstrations (none: left out) and the question."""
    start = F.lit(opening) if isinstance(opening, str) else opening
    joined = questions.join(shots, by, "left")
    return joined.withColumn(out, F.concat(start, F.coalesce("demonstrations", F.lit("")), question)).drop("demonstrations")


def by_language(questions: DataFrame, templates: DataFrame, language: str = "lang") -> DataFrame:
    """Joins the parts of a prompt in the row's language: ``templates(lang, ...)``, one row
    for each language."""
    return questions.join(F.broadcast(templates), language, "left")


def without_reasoning(demos: Column, mark: str = "A: Let's think step by step.", answer: str = "So the answer is ") -> Column:
    """Demonstrations (joined by blank lines) with the reasoning between ``mark`` and the
    stated answer taken out."""
    parts = F.split(demos, r"\n\n(?=Q: )")

    def one(p: Column) -> Column:
        head = F.substring_index(p, mark, 1)
        tail = F.substring_index(p, answer, -1)
        return F.when(p.contains(mark) & p.contains(answer), F.concat(head, F.lit("A: "), tail)).otherwise(p)

    return F.array_join(F.transform(parts, one), "\n\n")


def cut_to_tokens(df: DataFrame, text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], at_most: int) -> DataFrame:
    """Texts of more than ``at_most`` tokens end there; others stay as they are. The tokenizer is a
    plug-in; texts go through it in Arrow batches."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                ids = encode(t) if t is not None else []
                out.append(decode(ids[:at_most]) if len(ids) > at_most else t)
            cols = b.columns
            cols[at] = pa.array(out, pa.string())
            yield pa.record_batch(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)
