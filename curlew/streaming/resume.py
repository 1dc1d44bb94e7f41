"""Resumable incremental runs with Structured Streaming.

Defined cases: items with a null id are pending in every run; of several cached answers to
an id one is taken; an empty source makes no batch; a run without new files returns 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import staged


def run_new_files(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, by: str | None = None, files_per_batch: int = 100) -> int:
    """Processes the files of ``source`` that no earlier run has finished, and ends. Each
    micro-batch overwrites its own folder of ``sink``, so that a batch that is repeated
    after a failure leaves its rows once. Returns the number of batches of this run."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        writer = work(batch).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).json(f"{sink}/batch={number:09d}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def run_pending(items: DataFrame, log: DataFrame | None, id: str, work: Callable[[DataFrame], DataFrame], sink: str) -> None:  # noqa: A002
    """Batch form: items whose id is not in the log, appended to ``sink``."""
    todo = items if log is None else items.join(log.select(id).distinct(), id, "left_anti")
    work(todo).write.mode("append").json(sink)


def with_cache(requests: DataFrame, cache: DataFrame, id: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:  # noqa: A002
    """Answers from the cache where there are any; the rest is asked. ``ask`` returns (id,
    response)."""
    known = requests.join(cache.select(id, "response").dropDuplicates([id]), id)
    new = requests.join(cache.select(id).distinct(), id, "left_anti")
    return known.unionByName(new.join(ask(new), id))


def until_quota(draw: Callable[[int], DataFrame], keep: Callable[[DataFrame], DataFrame], quota: int, max_draws: int) -> DataFrame:
    """Draws batches and keeps rows of each until the quota is reached; raises if
    ``max_draws`` batches are not enough."""
    out, n = None, 0
    for i in range(max_draws):
        part = staged(keep(draw(i)))  # drawn once: what is counted is what is returned
        out = part if out is None else out.unionByName(part)
        n += part.count()
        if n >= quota:
            return out.orderBy("row_id").limit(quota) if "row_id" in out.columns else out.limit(quota)
    raise RuntimeError(f"{n} of {quota} rows after {max_draws} draws")
