"""Streams of events: daily counters, the last state of jobs, summaries of searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factmill.operators.usage import summary_columns
from factmill.sources.counter_table import add_counts


def stream_upserts(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch with its id to ``batch``. A batch that is run again has the same id, so a sink that keeps
    the ids it has taken counts each event once."""
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(rows: DataFrame, rollup: Callable[[DataFrame], DataFrame], keys: list[str], counts: list[str], day: str, path: str, checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Counters of a stream in a table of counters: each micro-batch is rolled up and added as a batch of its own, once,
    however often it is run. Counters add up, so no state is kept between batches, and events may come as late as they
    like. Streams that write to one table need names of their own."""
    return stream_upserts(rows, lambda batch, ident: add_counts(path, rollup(batch), keys, counts, day, ident, writer), checkpoint)


def stream_rollup(rows: DataFrame, rollup: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Counters of a stream, kept by Spark's state store; those that a micro-batch changes go to ``sink`` with its id.
    A watermark on an event time bounds the state; without one a counter stays for ever, as counters do."""
    late = rows.withWatermark(*watermark) if watermark else rows
    return rollup(late).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(events: DataFrame) -> DataFrame:
    """Per request and provider the last status by seq: the streaming form of jobs.fold_events."""
    return events.groupBy("request_id", "provider_key").agg(F.max_by(F.struct("status", "error"), "seq").alias("s")).select("request_id", "provider_key", "s.*")


def stream_summaries(attempts: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """attempts: a stream of rows as usage.search_summary takes them, with ts. A search is over when ``gap`` has passed
    without another attempt; once no attempt within ``delay`` can come that is older, its summary is given, once (append
    mode), as search_summary gives it, with ``began`` and ``ended``. What is held is the sums of open searches.

    An attempt that comes later than delay is dropped. One at a gap or more after the last begins another summary of the
    same search. Searches that are still open when a stream stops are given by its next run.
    """
    late = attempts.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("_w"))
    out = late.agg(*summary_columns(attempts), F.min("ts").alias("began"), F.max("ts").alias("ended"))
    return out.drop("_w")
