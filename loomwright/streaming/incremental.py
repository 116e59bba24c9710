"""Incremental work: files that arrive, rows done so far, and keyed state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwright.sinks import read_text, write_text


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; which of them are done is kept in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def build(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, deadline: float | None = None) -> bool:
    """Put what ``work`` makes of each micro-batch in ``out``; True if all that is there is done.

    A batch is written to a folder of its own number, so a batch that is tried again replaces itself. After
    ``deadline`` seconds no new batch starts; the next call goes on where this one ended.
    """
    spark = stream.sparkSession

    def flush(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    query = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if deadline is None:
        query.awaitTermination()
        done = True
    else:
        ends = time.monotonic() + deadline
        done = query.awaitTermination(max(0.0, ends - time.monotonic()))
        if not done:
            query.stop()
    if query.exception():
        raise query.exception()
    if done:
        write_text(spark, f"{out}/_DONE", "")
    return bool(done)


def built(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All rows of ``build``'s batches."""
    return spark.read.schema(f"{schema}, batch string").option("basePath", out).parquet(out).drop("batch")


def is_done(spark: SparkSession, out: str) -> bool:
    return read_text(spark, f"{out}/_DONE") is not None


def missing(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows still to be made."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def completed_groups(stream: DataFrame, key: str, expected: str, value: str) -> DataFrame:
    """key and its values, once as many as ``expected`` says have arrived; the state of a complete group goes.

    ``stream`` has key (long), expected (long) and value (string). Rows of a group that is complete already start a
    new one. State is bounded by the groups that are open.
    """

    def add(keys: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = list(state.get[0]) if state.exists else []
        need = state.get[1] if state.exists else 0
        for frame in frames:
            values += frame[value].tolist()
            need = max(need, int(frame[expected].max()))
        if len(values) >= need:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [keys[0]], "values": [sorted(values)]})
        else:
            state.update((values, need))

    grouped = stream.select(F.col(key).cast("long").alias(key), F.col(expected).cast("long").alias(expected), F.col(value).cast("string").alias(value)).groupBy(key)
    return grouped.applyInPandasWithState(add, f"{key} long, values array<string>", "values array<string>, need long", "append", GroupStateTimeout.NoTimeout)
