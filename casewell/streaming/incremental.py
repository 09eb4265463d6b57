"""Growing stored tables from a stream of rows: each batch becomes a run of a keyed log, so it
writes in proportion to itself.

Both writers may see a batch again after a failure: inserting rows that are there, or
replacing rows by themselves, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from casewell.sources.keyed_log import KeyedLog
from casewell.sources.sinks import read_current


def _start(stream: DataFrame, write: Callable, checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _ready(spark: SparkSession, log: KeyedLog) -> KeyedLog:
    """The log; one that begins takes over the rows of a table of versions at its path."""
    if not log.exists(spark):
        log.append(read_current(spark, log.path, log.schema))
    return log


def insert_missing_stream(
    stream: DataFrame,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    checkpoint: str,
    order: Sequence[str] = (),
) -> StreamingQuery:
    """Add rows with new keys; of a batch's rows with one key the first by `order`, else the
    least. A batch without new keys writes nothing."""
    log = KeyedLog(path, schema, tuple(keys), tuple(order), keep="first")

    def write(batch: DataFrame, _: int) -> None:
        ready = _ready(batch.sparkSession, log)
        fresh = ready.missing(batch.select(*keys).distinct())
        ready.append(ready.of_keys(batch, fresh))

    return _start(stream, write, checkpoint)


def upsert_stream(
    stream: DataFrame,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    checkpoint: str,
    order: Sequence[str] = (),
) -> StreamingQuery:
    """Replace the rows of the keys that a batch holds. With `order` columns a key keeps its last
    row by them, also where an older one comes in a later batch; without, the least of a batch."""
    log = KeyedLog(path, schema, tuple(keys), tuple(order), keep="last")
    return _start(stream, lambda batch, _: _ready(batch.sparkSession, log).append(batch) and None, checkpoint)
