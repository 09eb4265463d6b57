"""Resolvers: user functions over distinct, uncached values, with their answers kept in a
keyed cache. A resolver may be called again for a value when a task is re-run.

Answers of a part of a run are written once, and what is written is taken into the cache, now or
by the next run. A call that fails gives no answer: it is kept as an attempt, with its error, and
the value is asked again by a later run, after a pause that grows with the attempts.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell import rules as R
from casewell.functions import text as tx
from casewell.functions import values as vl
from casewell.operators.joins import cache_apply, cache_misses, resolvable
from casewell.session import stage
from casewell.sources.caches import POINT_CACHE, TEXT_CACHE, append_cache, attempt_log, attempts, read_cache
from casewell.sources.caches import cache_misses as cached_misses
from casewell.sources.keyed_log import KeyedLog

TextResolver = Callable[[pd.Series], pd.Series]
PointResolver = Callable[[pd.DataFrame], pd.DataFrame]


TEXT_ANSWERS = TEXT_CACHE
POINT_ANSWERS = POINT_CACHE


@dataclass(frozen=True)
class Options:
    """Limits on the calls: values per call, calls at a time, the least time between two calls
    (of all tasks together), and the number of parts after each of which the cache is saved.

    A value whose call failed is left alone for `retry_after` seconds, twice as long after each
    further failure, and for good after `attempts` of them. Only `errors` are failures of a call;
    any other exception is a fault of the program and ends the run. `now` is the time of the run
    (a timestamp text) where it is not the current one.
    """

    batch: int = 1000
    parallelism: int | None = None
    pause: float = 0.0
    parts: int = 1
    retry_after: float = 0.0
    attempts: int | None = None
    errors: tuple[type[Exception], ...] = (OSError, RuntimeError, ValueError)
    now: str | None = None


def _batches(frames: Iterator[pd.DataFrame], options: Options) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), options.batch):
            yield frame.iloc[start : start + options.batch]


@contextmanager
def _frames_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Frames of at most `most` rows in the tasks started meanwhile, so that a task holds the
    values of about one call, however many rows it has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Pace:
    """Calls of one lane among `lanes`: time is cut into slots of `pause` seconds from `start` on,
    dealt to the lanes in turn, and a call waits for a slot of its lane that is not used yet. So
    calls of all tasks keep their distance, whenever and wherever a lane's task runs, as far as
    the machines' clocks agree."""

    def __init__(self, pause: float, lanes: int = 1, lane: int = 0, start: float = 0.0):
        self.pause, self.cycle, self.first, self.last = pause, pause * lanes, start + lane * pause, -1

    def wait(self) -> None:
        if self.pause:
            at = max(math.ceil((time.time() - self.first) / self.cycle), 0, self.last + 1)
            self.last = at
            time.sleep(max(self.first + at * self.cycle - time.time(), 0))


def _call(resolver: Callable, values, failed, pace: Pace, errors: tuple = (OSError, RuntimeError, ValueError)):
    """Answers for a batch; when it fails, its values are tried one by one. Every call, also one
    that is repeated, waits for its turn."""
    pace.wait()
    try:
        return resolver(values)
    except errors as error:
        if len(values) == 1:
            return failed(values, f"{type(error).__name__}: {error}"[:1000])
    parts = [_call(resolver, values.iloc[i : i + 1], failed, pace, errors) for i in range(len(values))]
    return pd.concat(parts)


def _answer_type(schema: T.StructType) -> T.StructType:
    extra = [T.StructField("_status", T.StringType()), T.StructField("_error", T.StringType())]
    return T.StructType([*schema.fields, *extra, T.StructField("_tried_at", T.TimestampType())])


def _run(todo: DataFrame, ask: Callable, schema: T.StructType, cache: str, options: Options) -> None:
    """Resolve `todo` part by part; after each part its answers are taken into the cache.

    `ask(values, pace)` gives a frame of the cache's columns with `_status` (`error` for a failed
    call) and `_error`. A run that is ended leaves finished parts, which are not asked again.
    """
    spark = todo.sparkSession
    if options.parts > 1:
        todo = stage(todo, "pending")
    lanes = options.parallelism or (spark.sparkContext.defaultParallelism if options.pause else None)
    now = options.now
    for part in range(options.parts):
        chunk = todo
        if options.parts > 1:
            chunk = todo.filter(F.pmod(F.xxhash64("key"), F.lit(options.parts)) == part)
        if lanes:
            lane = F.pmod(F.xxhash64(F.lit("lane"), "key"), F.lit(lanes)).cast("int")
            chunk = chunk.withColumn("_lane", lane).repartitionById(lanes, F.col("_lane"))
        start = time.time()

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pace = None
            for batch in _batches(frames, options):
                if pace is None:
                    own = int(batch["_lane"].iloc[0]) if lanes else 0
                    pace = Pace(options.pause, lanes or 1, own, start)
                answers = ask(batch, pace)
                tried = pd.Timestamp(now) if now else pd.Timestamp.now("UTC").tz_localize(None)
                yield answers.assign(_tried_at=tried)

        folder = f"{cache}/answers-{uuid.uuid4().hex}"
        with _frames_of(spark, options.batch):
            chunk.mapInPandas(task, _answer_type(schema)).write.parquet(folder)
        absorb(spark, cache, schema)


def absorb(spark: SparkSession, cache: str, schema: T.StructType) -> int:
    """Take finished parts into the cache and the log of attempts; how many were new.

    A part is finished when it was written as a whole, and is marked when it has been taken in.
    Taking a part in again, after a run was ended in between, changes nothing.
    """
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(cache).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [m.getPath().getParent() for m in fs.globStatus(make(f"{cache}/answers-*/_SUCCESS")) or []]
    new = [f for f in folders if not fs.exists(make(f, "_TAKEN"))]
    for folder in new:
        answers = spark.read.schema(_answer_type(schema)).parquet(str(folder.toString()))
        answered = answers.filter("_status != 'error'").select(*schema.fieldNames())
        append_cache(answered, cache, schema, unique=True)  # a part asks for a value once
        failed = answers.filter("_status = 'error'").select(
            "key", F.lit(folder.getName()).alias("part"), F.col("_tried_at").alias("tried_at"), F.col("_error").alias("error")
        )
        if not failed.isEmpty():
            attempt_log(cache).append(failed)
        fs.create(make(folder, "_TAKEN"), True).close()
    return len(new)


def _due(keys: DataFrame, cache: str, options: Options) -> DataFrame:
    """Keys without those whose failed calls are too recent or too many."""
    if not options.retry_after and options.attempts is None:
        return keys
    tried = attempts(keys.sparkSession, cache)
    now = F.lit(options.now).cast("timestamp") if options.now else F.current_timestamp()
    waited = (now.cast("double") - F.col("tried_at").cast("double")) < options.retry_after * F.pow(F.lit(2.0), F.col("attempts") - 1)
    spent = F.lit(False) if options.attempts is None else F.col("attempts") >= options.attempts
    return keys.join(tried.filter(waited | spent).select("key"), "key", "left_anti")


def _pending_texts(
    keyed: DataFrame, col: str, lacking: Callable[[DataFrame], DataFrame], skip_mark: str | None
) -> DataFrame:
    """Distinct keyed texts without a cached answer, leaving out the ones marked as done."""
    texts = keyed.select("key", F.col(col).alias("text")).filter("text IS NOT NULL")
    if skip_mark:
        texts = texts.filter(~tx.already_marked(F.col("text"), skip_mark))
    # The cache is asked by keys; only texts that it lacks are brought together.
    wanted = lacking(texts.select("key").distinct())
    return texts.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def _lacking(cache: str, schema: T.StructType, options: Options) -> Callable[[DataFrame], DataFrame]:
    """Keys that the cache at a path lacks and that are due, once finished parts are taken in."""

    def lacking(keys: DataFrame) -> DataFrame:
        absorb(keys.sparkSession, cache, schema)
        return _due(cached_misses(keys.sparkSession, keys, cache, schema), cache, options)

    return lacking


def _hits(keyed: DataFrame, cache: str, schema: T.StructType) -> DataFrame:
    """Cached rows of the keys in `keyed`. Where they come from several runs they are stored, so
    that a join can be split at a hot key: no aggregate by the same key stands below it."""
    log = KeyedLog.open(keyed.sparkSession, cache)
    if log is not None and len(log.runs(keyed.sparkSession)) == 1:
        return log.read(keyed.sparkSession).select(*schema.fieldNames())
    keys = keyed.select("key").filter("key IS NOT NULL").distinct()
    cached = read_cache(keyed.sparkSession, cache, schema)
    return stage(cached.join(keys, "key", "left_semi"), "hits")


def pending_texts(
    df: DataFrame, col: str, cache: DataFrame, version: str | None = None, mark: str | None = None
) -> DataFrame:
    """`(key, text)` that a run would send to the resolver."""
    keyed = df.withColumn("key", tx.content_key(F.col(col), version))
    return _pending_texts(keyed, col, lambda keys: cache_misses(keys, cache), mark)


def _ask_texts(resolver: TextResolver, options: Options) -> Callable:
    """No answer to a call that went well is an answer too, and is cached as NULL."""

    def ask(batch: pd.DataFrame, pace: Pace) -> pd.DataFrame:
        def answered(texts: pd.Series) -> pd.DataFrame:
            found = pd.DataFrame({"value": resolver(texts)}, index=texts.index)
            return found.assign(_status="ok", _error=None)

        def failed(texts: pd.Series, error: str) -> pd.DataFrame:
            return pd.DataFrame({"value": None, "_status": "error", "_error": error}, index=texts.index)

        answers = _call(answered, batch["text"], failed, pace, options.errors)
        return answers.assign(key=batch["key"])[["key", "value", "_status", "_error"]]

    return ask


def resolve_text(
    df: DataFrame,
    col: str,
    resolver: TextResolver,
    cache: str,
    options: Options = Options(),
    mark: str = R.NAME_MARK,
) -> tuple[DataFrame, DataFrame]:
    """Replace texts by the resolver's answer, then apply the de-identification rules.

    Only distinct texts that are neither cached nor already marked are resolved. The cache
    holds the answer, or NULL for none; at reading an answer loses its quotes, and a text
    without an answer, or whose call failed, stays as it is. Returns the rows (with `changed`)
    and the cache; `caches.failures` tells the texts that are still to be answered.
    """
    spark = df.sparkSession
    keyed = df.withColumn("key", tx.content_key(F.col(col)))
    todo = _pending_texts(keyed, col, _lacking(cache, TEXT_CACHE, options), mark)
    _run(todo, _ask_texts(resolver, options), TEXT_ANSWERS, cache, options)
    cached = read_cache(spark, cache, TEXT_CACHE)
    bare = _hits(keyed, cache, TEXT_CACHE).withColumn("value", tx.unwrap_quotes(F.col("value")))
    resolved = cache_apply(keyed, bare, "key", F.col(col), "_resolved")
    final = tx.deidentify(F.col("_resolved"))
    rows = (
        resolved.withColumn("_final", final)
        .withColumn("changed", F.coalesce(F.col("_final") != F.col(col), F.lit(False)))
        .withColumn(col, F.col("_final"))
        .select(*df.columns, "changed")
    )
    return rows, cached


def resolve_attributes(
    df: DataFrame,
    key: str,
    col: str,
    resolver: TextResolver,
    cache: str,
    default: Mapping[str, object],
    run_ts: str,
    model: str,
    version: str = R.ATTRIBUTE_VERSION,
    options: Options = Options(),
) -> DataFrame:
    """Attribute object (JSON text) of every row with a text, with its provenance.

    The cache key holds the version, so a new version resolves every text anew. An answer
    that is no JSON, no answer, or a failed call, gives the default object; the last one only
    for this run, as the text is asked again.
    """
    import json

    fallback = F.lit(json.dumps(default, ensure_ascii=False))
    keyed = df.select(key, col).filter(F.col(col).isNotNull())
    keyed = keyed.withColumn("key", tx.content_key(F.col(col), version))
    todo = _pending_texts(keyed, col, _lacking(cache, TEXT_CACHE, options), None)
    _run(todo, _ask_texts(resolver, options), TEXT_ANSWERS, cache, options)
    valid = _hits(keyed, cache, TEXT_CACHE).withColumn(
        "value", F.when(F.try_parse_json("value").isNotNull(), F.col("value"))
    )
    applied = cache_apply(keyed, valid, "key", fallback, "attributes").select(key, "attributes")
    return vl.stamp(applied, run_ts, model=model, version=version)


def resolve_points(
    locations: DataFrame,
    street: str,
    number: str,
    resolver: PointResolver,
    cache: str,
    source: str,
    run_ts: str,
    box: Mapping[str, tuple[float, float]] = R.CITY_BOX,
    options: Options = Options(),
) -> DataFrame:
    """Coordinates of locations by street and number, with source and time where found.

    The resolver answers `lat`, `lon` and a status: `ok`, `miss` (kept in the cache as
    known) or `error` (not kept, so tried again next time). A point outside the box is
    dropped when it is read, whether cached or new. Locations without a street or number
    are not looked up.
    """
    fit, _ = resolvable(locations, street, number)
    pair = tx.pair_key(F.col(street), F.col(number))
    wanted = fit.select(pair.alias("key"), street, number).distinct()
    lacking = _lacking(cache, POINT_CACHE, options)(wanted.select("key").distinct())
    todo = wanted.join(lacking, "key", "left_semi")

    def ask(batch: pd.DataFrame, pace: Pace) -> pd.DataFrame:
        def answered(values: pd.DataFrame) -> pd.DataFrame:
            found = resolver(values)[["lat", "lon", "status"]]
            return found.assign(_status=found["status"], _error=None)

        def failed(values: pd.DataFrame, error: str) -> pd.DataFrame:
            empty = {"lat": None, "lon": None, "status": "error", "_status": "error", "_error": error}
            return pd.DataFrame(empty, index=values.index)

        answers = _call(answered, batch[[street, number]], failed, pace, options.errors).assign(key=batch["key"])
        named = answers[["key", "lat", "lon", "status", "_status", "_error"]]
        return named.astype({"lat": "float64", "lon": "float64"})

    _run(todo, ask, POINT_ANSWERS, cache, options)
    asked_keys = wanted.select("key")
    cached = _hits(asked_keys, cache, POINT_CACHE).filter(vl.in_box(F.col("lat"), F.col("lon"), box))
    hits = cached.select("key", "lat", "lon")
    fit_key = F.when((F.col(street) != "") & (F.col(number) > 0), pair)
    keyed = locations.withColumn("key", fit_key)
    # Rows that are not looked up share no key in a shuffle.
    unknown = F.lit(None).cast("double")
    skipped = keyed.filter("key IS NULL").withColumns({"lat": unknown, "lon": unknown})
    asked = keyed.filter("key IS NOT NULL").join(hits, "key", "left")
    found = asked.unionByName(skipped).drop("key")
    located = F.col("lat").isNotNull()
    return found.withColumns(
        {
            "source": F.when(located, F.lit(source)),
            "located_at": F.when(located, F.lit(run_ts).cast("timestamp_ntz")),
        }
    )
