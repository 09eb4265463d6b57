"""Logs of sorted runs against a dictionary, and their filters."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from casewell.session import staging_root
from casewell.sources.keyed_log import KeyedLog, Run

SCHEMA = "k string, t int, v string"


def place(spark):
    return f"{staging_root(spark)}/log-{uuid.uuid4().hex}"


def schema(spark, text=SCHEMA):
    return spark.createDataFrame([], text).schema


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def batches(seed, n, size=30):
    rng = random.Random(seed)
    keys = [None, "", *map(str, range(25))]
    return [[(rng.choice(keys), rng.choice([None, 1, 2, 3]), rng.choice("abc")) for _ in range(rng.randint(1, size))] for _ in range(n)]


def plain(batches, keep, ordered):
    """The winner of every key, by the rules of the log."""
    best = {}
    low = lambda v: (v is not None, v or 0)  # noqa: E731  (null is the least)
    for number, batch in enumerate(batches):
        for k, t, v in batch:
            if keep == "last":
                place = (low(t) if ordered else 0, number)
                better = k not in best or place > best[k][0]
            else:
                place = (number, low(t) if ordered else 0)
                better = k not in best or place < best[k][0]
            rest = (v,) if ordered else (low(t), v)
            if better or (place == best[k][0] and rest < best[k][1]):
                best[k] = (place, rest, (k, t, v))
    return sorted((row for _, _, row in best.values()), key=str)


@pytest.mark.parametrize("keep,ordered", [("last", True), ("last", False), ("first", True), ("first", False)])
def test_log_equals_dictionary(spark, keep, ordered):
    log = KeyedLog(place(spark), schema(spark), ("k",), ("t",) if ordered else (), keep, fan=3)
    assert not log.exists(spark) and log.read(spark).count() == 0
    done = []
    for batch in batches(11, 5):
        log.append(spark.createDataFrame(batch, SCHEMA).repartition(2))
        done.append(batch)
        if len(done) > 1:
            assert rows(log.read(spark)) == plain(done, keep, ordered)
    assert log.append(spark.createDataFrame([], SCHEMA)) is None
    # Five batches and a fan of three: one merged run and two single ones.
    assert log.runs(spark) == [Run(1, 0, 2), Run(0, 3, 3), Run(0, 4, 4)]
    assert log.vacuum(spark) == 3 and log.vacuum(spark) == 0
    assert rows(log.read(spark)) == plain(done, keep, ordered)
    assert rows(KeyedLog.described(log.path, log.describe()).read(spark)) == rows(log.read(spark))


def test_a_batch_is_written_in_proportion_to_itself(spark):
    log = KeyedLog(place(spark), schema(spark, "k bigint, v bigint"), ("k",))
    log.append(spark.range(50_000).select(F.col("id").alias("k"), F.col("id").alias("v")))
    log.append(spark.createDataFrame([(7, 1), (7, 2), (60_000, 3)], "k bigint, v bigint"))
    sizes = [spark.read.parquet(f"{log.path}/{r.name}").count() for r in log.runs(spark)]
    assert sizes == [50_000, 2]
    found = log.read(spark)
    assert found.count() == 50_001 and found.filter("k = 7").collect()[0]["v"] == 1
    # The large run is read without a shuffle: what is exchanged are the rows of the small one.
    found.collect()
    assert exchanged(found) < 1000


def test_runs_are_sorted_buckets(spark):
    log = KeyedLog(place(spark), schema(spark, "k bigint"), ("k",))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.append(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(f"{log.path}/{log.runs(spark)[0].name}")
    files = stored.select(F.input_file_name().alias("f"), "k", F.monotonically_increasing_id().alias("i"))
    found = files.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("i", "k"))).alias("a")).collect()
    assert len(found) > 1 and sum(len(r["a"]) for r in found) == 1000
    for r in found:
        assert [x["k"] for x in r["a"]] == sorted(x["k"] for x in r["a"])


def test_unfinished_runs_do_not_count(spark):
    log = KeyedLog(place(spark), schema(spark, "k bigint"), ("k",))
    log.append(spark.range(3).withColumnRenamed("id", "k"))
    spark.range(9).withColumnRenamed("id", "k").write.parquet(f"{log.path}/_open-killed")
    assert log.read(spark).count() == 3 and len(log.runs(spark)) == 1
    assert log.vacuum(spark) == 1 and log.read(spark).count() == 3


def exchanged(df):
    """Rows that the shuffles of a collected frame wrote."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name not in ("ReusedExchangeExec",):
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("bits", [0, 1, 16, None])
def test_missing_keys_with_any_filter(spark, bits):
    sizes = {"filter_from": 10**6} if bits is None else {"filter_from": 0, "bits": bits}
    log = KeyedLog(place(spark), schema(spark, "k string"), ("k",), fan=4, **sizes)
    assert log.missing(spark.createDataFrame([("a",)], "k string")).count() == 1
    log.append(spark.range(6000).select(F.col("id").cast("string").alias("k")))
    asked = spark.createDataFrame([(str(i),) for i in range(5990, 6020)] + [(None,), ("",)], "k string")
    want = sorted([str(i) for i in range(6000, 6020)] + ["None", ""])
    assert sorted(map(str, (r["k"] for r in log.missing(asked).collect()))) == want
    log.append(spark.createDataFrame([(None,), ("6001",)], "k string"))
    want = sorted({*want} - {"None", "6001"})
    assert sorted(map(str, (r["k"] for r in log.missing(asked).collect()))) == want


def test_sure_misses_pass_the_join(spark):
    """With a useful filter the rows of the log and the sure misses are not exchanged."""
    plain = {}
    keys = spark.range(100_000, 104_000).select(F.col("id").cast("string").alias("k"))
    for bits in (0, 16):
        log = KeyedLog(place(spark), schema(spark, "k string"), ("k",), bits=bits, filter_from=1000)
        log.append(spark.range(60_000).select(F.col("id").cast("string").alias("k")))
        limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000b")
        try:
            found = log.missing(keys)
            assert len(found.collect()) == 4000
            plain[bits] = exchanged(found)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plain[0] > 60_000 and plain[16] < 20_000
