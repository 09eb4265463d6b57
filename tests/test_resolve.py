from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.functions import text as tx
from casewell.functions import values as vl
from casewell.operators import resolve as X
from casewell.sources.caches import POINT_CACHE, TEXT_CACHE, append_cache, attempts, failures, read_cache

# The resolvers of this file travel to the workers with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def quoting(texts: pd.Series) -> pd.Series:
    return ' "' + texts.str.replace("OJEDA", "[NOMBRE]", regex=False) + '" '


def failing(texts: pd.Series) -> pd.Series:
    if texts.str.contains("OJEDA", regex=False).any():
        raise RuntimeError("no answer")
    return texts.str.lower()


def forbidden(texts: pd.Series) -> pd.Series:
    raise AssertionError("must not be called")


def answers(cache):
    return {r["key"]: r["value"] for r in cache.collect()}


TEXTS = ["OFICIAL OJEDA LP 12", "DOLOR", "OFICIAL OJEDA LP 12", "OF [NOMBRE] X", None]


def texts_frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


def test_tasks_hold_the_texts_of_a_call(spark, tmp_path, monkeypatch):
    def held(frames, options):
        for frame in frames:
            assert len(frame) <= options.batch
            yield frame

    monkeypatch.setattr(X, "_batches", held)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.range(40).select(F.concat(F.lit("OJEDA "), F.col("id").cast("string")).alias("t"))
    found, _ = X.resolve_text(df, "t", quoting, str(tmp_path / "cache"), X.Options(batch=5))
    assert found.filter("changed").count() == 40 and spark.conf.get(name) == before


def test_resolve_text(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows, cached = X.resolve_text(texts_frame(spark), "t", quoting, cache)
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [
        (0, "OFICIAL [NOMBRE] [LP]", True), (1, "DOLOR", False), (2, "OFICIAL [NOMBRE] [LP]", True),
        (3, "OF [NOMBRE] X", False), (4, None, False),
    ]
    assert len(answers(cached)) == 2
    # A second run finds everything in the cache and changes nothing.
    again, cached = X.resolve_text(texts_frame(spark), "t", forbidden, cache)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert len(answers(cached)) == 2


def test_failed_text_stays_and_is_asked_again(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows, cached = X.resolve_text(texts_frame(spark), "t", failing, cache)
    found = {r["id"]: r["t"] for r in rows.collect()}
    assert found[0] == "OFICIAL OJEDA [LP]" and found[1] == "dolor"
    # Only answers are cached; the failed call is kept as an attempt.
    assert list(answers(cached).values()) == ["dolor"]
    left = failures(spark, cache, TEXT_CACHE).collect()
    assert [(r["attempts"], r["error"]) for r in left] == [(1, "RuntimeError: no answer")]
    X.resolve_text(texts_frame(spark), "t", failing, cache)
    assert failures(spark, cache, TEXT_CACHE).first()["attempts"] == 2
    rows, cached = X.resolve_text(texts_frame(spark), "t", quoting, cache)
    assert {r["id"]: r["t"] for r in rows.collect()}[0] == "OFICIAL [NOMBRE] [LP]"
    assert failures(spark, cache, TEXT_CACHE).count() == 0 and cached.count() == 2


def test_back_off_after_failures(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = texts_frame(spark)

    def tried(now, rule=failing, **more):
        options = X.Options(retry_after=60, now=f"2024-01-01 00:{now}", **more)
        X.resolve_text(df, "t", rule, cache, options)
        return attempts(spark, cache).first()["attempts"]

    # 60 seconds after the first failure, then 120, then 240.
    times = {"00:00": 1, "00:59": 1, "01:00": 2, "02:59": 2, "03:00": 3, "06:59": 3}
    assert {now: tried(now) for now in times} == times
    assert tried("59:00", attempts=3) == 3 and tried("59:00") == 4
    tried("59:59", forbidden)


def test_faults_of_the_program_end_the_run(spark, tmp_path):
    with pytest.raises(Exception, match="must not be called"):
        X.resolve_text(texts_frame(spark), "t", forbidden, str(tmp_path / "cache"))


def test_finished_parts_are_not_asked_again(spark, tmp_path, monkeypatch):
    """A run that is ended after a part was written, but before it was taken into the cache."""
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(i, f"T{i}") for i in range(20)], "id int, t string")
    with monkeypatch.context() as patch:

        def ended(*_, **__):
            raise KeyboardInterrupt

        patch.setattr(X, "append_cache", ended)
        with pytest.raises(KeyboardInterrupt):
            X.resolve_text(df, "t", failing, cache)
    rows, cached = X.resolve_text(df, "t", forbidden, cache)
    assert cached.count() == 20 and {r["t"] for r in rows.collect()} == {f"t{i}" for i in range(20)}
    assert X.absorb(spark, cache, TEXT_CACHE) == 0


def test_parts_resume(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(i, f"T{i}") for i in range(40)], "id int, t string")
    options = X.Options(batch=3, parallelism=2, parts=4)
    rows, cached = X.resolve_text(df, "t", failing, cache, options)
    assert {r["t"] for r in rows.collect()} == {f"t{i}" for i in range(40)}
    assert len(answers(cached)) == cached.count() == 40
    more = df.union(spark.createDataFrame([(40, "NEW")], "id int, t string"))
    assert X.pending_texts(more, "t", cached).count() == 1


def attribute_rule(texts: pd.Series) -> pd.Series:
    found = texts.map({"A": '{"kind": "x"}', "B": "not json"})
    return found.where(found.notna(), None)


@pytest.mark.parametrize("version", ["v1", "v2"])
def test_attributes(spark, tmp_path, version):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None), (5, "A")], "id int, t string")
    default = {"kind": "none"}
    cache = str(tmp_path / "cache")

    def run(rule, v):
        return X.resolve_attributes(df, "id", "t", rule, cache, default, "2024-01-01 00:00:00", "m", v)

    out = {r["id"]: json.loads(r["attributes"])["kind"] for r in run(attribute_rule, version).collect()}
    assert out == {1: "x", 2: "none", 3: "none", 5: "x"}
    with calls(tmp_path) as counted:
        run(counted, version).collect()
    assert not (tmp_path / "called").exists()
    # Another version asks again for every text.
    todo = X.pending_texts(df, "t", read_cache(spark, cache, TEXT_CACHE), version + "-next")
    assert todo.count() == 3


@contextmanager
def calls(folder):
    """A resolver that leaves a file when it is called."""
    path = str(folder / "called")

    def resolver(texts: pd.Series) -> pd.Series:
        open(path, "w").close()
        return pd.Series([None] * len(texts), index=texts.index)

    yield resolver


def test_texts_that_are_json_are_no_answers(spark, tmp_path):
    texts = ["true", "12345", '{"sexo": "M"}', '"{}"']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    none = lambda v: pd.Series([None] * len(v), index=v.index)
    out = X.resolve_attributes(df, "id", "t", none, str(tmp_path / "c"), {"k": 1}, "2024-01-01 00:00:00", "m")
    assert {r["attributes"] for r in out.collect()} == {'{"k": 1}'}


def test_every_call_waits_for_its_turn():
    def refuse(v):
        raise RuntimeError

    start = time.time()
    X._call(refuse, pd.Series(["a"] * 4), lambda v, e: pd.Series([None], index=v.index), X.Pace(0.05, start=start))
    assert time.time() - start >= 0.2


def test_pace_of_all_tasks_together(spark, tmp_path):
    """Four tasks, some calls that fail: no two calls come closer than the pause."""
    folder = tmp_path / "calls"
    folder.mkdir()
    at, pause = str(folder), 0.15

    def noted(texts: pd.Series) -> pd.Series:
        now = time.time()
        with open(f"{at}/{now:.6f}-{uuid.uuid4().hex}", "w") as file:
            file.write(str(os.getpid()))
        if texts.str.endswith("7").any():
            raise OSError("busy")
        return texts.str.lower()

    df = spark.createDataFrame([(i, f"T{i}") for i in range(30)], "id int, t string")
    options = X.Options(batch=3, parallelism=4, pause=pause)
    X.resolve_text(df, "t", noted, str(tmp_path / "cache"), options)
    files = sorted(folder.iterdir())
    times = [float(f.name.split("-")[0]) for f in files]
    assert len(times) >= 10 and len({f.read_text() for f in files}) > 1
    assert min(b - a for a, b in zip(times, times[1:])) > pause * 0.6
    assert times[-1] - times[0] >= (len(times) - 1) * pause * 0.95
    assert failures(spark, str(tmp_path / "cache"), TEXT_CACHE).count() == 3


def test_double_keys_in_a_cache_do_not_double_rows(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("k", None), ("k", "a"), ("k", "b")], TEXT_CACHE).write.parquet(path)
    assert answers(read_cache(spark, path, TEXT_CACHE)) == {"k": "b"}


def test_default_object_is_the_contract():
    default = vl.attribute_default(R.CATEGORIES, R.FLAGS)
    assert default["sexo"] == "desconocido" and default["embarazo"] is False


def geocoder(places: pd.DataFrame) -> pd.DataFrame:
    known = {"CALIFORNIA": (-34.6472, -58.3748, "ok"), "FAR": (-34.7912, -58.5229, "ok"),
             "NOWHERE": (None, None, "miss"), "BROKEN": (None, None, "error")}
    if (places["s"] == "RAISES").any():
        raise RuntimeError("network")
    return pd.DataFrame(
        [known[s] for s in places["s"]], columns=["lat", "lon", "status"], index=places.index
    )


def forbidden_points(places: pd.DataFrame) -> pd.DataFrame:
    assert set(places["s"]) <= {"BROKEN", "RAISES"}
    return pd.DataFrame({"lat": None, "lon": None, "status": "error"}, index=places.index)


def test_points(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [("CALIFORNIA", 1850), ("FAR", 430), ("NOWHERE", 1), ("BROKEN", 1), ("RAISES", 1),
            ("CALIFORNIA", 0), ("", 1850), (None, 3)]
    df = spark.createDataFrame(rows, "s string, n int")

    def run(rule):
        out = X.resolve_points(df, "s", "n", rule, cache, "rule", "2024-01-01 00:00:00")
        return {(r["s"], r["n"]): (r["lat"], r["lon"], r["source"]) for r in out.collect()}

    first = run(geocoder)
    assert first[("CALIFORNIA", 1850)] == (-34.6472, -58.3748, "rule")
    assert {k for k, v in first.items() if v == (None, None, None)} == set(rows[1:])
    cached = read_cache(spark, cache, POINT_CACHE)
    # Hits, also outside the box, and known misses are kept; errors and skipped rows are not.
    assert {r["key"]: r["status"] for r in cached.collect()} == {
        "CALIFORNIA|1850": "ok", "FAR|430": "ok", "NOWHERE|1": "miss",
    }
    assert run(forbidden_points) == first


def test_cache_append_keeps_keys_unique(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert read_cache(spark, path, TEXT_CACHE).count() == 0
    append_cache(spark.createDataFrame([("k", "a"), ("k", "b")], TEXT_CACHE), path, TEXT_CACHE)
    append_cache(spark.createDataFrame([("k", "z"), ("l", "c")], TEXT_CACHE), path, TEXT_CACHE)
    assert answers(read_cache(spark, path, TEXT_CACHE)) == {"k": "b", "l": "c"}
    assert read_cache(spark, path, TEXT_CACHE).count() == 2


def test_cache_keeps_the_last_by_an_order_column(spark, tmp_path):
    path, ordered = str(tmp_path / "cache"), "key string, value string, t int"
    for rows in ([("k", "a", 2), ("k", "b", 1), ("l", "x", 5)], [("k", "c", 3), ("l", "y", 4)]):
        append_cache(spark.createDataFrame(rows, ordered), path, TEXT_CACHE, "t")
    assert answers(read_cache(spark, path, TEXT_CACHE)) == {"k": "c", "l": "x"}


def test_plain_folders_become_logs(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("k", "a")], TEXT_CACHE).write.parquet(path)
    append_cache(spark.createDataFrame([("k", "z"), ("l", "c")], TEXT_CACHE), path, TEXT_CACHE)
    assert answers(read_cache(spark, path, TEXT_CACHE)) == {"k": "a", "l": "c"}


def test_a_hot_text_is_split_at_the_cache(spark, tmp_path):
    """The side with answers is stored, so AQE can split the partition of a text that a third of
    the rows have."""
    lowered = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in lowered}
    try:
        for k, v in lowered.items():
            spark.conf.set(k, v)
        df = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 'HOT', concat('T', id % 500)) AS t").repartition(8)
        cache = str(tmp_path / "cache")
        plans = []
        for frame in (df, df.union(df.selectExpr("id", "upper(concat(t, 'N')) AS t"))):
            rows, _ = X.resolve_text(frame, "t", failing, cache)
            rows.collect()
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # From one run, and from several, which an aggregate brings together.
    assert all("skew=true" in plan.lower() for plan in plans)


def test_mark_and_cache_decide_what_is_pending(spark):
    df = spark.createDataFrame([("OFICIAL [NOMBRE] SOLICITA",), ("DOLOR",)], "t string")
    empty = spark.createDataFrame([], TEXT_CACHE)
    assert [r["text"] for r in X.pending_texts(df, "t", empty, mark=R.NAME_MARK).collect()] == ["DOLOR"]
    from pyspark.sql import functions as F

    full = df.select(tx.content_key(F.col("t")).alias("key"))
    assert X.pending_texts(df, "t", full).count() == 0
