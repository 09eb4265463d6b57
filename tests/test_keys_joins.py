from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from casewell.functions import text as tx
from casewell.operators import joins as J
from casewell.operators import keys as K
from casewell.operators.audit import Reference, Required, Unique, integrity_report
from casewell.operators.ingest import ingest_rows
from casewell.session import staging_root


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ingest_fixture(spark):
    title = ["Intervenciones del SAME realizadas", None, None]
    header = ["Fecha y Hora", "Dirección"]
    data = [
        (1, 1, 1, title), (1, 1, 2, header), (1, 1, 3, ["1/1/2022 1:00", " A\n  B ", ""]), (1, 1, 4, []),
        (1, 2, 1, ["2/1/2022 1:00"] + [str(i) for i in range(12)]),
        (1, 2, 2, ["Intervenciones del SAME", "x"]), (2, 1, 1, header), (2, 1, 2, ["3/1/2022 1:00"]),
    ]
    df = spark.createDataFrame(data, "page int, table_no int, row_no int, cells array<string>")
    out = ingest_rows(df, row="fila").orderBy("page", "fila").collect()
    assert [(r["page"], r["fila"], r["fecha_hora"], r["direccion"], r["altura"]) for r in out] == [
        (1, 1, "1/1/2022 1:00", "A B", None), (1, 2, "2/1/2022 1:00", "0", "1"),
        (1, 3, "Intervenciones del SAME", "x", None), (2, 1, "3/1/2022 1:00", None, None),
    ]
    assert out[1]["movil"] == "8" and len(out[1]) == 12


@pytest.fixture(params=["true", "false"])
def cut(spark, request):
    """Once with few partitions, once with as many as there are."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield
    spark.conf.set(setting, before)


def test_number_rows_of_large_parts(spark, cut):
    random.seed(1)
    data = [
        (p, t, r) for p in (1, 2, 3) for t in (1, 2) for r in random.sample(range(-250, 250), 20 * p)
    ]
    df = spark.createDataFrame(random.sample(data, len(data)), "p int, t int, r int")
    out = K.number_rows(df, ["p"], ["t", "r"]).collect()
    expected = {}
    for p in (1, 2, 3):
        for i, key in enumerate(sorted(d for d in data if d[0] == p), start=1):
            expected[key] = i
    assert {(r["p"], r["t"], r["r"]): r["row_number"] for r in out} == expected
    assert len(out) == len(data)


def test_number_rows_keeps_rows_without_values(spark, cut):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 5)], "p int, r int")
    found = rows(K.number_rows(df, ["p"], ["r"]))
    assert found == [(1, 5, 2), (1, None, 1), (None, 1, 1), (None, 2, 2)]


def test_number_rows_of_one_giant_part(spark, cut):
    df = spark.range(0, 5000, numPartitions=7).select(F.lit(1).alias("p"), F.xxhash64("id").alias("r"))
    out = K.number_rows(df, ["p"], ["r"]).orderBy("row_number").collect()
    assert [r["row_number"] for r in out] == list(range(1, 5001))
    assert [r["r"] for r in out] == sorted(r["r"] for r in out)


def test_dense_ids(spark):
    df = spark.range(0, 5000, numPartitions=7).select(F.xxhash64("id").alias("h"))
    out = K.dense_ids(df, ["h"], start=11).orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(11, 5011))
    assert [r["h"] for r in out] == sorted(r["h"] for r in out)


def test_one_name_per_code(spark):
    labels = ["04 - B", "04 - A", "05 - C", None, "SIN"]
    df = spark.createDataFrame([(v,) for v in labels], "l string")
    dim = K.coded_dim(df, "l")
    assert rows(dim) == [("04", "A"), ("05", "C"), ("SIN", "SIN")]
    plan = dim._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" in plan  # labels are counted before the least name is taken


def test_insert_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string")
    assert rows(K.insert_missing(target, source, ["k"])) == [(1, "a"), (2, "b"), (3, "y")]
    once = K.upsert(target, source.filter("k = 2"), ["k"])
    assert rows(once) == [(1, "a"), (2, "x")]
    assert rows(K.upsert(once, source.filter("k = 2"), ["k"])) == [(1, "a"), (2, "x")]


def test_ids_continue_and_repeat(spark):
    target = spark.createDataFrame([(1, "b"), (7, "a")], "id long, name string")
    names = spark.createDataFrame([("c",), ("a",), ("d",), ("c",)], "name string")
    grown = K.insert_missing_with_ids(target, names, ["name"])
    assert rows(grown) == [(1, "b"), (7, "a"), (8, "c"), (9, "d")]
    assert rows(K.insert_missing_with_ids(grown, names, ["name"])) == rows(grown)


def test_links(spark):
    dim = spark.createDataFrame([(1, "A", 10), (2, "A", 0)], "id long, street string, no int")
    facts = spark.createDataFrame(
        [("A", " 10 "), ("A", "S/N"), ("B", "10"), (None, "10"), ("A", "0")], "street string, no string"
    )
    linked = K.link_by_pair(facts, dim, "street", "no", "id")
    assert {(r["street"], r["no"]): r["id"] for r in linked.collect()} == {
        ("A", " 10 "): 1, ("A", "S/N"): None, ("B", "10"): None, (None, "10"): None, ("A", "0"): 2,
    }
    coded = K.link_code(spark.createDataFrame([("4 - X",), (None,)], "l string"), "l", "code")
    assert rows(coded) == [("4 - X", "4"), (None, None)]


@pytest.fixture
def merged(spark):
    """No side is broadcast, and partitions of a few kilobytes count as skewed."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_key_is_split(spark, merged, tmp_path):
    hot = spark.range(60_000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) AS k", "sha2(cast(id as string), 256) AS x")
    hot.repartition(8).write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = spark.range(500).selectExpr("if(id = 0, 'hot', cast(id as string)) AS k", "id AS v")
    joined = J.lookup(left, right, "k")
    assert joined.agg({"v": "count", "id": "count"}).first()[1] == 60_000
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("column", ["map('a', id) AS m", "parse_json('1') AS m", "NULL AS m"])
def test_attach_takes_any_columns(spark, merged, column):
    left = spark.range(5).selectExpr("nullif(id, 3) AS k", column)
    for frame in (left, left.select("k")):
        got = J.attach(frame, spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string"), "k")
        assert sorted((r["k"], r["v"]) for r in got.select("k", "v").collect() if r["k"] is not None) == [
            (0, None), (1, "x"), (2, None), (4, None),
        ]
        assert got.filter("k IS NULL AND v IS NULL").count() == 1


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_hot_and_null_keys(spark, merged, how):
    keys = ["hot"] * 400 + ["warm"] * 50 + ["k1", "k2", "k3"] + [None] * 30
    left = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("warm", 3), ("k1", 4), ("other", 5)], "k string, v int"
    )
    got = J.lookup(left, right, "k", how).select("id", "k", "v")
    assert rows(got) == rows(left.join(right, "k", how).select("id", "k", "v"))


def test_lookup_on_two_keys(spark, merged):
    left = spark.createDataFrame(
        [(i, "a" if i < 90 else None, i % 3) for i in range(100)], "id int, k string, n int"
    )
    right = spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "k string, n int, v int")
    got = J.lookup(left, right, ["k", "n"]).select("id", "k", "n", "v")
    assert rows(got) == rows(left.join(right, ["k", "n"], "left").select("id", "k", "n", "v"))


def test_apply_mapping(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, t string")
    mapping = spark.createDataFrame([("a", "A"), ("c", "c")], "old string, new string")
    assert rows(J.apply_mapping(df, mapping, "t").select("id", "t", "changed")) == [
        (1, "A", True), (2, "b", False), (3, None, False), (4, "c", False),
    ]


def test_cache_misses_and_apply(spark):
    texts = spark.createDataFrame([("OFICIAL OJEDA",), ("DOLOR",)], "t string")
    keyed = texts.withColumn("key", tx.content_key(F.col("t")))
    cache = keyed.filter("t LIKE 'OF%'").select("key", F.lit("OFICIAL [NOMBRE]").alias("value"))
    assert [r["t"] for r in J.cache_misses(keyed, cache).collect()] == ["DOLOR"]
    applied = J.cache_apply(keyed, cache, "key", F.col("t"), "v")
    assert sorted(r["v"] for r in applied.collect()) == ["DOLOR", "OFICIAL [NOMBRE]"]


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, True, None), (2, None, True), (3, True, False), (4, True, True)], "id int, a boolean, b boolean"
    )
    assert [r["id"] for r in J.where_all(df, {"a": True, "b": False}).orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in J.present(df, "a", "b").orderBy("id").collect()] == [3, 4]
    assert J.keep_values(df, "id", [1, 9]).count() == 1
    assert [r["id"] for r in J.pending(df, "b").collect()] == [1]


def test_resolvable(spark):
    df = spark.createDataFrame([("A", 5), ("", 5), ("A", 0), (None, 5), ("A", None)], "s string, n int")
    fit, skipped = J.resolvable(df, "s", "n")
    assert rows(fit) == [("A", 5)]
    assert sorted(r["reason"] for r in skipped.collect()) == ["no_number"] * 2 + ["no_street"] * 2


def test_joins_keep_or_drop(spark):
    facts = spark.createDataFrame([(1, 1), (2, 9)], "id int, d int")
    dim = spark.createDataFrame([(1, 5.0)], "d int, v double")
    assert rows(J.attach(facts, dim, "d")) == [(1, 1, 5.0), (9, 2, None)]
    assert rows(J.require(facts, dim, "d")) == [(1, 1, 5.0)]
    assert rows(J.keep_all(facts, dim, "d")) == [(1, 1, 5.0), (9, 2, None)]
    merged = J.merge_indicator(facts, dim, "d")
    assert rows(merged) == [(1.0, 1.0, 5.0)] and {t for _, t in merged.dtypes} == {"double"}


def test_integrity(spark):
    a = spark.createDataFrame([(1, 1), (1, 9), (2, None)], "id int, b int")
    b = spark.createDataFrame([(1,)], "id int")
    rules = [Unique("a", ["id"]), Required("a", ["id", "b"]), Reference("a", "b", "b", "id")]
    report = integrity_report({"a": a, "b": b}, rules)
    assert [r["violations"] for r in report.collect()] == [1, 0, 1, 1]


class FakeContext:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class FakeSession:
    """A session as far as the staging folder needs one."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = FakeContext(master)


def test_staging_folder_is_the_cluster_setting(spark):
    assert staging_root(FakeSession("hdfs:///shared", "yarn")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_root(FakeSession(None, "yarn"))
    assert staging_root(spark) == staging_root(spark)


def test_located_counts_equal_joined_rows(spark):
    """Null and unknown keys, repeated facts, and keys that stand twice in a dimension."""
    facts = spark.createDataFrame(
        [(1, 10)] * 5 + [(1, 11), (2, 10), (None, 10), (2, None), (3, 12), (9, 10)], "place int, fact int"
    )
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, None), (3, 2.0, 2.0)], "place int, lat double, lon double")
    kinds = spark.createDataFrame([(10, "a"), (11, None), (12, "b"), (12, "c")], "fact int, kind string")
    found = J.located(facts, places, kinds, "place", "fact", ["lat", "lon"], "kind")
    plain = facts.join(places, "place").join(kinds, "fact").groupBy("lat", "lon", "kind").count()
    assert sorted(map(str, map(tuple, found.select("lat", "lon", "kind", "n").collect()))) == sorted(
        map(str, map(tuple, plain.collect()))
    )
