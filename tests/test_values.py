from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell import rules as R
from casewell.functions import values as vl

C = F.col("c")


def test_dayfirst(column):
    values = ["11/5/2026 17:45", "05/11/2026 7:05", "31/2/2024 10:00", "5/13/2022 1:00", "x", None]
    assert column(values, vl.parse_dayfirst(C)) == [
        dt.datetime(2026, 5, 11, 17, 45), dt.datetime(2026, 11, 5, 7, 5), None, None, None, None,
    ]


def test_int_or_reject(spark):
    rows = [(v,) for v in ["0", "1850", " 12 ", "S/N", None, "12.5", ""]]
    accepted, rejected = vl.int_or_reject(spark.createDataFrame(rows, "n string"), "n")
    assert sorted(r[0] for r in accepted.collect()) == [0, 12, 1850]
    assert sorted(str(r[0]) for r in rejected.collect()) == ["", "12.5", "None", "S/N"]


@pytest.mark.parametrize(
    "flag, other, want",
    [(True, "h", True), (True, None, True), (False, "h", True), (False, None, False),
     (None, "h", True), (None, None, None)],
)
def test_flag_or_present(spark, flag, other, want):
    df = spark.createDataFrame([(flag, other)], "f boolean, o string")
    assert df.select(vl.flag_or_present(F.col("f"), F.col("o"))).first()[0] is want


def test_json(column):
    values = ['{"a": "x", "b": true}', '{"b": "false"}', "bad", None]
    assert column(values, vl.json_field(C, "$.a")) == ["x", None, None, None]
    assert column(values, vl.json_field(C, "$.b", "boolean")) == [True, False, None, None]


def test_parse_or_default(column):
    schema = vl.attribute_schema({"kind": ["none", "x"]}, ["on"])
    default = vl.attribute_default({"kind": ["none", "x"]}, ["on"])
    parsed = vl.parse_or_default(C, schema, default)
    values = ['{"kind": "zzz", "on": true}', "{}", "not json", None]
    assert [tuple(v) for v in column(values, parsed)] == [
        ("zzz", True), (None, None), ("none", False), ("none", False),
    ]


def test_domain_contract_has_24_attributes(spark):
    default = vl.attribute_default(R.CATEGORIES, R.FLAGS)
    assert len(default) == 24
    import json

    good = json.dumps(default)
    bad = json.dumps({**default, "sexo": "X", "embarazo": "true", "otra": 1})
    short = json.dumps({k: v for k, v in default.items() if k != "autolesion"})
    df = spark.createDataFrame([(good,), (bad,), (short,)], "a string")
    report = {r["field"]: (r["missing"], r["not_allowed"]) for r in
              vl.contract_report(df, "a", R.CATEGORIES, R.FLAGS).collect()}
    assert len(report) == 25
    wrong = {k: v for k, v in report.items() if v != (0, 0)}
    assert wrong == {"sexo": (0, 1), "embarazo": (0, 1), "autolesion": (1, 0), "*": (0, 1)}


def test_first_valid_point(spark):
    schema = "id int, p array<struct<x:string,y:string>>"
    rows = [
        (1, [(None, None), ("0", "1"), ("-58.5", "-34.6"), ("1", "2")]), (2, [("0", "0")]), (3, []),
        (4, None), (5, [None, ("", "1"), ("3", "4")]),
    ]
    df = spark.createDataFrame(rows, schema).select("id", vl.first_valid_point(F.col("p")).alias("v"))
    found = {r["id"]: tuple(r["v"]) if r["v"] else None for r in df.collect()}
    assert found == {1: (-34.6, -58.5), 2: None, 3: None, 4: None, 5: (4.0, 3.0)}


def test_box(spark):
    rows = [(-34.6472, -58.3748), (-34.7912, -58.5229), (-34.5077, -58.5064), (-34.71, -58.33), (None, 1.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    found = [r[0] for r in df.select(vl.in_box(F.col("lat"), F.col("lon"))).collect()]
    assert found[:4] == [True, False, False, True] and not found[4]


def test_point_needs_both(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "lon double, lat double")
    points = [r[0] for r in df.select(vl.point(F.col("lon"), F.col("lat"))).collect()]
    assert tuple(points[0]) == (1.0, 2.0) and points[1] is None


def test_stamp_repeats(spark):
    df = vl.stamp(spark.range(2), "2024-05-01 10:00:00", model="m", version="v")
    assert {tuple(r)[1:] for r in df.collect()} == {(dt.datetime(2024, 5, 1, 10), "m", "v")}


def test_date_range(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2022-01-05 00:00:00'), (TIMESTAMP_NTZ'2026-05-11 10:00:00'), (NULL) v(t)")
    assert tuple(vl.date_range(df, "t").first()) == ("2022-01", "2026-05")


def test_schema_of_attributes():
    assert isinstance(vl.attribute_schema(R.CATEGORIES, R.FLAGS)["embarazo"].dataType, T.BooleanType)
