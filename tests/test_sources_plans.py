from __future__ import annotations

import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.functions import text as tx
from casewell.plans import enrichment, findings
from casewell.plans import transform as P
from casewell.plans.flat import analysis_frame, flat_view
from casewell.sources import sinks
from casewell.sources.readers import read_page_rows, read_table, spread

# The resolvers of this file travel to the workers with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "línea")], "id int, t string")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert rows(back) == [("1", 'a "b", c'), ("2", None), ("3", "línea")]


def test_ordered_export(spark, tmp_path):
    df = spark.range(1000).select((999 - F.col("id")).alias("id"), F.col("id").alias("v")).repartition(5)
    out = sinks.export_ordered(df, ["v"], "id")
    assert out.columns == ["v"] and [r.v for r in out.collect()] == list(range(999, -1, -1))


def test_versions_and_refresh(spark, tmp_path):
    base, notes = str(tmp_path / "t"), str(tmp_path / "notes")
    schema = "id int, x double"
    assert sinks.read_current(spark, base, spark.createDataFrame([], schema).schema).count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, base)
    sinks.write_version(spark.createDataFrame([(1, 1.0)], "id int, x double"), notes)
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0), (3, None)], schema)
    sinks.refresh(df, base, {notes: df.schema})
    assert rows(sinks.read_current(spark, base)) == [(1, None), (2, 2.0), (3, None)]
    assert sinks.read_current(spark, notes).count() == 0
    # A table may be rewritten from itself, since the old version stays in place.
    sinks.write_version(sinks.read_current(spark, base).filter("id = 2"), base)
    assert rows(sinks.read_current(spark, base)) == [(2, 2.0)]


def test_unfinished_version_is_not_read(spark, tmp_path):
    base = str(tmp_path / "t")
    sinks.write_version(spark.range(3), base)
    (tmp_path / "t" / "version=2").mkdir()
    assert sinks.read_current(spark, base).count() == 3
    assert sinks.write_version(spark.range(5), base) == 2
    assert sinks.read_current(spark, base).count() == 5


def test_spread_only_narrow_scans(spark):
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 4
    wide = spark.range(10, numPartitions=6)
    assert spread(wide) is wide


def test_read_table_prunes_and_pushes(spark):
    df = read_table(spark, "/root/testdata/sf0.001/orders.parquet")
    plan = df.filter("o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def page(number, *records):
    title = ["Intervenciones del SAME realizadas", *[None] * 9]
    header = ["Fecha y Hora", "Dirección", *[""] * 8]
    return [
        (number, 1, i, cells) for i, cells in enumerate([title, header, *map(list, records)], start=1)
    ]


RECORDS = [
    ("11/5/2026 17:45", "ARTILLEROS", "2081", "COMISARIA", "MUJER EN COMISARIA 7A  LP 12 TEL 1122712171",
     "04 - TRAUMATISMO LEVE", "Si", "HOSPITAL B", "1 - ROJO", "M1"),
    ("1/1/2022 1:00", "ARTILLEROS", "2081", None, "HOMBRE DE 30 AÑOS", "04 - OTRO NOMBRE", "No",
     "HOSPITAL A", "6 - BAJO", "M2"),
    ("x", "GANA", "S/N", None, "OFICIO JUDICIAL", None, "", None, None, "M3"),
    ("2/1/2022 1:00", "GANA", "0", None, None, "SIN CODIGO", "No", None, "2 - AMARILLO", None),
]
RAW = "page int, table_no int, row_no int, cells array<string>"


def load(spark):
    return P.load_incidents(spark.createDataFrame(page(1, *RECORDS[:3]) + page(2, RECORDS[3]), RAW))


def test_pipeline_end_to_end_twice(spark, tmp_path):
    incidents = load(spark)
    assert [(r.id, r.pagina, r.fila) for r in incidents.orderBy("id").collect()] == [
        (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 1),
    ]
    root = str(tmp_path)
    linked = P.run_transform(incidents, root)
    keys = ["id", "diagnostico_codigo", "prioridad_codigo", "codigo_comisaria", "hospital_id", "ubicacion_id"]
    assert rows(linked.select(keys)) == [
        (1, "04", "1", "7A", 2, 1), (2, "04", "6", None, 1, 1), (3, None, None, None, None, None),
        (4, "SIN CODIGO", "2", None, None, 2),
    ]
    tables = {n: rows(sinks.read_current(spark, f"{root}/{n}", s)) for n, s in P.TABLES.items()}
    assert tables["dim_diagnostico"] == [("04", "OTRO NOMBRE"), ("SIN CODIGO", "SIN CODIGO")]
    assert tables["dim_prioridad"] == [("1", "ROJO"), ("2", "AMARILLO"), ("6", "BAJO")]
    assert tables["dim_hospital"] == [(1, "HOSPITAL A"), (2, "HOSPITAL B")]
    assert [r[:3] for r in tables["ubicaciones"]] == [(1, "ARTILLEROS", 2081), (2, "GANA", 0)]
    again = P.run_transform(load(spark), root)
    assert rows(again.select(keys)) == rows(linked.select(keys))
    assert {n: rows(sinks.read_current(spark, f"{root}/{n}", s)) for n, s in P.TABLES.items()} == tables

    places = sinks.read_current(spark, f"{root}/ubicaciones", P.LOCATIONS).withColumns(
        {"lat": F.when(F.col("id") == 1, -34.6), "lon": F.when(F.col("id") == 1, -58.4)}
    )
    notes = spark.createDataFrame(
        [(1, json.dumps({"sexo": "M", "autolesion": True})), (2, json.dumps({"sexo": "desconocido"}))],
        "intervencion_id long, atributos string",
    )
    view = {r.id: r for r in flat_view(linked, places, notes).collect()}
    assert len(view) == 4
    first, second, third, fourth = (view[i] for i in (1, 2, 3, 4))
    assert first.motivo == "MUJER EN COMISARIA 7A [LP] TEL [NUM]"
    assert (first.sexo, second.sexo, third.sexo, fourth.sexo) == ("M", "M", "desconocido", "desconocido")
    assert (second.edad, first.edad) == (30, None)
    assert [view[i].es_oficio_judicial for i in (1, 2, 3, 4)] == [False, True, True, None]
    assert [view[i].trasladado for i in (1, 2, 3, 4)] == [True, True, None, False]
    assert (first.lat, first.lon, fourth.lat) == (-34.6, -58.4, None)
    assert (first.autolesion, second.autolesion, third.autolesion) == (True, None, None)
    frame = analysis_frame(flat_view(linked, places, notes), notes, {"au": "autolesion"})
    found = {r.id: (r.au, r.trasladado, r.rojo, r.grupo_diagnostico) for r in frame.collect()}
    assert found == {1: (True, True, True, "trauma"), 2: (False, True, False, "trauma")}


def attribute_rule(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: json.dumps({"sexo": "F", "tipo_sujeto": "civil", "agresion_por_terceros": True})
        if "MUJER" in t
        else "no json"
    )


def name_rule(texts: pd.Series) -> pd.Series:
    return texts.str.replace("MUJER", "[NOMBRE]", regex=False)


def address_rule(places: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lat": -34.6, "lon": -58.4, "status": "ok"}, index=places.index)


def test_enrichment_flows(spark, tmp_path):
    incidents = load(spark)
    redacted, report = enrichment.redact_names(incidents, name_rule, str(tmp_path / "names"))
    assert report.first().asDict() == {"texts": 3, "changed": 1, "failed": 0, "failed_texts": 0}
    assert "[NOMBRE] EN COMISARIA 7A [LP] TEL [NUM]" in {r.motivo for r in redacted.collect()}

    stored = spark.createDataFrame(
        [(1, "{}", "old", "v0", None), (9, "{}", "old", "v0", None)],
        "intervencion_id long, atributos string, modelo string, prompt_version string, analizado_at timestamp_ntz",
    )
    notes = enrichment.enrich(
        incidents, stored, attribute_rule, str(tmp_path / "notes"), "rule", "2024-01-01 00:00:00"
    )
    found = {r.intervencion_id: (r.modelo, json.loads(r.atributos).get("sexo")) for r in notes.collect()}
    assert found == {1: ("rule", "F"), 2: ("rule", "desconocido"), 3: ("rule", "desconocido"), 9: ("old", None)}

    linked = P.run_transform(incidents, str(tmp_path / "root"))
    places = sinks.read_current(spark, str(tmp_path / "root" / "ubicaciones"), P.LOCATIONS)
    square = [[[[-58.5, -34.7], [-58.3, -34.7], [-58.3, -34.5], [-58.5, -34.5]]]]
    zones = spark.createDataFrame([(4, square)], "zone int, rings array<array<array<array<double>>>>")
    run = (address_rule, zones, str(tmp_path / "points"), "rule", "2024-01-01 00:00:00")
    placed = enrichment.locate(places, *run)
    assert placed.schema == places.schema
    assert {(r.id, r.lat, r.comuna, r.source) for r in placed.collect()} == {
        (1, -34.6, 4, "rule"), (2, None, None, None),
    }
    assert rows(enrichment.locate(placed, *run)) == rows(placed)

    view = flat_view(linked, placed, notes)
    table = findings.place_points(linked, placed, notes).collect()
    assert [(r.lat, r.lon, r.n) for r in table] == [(-34.6, -58.4, 2)]
    frame = analysis_frame(view, notes, findings.FLAGS)
    assert [tuple(r)[:3] for r in findings.needs_by_subject(frame).collect()] == [
        ("detenido", None, None), ("civil", 1, 100.0), ("personal_policial", None, None),
    ]
    assert [tuple(r) for r in findings.subject_counts(frame).collect()] == [
        ("personal_policial", 0), ("civil", 1), ("desconocido", 2), ("detenido", 0),
    ]
    assert findings.violence_by_setting(frame).count() == 2
    by_sex = {(r.scenario, r.sexo): r.rate for r in findings.transfer_by_sex(frame).collect()}
    assert by_sex[("crude", "F")] == 100.0 and len(by_sex) == 6
    assert [r.grupo_diagnostico for r in findings.transfer_by_diagnosis(frame).collect()] == R.DIAGNOSIS_ORDER
    assert findings.monthly(view).count() == 53
    indicator = spark.createDataFrame([(4, 10.0)], "zone int, indicator double")
    assert findings.volume_and_indicator(view, indicator).first().n == 1


def test_page_rows_reader(spark, tmp_path):
    path = tmp_path / "rows.json"
    records = [dict(zip(("page", "table_no", "row_no", "cells"), r, strict=True)) for r in page(1, *RECORDS)]
    path.write_text("\n".join(json.dumps(r) for r in records))
    loaded = P.load_incidents(read_page_rows(spark, str(path)))
    assert loaded.count() == 4 and loaded.filter("motivo LIKE '%[LP]%'").count() == 1


def test_new_values_continue_ids(spark, tmp_path):
    root = str(tmp_path)
    P.run_transform(load(spark), root)
    extra = RECORDS[0][:7] + ("HOSPITAL AA", "9 - NUEVO", "M9")
    more = P.load_incidents(spark.createDataFrame(page(1, *RECORDS, extra), RAW))
    P.run_transform(more, root)
    hospitals = sinks.read_current(spark, f"{root}/dim_hospital", P.NAMED)
    assert rows(hospitals) == [(1, "HOSPITAL A"), (2, "HOSPITAL B"), (3, "HOSPITAL AA")]


def test_fixed_values_are_whole():
    assert len(R.RECORD_COLUMNS) == 10 and len(R.CATEGORIES) == 4 and len(R.FLAGS) == 20
    assert set(R.VIEW_FLAGS) < set(R.FLAGS) and set(R.VIEW_CATEGORIES) < set(R.CATEGORIES)
    assert set(R.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert [r.name for r in tx.deidentify_rules()] == ["reference_id", "badge", "long_number", "blank_run"]
