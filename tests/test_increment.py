from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casewell.operators.ingest import ingest_rows
from casewell.plans import increment as I
from casewell.plans.flat import flat_view
from casewell.plans.transform import link_incidents

INCIDENTS = (
    "id long, fecha_hora timestamp_ntz, direccion string, altura string, motivo string, diagnostico string, "
    "traslado boolean, destino_traslado string, codigo_prioridad string, movil string, pagina long, fila long"
)
COUNTS = I.Counts({"sexo": "sexo", "comuna": "comuna"}, {"moved": "trasladado", "harm": "autolesion"})


def incident(i, street="CALLE 1", number="10", text="HOMBRE DE 30 AÑOS", moved=True, hospital="H1", label="1 - ROJO"):
    when = datetime(2024, 1, 1 + i % 28)
    return (i, when, street, number, text, "01 - TRAUMA", moved, hospital, label, "M1", 1, i)


def note(i, **values):
    return (i, json.dumps(values))


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def feed(spark, step, incidents, notes):
    given = spark.createDataFrame(incidents, INCIDENTS)
    attributes = spark.createDataFrame(notes, "intervencion_id long, atributos string")
    step.run(given, attributes)
    return given, attributes


def same_as_full(spark, step, given, attributes):
    """The stored view and counts against those of all rows together."""
    dims = {n: step.dimension(n).read(spark) for n in I.DIMENSIONS}
    full = flat_view(link_incidents(given, dims), dims["ubicaciones"], attributes)
    assert rows(step.view(spark)) == rows(full)
    assert rows(step.current_counts(spark)) == rows(step.counts.merged(step.counts.of(full)))


FIRST = [incident(1), incident(2, "CALLE 2", "S/N"), incident(3, hospital=None, moved=None), incident(4, text=None)]
NOTES = [note(1, autolesion=True), note(3, autolesion=False), note(9, autolesion=True)]


def test_insert_change_delete(spark, tmp_path):
    step = I.Increment(str(tmp_path), COUNTS)
    with pytest.raises(FileNotFoundError):
        step.current_counts(spark)
    feed(spark, step, [], [])
    assert step.current_counts(spark).count() == 0
    same_as_full(spark, step, *feed(spark, step, FIRST, NOTES))
    ids = {r.name: r.id for r in step.dimension("dim_hospital").read(spark).collect()}
    second = [incident(1, hospital="A1"), FIRST[1], FIRST[3], incident(5, "CALLE 5", "7", text="MUJER"), incident(9)]
    same_as_full(spark, step, *feed(spark, step, second, [note(1, autolesion=False), note(4, autolesion=True), NOTES[2]]))
    later = {r.name: r.id for r in step.dimension("dim_hospital").read(spark).collect()}
    assert later["H1"] == ids["H1"] and later["A1"] == max(later.values())
    feed(spark, step, [], [])
    assert step.view(spark).count() == 0 and step.current_counts(spark).count() == 0


def test_only_what_changed_is_written(spark, tmp_path):
    step = I.Increment(str(tmp_path), COUNTS)
    given, attributes = feed(spark, step, FIRST, NOTES)
    step.run(given, attributes)
    for part in ("incidents", "attributes", "places", "view", "change"):
        assert spark.read.parquet(step._step(1, part)).count() == 0
    # A located place reaches the rows that point to it.
    log = step.dimension("ubicaciones")
    found = log.read(spark).withColumn("lat", F.lit(-34.6)).withColumn("comuna", F.lit(3).cast("short"))
    log.append(found, unique=True)
    step.run(given, attributes)
    assert spark.read.parquet(step._step(2, "incidents")).count() == 0
    assert spark.read.parquet(step._step(2, "view")).count() == 3
    assert step.view(spark).filter("comuna = 3 AND lat = -34.6").count() == 3
    same_as_full(spark, step, given, attributes)
    with pytest.raises(ValueError):
        I.Increment(str(tmp_path), I.Counts({"sexo": "sexo"})).run(given, attributes)


@pytest.mark.parametrize("where", ["change", "digests-attr"])
def test_a_killed_run_is_carried_out(spark, tmp_path, monkeypatch, where):
    """Killed before its plan stands, or amid the writes after it: the next run, which sees yet
    another snapshot, ends in the tables of a full run."""
    step = I.Increment(str(tmp_path), COUNTS)
    feed(spark, step, FIRST, NOTES)
    second = [incident(1, hospital="A1"), incident(7, "CALLE 7", "1"), FIRST[3]]

    class Killed(Exception):
        pass

    write, append = I.Increment._write_counts, I.KeyedLog.append

    def killed(real, at):
        def run(*args, **kwargs):
            if at(*args):
                raise Killed
            return real(*args, **kwargs)

        return run

    with monkeypatch.context() as m:
        m.setattr(I.Increment, "_write_counts", killed(write, lambda s, c, n, part: part == where))
        m.setattr(I.KeyedLog, "append", killed(append, lambda log, *_: where in log.path))
        with pytest.raises(Killed):
            feed(spark, step, second, NOTES[:1])
    same_as_full(spark, step, *feed(spark, step, [second[0], second[1], incident(8, text="MUJER")], NOTES))


def test_ids_stay_with_their_place(spark, tmp_path):
    step = I.Increment(str(tmp_path), COUNTS)

    def raw(*places):
        cells = ["1/2/2024 7:05", "CALLE 1", "10", None, "HOMBRE", "1 - X", "Si", "H1", "1 - R", "M1"]
        data = [(page, 1, row, cells) for page, row in places]
        return spark.createDataFrame(data, "page int, table_no int, row_no int, cells array<string>")

    first = {(r.pagina, r.fila): r.id for r in step.number(raw((2, 1), (2, 2), (4, 1))).collect()}
    assert first == {(2, 1): 1, (2, 2): 2, (4, 1): 3}
    later = {(r.pagina, r.fila): r.id for r in step.number(raw((1, 1), (2, 1), (4, 1), (4, 2))).collect()}
    assert later == {(1, 1): 4, (2, 1): 1, (4, 1): 3, (4, 2): 5}


def test_work_of_a_run_grows_with_its_rows_once(spark, tmp_path):
    """Numbered incidents are stored, not joined again by each reader; rows are numbered where they
    lie; and logs that are never asked for missing keys write no filter."""
    step = I.Increment(str(tmp_path), COUNTS)
    cells = ["1/2/2024 7:05", "CALLE 1", "10", None, "HOMBRE", "1 - X", "Si", "H1", "1 - R", "M1"]
    raw = spark.createDataFrame([(1, 1, i, cells) for i in range(3)], "page int, table_no int, row_no int, cells array<string>")
    plan = step.number(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    plan = ingest_rows(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert [log.filter_from for log in (step._digest_log("incidents", "id"), step._view_log(raw.schema))] == [None, None]
    empty = step.dimension("dim_hospital").read(spark)
    joined = spark.range(3).join(empty, "id", "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in joined


def test_digests_tell_null_and_microseconds(spark):
    df = spark.sql("""
        SELECT 1 AS id, 'a' AS x, CAST(NULL AS string) AS y, timestamp_ntz'2024-01-01 00:00:00.000001' AS t
        UNION ALL SELECT 2, NULL, 'a', timestamp_ntz'2024-01-01 00:00:00.000001'
        UNION ALL SELECT 3, 'a', NULL, timestamp_ntz'2024-01-01 00:00:00.000002'""")
    assert I.digests(df, "id").select("digest").distinct().count() == 3
