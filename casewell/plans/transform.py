"""The relational transform: dimensions, locations and keys of the incidents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell import rules as R
from casewell.functions import text as tx
from casewell.functions import values as vl
from casewell.operators import keys as K
from casewell.operators.ingest import ingest_rows, typed_incidents
from casewell.sources.sinks import read_current, write_version

CODED = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("name", T.StringType())]
)
NAMED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]
)
LOCATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("direccion", T.StringType()),
        T.StructField("altura", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("located_at", T.TimestampNTZType()),
        T.StructField("comuna", T.ShortType()),
    ]
)
TABLES = {
    "dim_diagnostico": CODED,
    "dim_prioridad": CODED,
    "dim_hospital": NAMED,
    "ubicaciones": LOCATIONS,
}


def load_incidents(raw_rows: DataFrame) -> DataFrame:
    """Incidents with ids in page order from raw page rows."""
    typed = typed_incidents(ingest_rows(raw_rows, page="page", row="fila"))
    return K.dense_ids(typed.withColumnRenamed("page", "pagina"), ["pagina", "fila"])


def grow_dimensions(incidents: DataFrame, dims: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every dimension with the incidents' new values added; rows in it stay as they are."""
    numbers = F.col("altura")
    places = incidents.select("direccion", vl.int_or_null(numbers).alias("altura")).dropna()
    names = incidents.select(F.col("destino_traslado").alias("name")).dropna()
    return {
        "dim_diagnostico": K.insert_missing(
            dims["dim_diagnostico"], K.coded_dim(incidents, "diagnostico"), ["code"]
        ),
        "dim_prioridad": K.insert_missing(
            dims["dim_prioridad"], K.coded_dim(incidents, "codigo_prioridad"), ["code"]
        ),
        "dim_hospital": K.insert_missing_with_ids(dims["dim_hospital"], names, ["name"]),
        "ubicaciones": K.insert_missing_with_ids(
            dims["ubicaciones"], places, ["direccion", "altura"]
        ),
    }


def link_incidents(incidents: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Incidents with codes and ids of their dimensions; all keys are computed anew."""
    coded = incidents.withColumns(
        {
            "diagnostico_codigo": tx.label_code(F.col("diagnostico")),
            "prioridad_codigo": tx.label_code(F.col("codigo_prioridad")),
            "codigo_comisaria": tx.first_group(F.col("motivo"), R.PRECINCT_CODE),
        }
    )
    hospitals = dims["dim_hospital"].withColumnRenamed("id", "hospital_id")
    named = K.link_by_name(coded, hospitals, "destino_traslado", "name", "hospital_id")
    places = dims["ubicaciones"].withColumnRenamed("id", "ubicacion_id")
    return K.link_by_pair(named, places, "direccion", "altura", "ubicacion_id")


def run_transform(incidents: DataFrame, root: str) -> DataFrame:
    """Grow the dimension tables under `root` and link the incidents to them.

    A second run over equal incidents adds nothing and gives equal keys.
    """
    spark = incidents.sparkSession
    dims = {n: read_current(spark, f"{root}/{n}", s) for n, s in TABLES.items()}
    for name, rows in grow_dimensions(incidents, dims).items():
        write_version(rows, f"{root}/{name}")
    grown = {n: read_current(spark, f"{root}/{n}", s) for n, s in TABLES.items()}
    return link_incidents(incidents, grown)
