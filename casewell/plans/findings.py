"""The study's tables, from the rows of `flat.analysis_frame` with the flags `FLAGS`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.functions.values import json_field
from casewell.operators import rates as Q
from casewell.operators.joins import keep_values, located, merge_indicator
from casewell.operators.series import monthly_series
from casewell.operators.stats import pearson

# Short names of the attributes that the tables use.
FLAGS = {
    "ag": "agresion_por_terceros",
    "mo": "motin_o_conflicto_colectivo",
    "cr": "crisis_psiquiatrica",
    "cro": "condicion_cronica",
    "emb": "embarazo",
}
SUBJECTS = ["detenido", "civil", "personal_policial"]
SUBJECT_BARS = ["personal_policial", "civil", "desconocido", "detenido"]
SETTINGS = ["alcaidia", "comisaria"]
SEXES = ["M", "F"]


def ordered_rates(
    rows: DataFrame, by: str, values: Sequence[str], flags: Sequence[str]
) -> DataFrame:
    return Q.in_order(Q.rates(keep_values(rows, by, values), [by], flags), by, values)


def subject_counts(rows: DataFrame) -> DataFrame:
    return Q.value_counts(rows, "tipo_sujeto", SUBJECT_BARS)


def needs_by_subject(rows: DataFrame) -> DataFrame:
    return ordered_rates(rows, "tipo_sujeto", SUBJECTS, ["ag", "cr", "cro"])


def violence_by_setting(rows: DataFrame) -> DataFrame:
    return ordered_rates(rows, "tipo_dependencia", SETTINGS, ["ag", "mo"])


def transfer_by_sex(rows: DataFrame) -> DataFrame:
    """Transfer rate by sex: crude, without pregnancies, and of these the severe ones."""
    no_pregnancy = ~F.col("emb")
    conditions = {
        "crude": F.lit(True),
        "without pregnancy": no_pregnancy,
        "severe, without pregnancy": F.col("rojo") & no_pregnancy,
    }
    found = Q.scenarios(keep_values(rows, "sexo", SEXES), conditions, "sexo", "trasladado")
    return Q.rate_or_zero(found, "sexo", list(conditions), SEXES)


def transfer_by_diagnosis(rows: DataFrame) -> DataFrame:
    kept = keep_values(rows, "sexo", SEXES).filter(~F.col("emb"))
    return Q.rate_pivot(
        kept, "grupo_diagnostico", "sexo", "trasladado", R.DIAGNOSIS_ORDER, SEXES
    )


def place_points(incidents: DataFrame, locations: DataFrame, attributes: DataFrame) -> DataFrame:
    """Incidents and most frequent kind of place per point."""
    facts = incidents.select("id", "ubicacion_id")
    places = locations.select(F.col("id").alias("ubicacion_id"), "lat", "lon")
    kinds = attributes.select(
        F.col("intervencion_id").alias("id"),
        json_field(F.col("atributos"), "$.tipo_dependencia").alias("kind"),
    )
    counted = located(facts, places, kinds, "ubicacion_id", "id", ["lat", "lon"], "kind")
    return Q.points(counted, "lat", "lon", "kind", weight="n")


def volume_and_indicator(
    view: DataFrame, indicator: DataFrame, outlier: int | None = None
) -> DataFrame:
    """Correlation of incidents per zone with the zone's indicator."""
    volume = Q.counts(view.filter(F.col("comuna").isNotNull()), "comuna")
    named = indicator.select(F.col("zone").alias("comuna"), "indicator")
    exclude = {} if outlier is None else {"without outlier": F.col("comuna") == outlier}
    return pearson(merge_indicator(volume, named, "comuna"), "indicator", "n", exclude)


def monthly(view: DataFrame) -> DataFrame:
    return monthly_series(view, "fecha_hora")
