"""The flat view: one typed row per incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.functions import text as tx
from casewell.functions import values as vl
from casewell.operators.joins import attach, attach_unique

RECORD_FIELDS = [
    "id", "fecha_hora", "direccion", "altura", "motivo", "diagnostico", "traslado",
    "destino_traslado", "codigo_prioridad", "movil", "pagina", "fila", "codigo_comisaria",
]


def flat_view(
    incidents: DataFrame, locations: DataFrame, attributes: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Incidents with their location and attributes, where they have them, and with the
    columns derived from text.

    `locations` has `id, lat, lon, comuna`; `attributes` has `intervencion_id, atributos`
    (JSON text). Joins come last and carry no column the view does not show. `ubicacion_id` comes
    along at the end if `keep` names it.
    """
    motivo, priority = F.col("motivo"), F.col("codigo_prioridad")
    derived = incidents.select(
        *RECORD_FIELDS,
        "ubicacion_id",
        tx.first_int(motivo, R.AGE).alias("edad"),
        tx.prefix_or_phrase(
            priority, motivo, R.COURT_ORDER_PREFIX, R.COURT_ORDER_PHRASE
        ).alias("es_oficio_judicial"),
        vl.flag_or_present(F.col("traslado"), F.col("destino_traslado")).alias("trasladado"),
    )
    places = locations.select(F.col("id").alias("ubicacion_id"), "lat", "lon", "comuna")
    fields = ["sexo", *R.VIEW_CATEGORIES, *R.VIEW_FLAGS]
    notes = attributes.select(
        F.col("intervencion_id").alias("id"), vl.json_texts("atributos", fields).alias("a")
    )
    joined = attach_unique(attach(derived, places, "ubicacion_id"), notes, "id")
    sex = tx.marker_class(
        motivo,
        F.col("a.sexo"),
        {"F": R.FEMALE_MARKERS, "M": R.MALE_MARKERS},
        R.CATEGORIES["sexo"][0],
    )
    return joined.select(
        *RECORD_FIELDS,
        "edad",
        "es_oficio_judicial",
        "trasladado",
        "lat",
        "lon",
        "comuna",
        sex.alias("sexo"),
        *[F.col(f"a.{c}") for c in R.VIEW_CATEGORIES],
        *[F.col(f"a.{b}").try_cast("boolean").alias(b) for b in R.VIEW_FLAGS],
        *keep,
    )


def analysis_frame(view: DataFrame, attributes: DataFrame, flags: dict[str, str]) -> DataFrame:
    """View rows that have attributes, with further flags (`alias -> attribute`) read from
    them, NULL flags as false, and the severity flag `rojo`."""
    notes = attributes.select(
        F.col("intervencion_id").alias("id"),
        vl.json_texts("atributos", list(flags.values())).alias("_notes"),
    )
    rows = view.join(notes, "id")
    read = {
        alias: vl.null_to_false(F.col(f"_notes.{name}").try_cast("boolean"))
        for alias, name in flags.items()
    }
    return rows.withColumns(
        {
            **read,
            "trasladado": vl.null_to_false(F.col("trasladado")),
            "rojo": tx.has_prefix(F.col("codigo_prioridad"), R.RED_CODES),
            "grupo_diagnostico": tx.code_group(
                F.col("diagnostico"), R.DIAGNOSIS_GROUPS, R.DIAGNOSIS_DEFAULT
            ),
        }
    ).drop("_notes")
