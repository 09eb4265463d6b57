"""Fixed values of the incident domain: names, patterns, word lists and limits.

Every operator takes these as parameters; this module is one configuration.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A replacement. `needs` is lower-case text that every match holds, if there is one:
    a plain search for it spares most texts the pattern."""

    name: str
    pattern: str
    replacement: str
    needs: str | None = None


# --- Fixed values: page tables -------------------------------------------------------
RECORD_COLUMNS = [
    "fecha_hora",
    "direccion",
    "altura",
    "dependencia",
    "motivo",
    "diagnostico",
    "traslado",
    "destino_traslado",
    "codigo_prioridad",
    "movil",
]
HEADER_START = "fecha y hora"
TITLE_TEXT = "intervenciones del same"
DAYFIRST_FORMAT = "d/M/yyyy H:mm"

# --- Fixed values: de-identification, in this order ----------------------------------
# All whitespace that a Unicode-aware strip removes, \x1c-\x1f included.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
NON_SPACE = r"(?U)[^\s\x1c-\x1f]"
REFERENCE_ID = r"(?iU)\[?[\s\x1c-\x1f]*id\.?[\s\x1c-\x1f]*remoto[\s\x1c-\x1f]*:?[\s\x1c-\x1f]*[\d.\-]*\]?"
BADGE_NUMBER = r"(?=[lL])(?iU)\b(?:L\.?[\s\x1c-\x1f]?P\.?|LEGAJO)[\s\x1c-\x1f]*\d+"
BLANK_RUN = r"[ \t]{2,}"
MIN_DIGITS = 7
BADGE_MARK = "[LP]"
NUMBER_MARK = "[NUM]"
NAME_MARK = "[NOMBRE]"

# --- Fixed values: coded labels and flags --------------------------------------------
LABEL_SEPARATOR = " - "
LABEL_PREFIX = r"^[0-9]+ - "
PRECINCT_CODE = r"COMISAR[IÍ]A[ ]*([0-9]{1,2}[A-Z]?)"
AGE = r"([0-9]{1,3}) ?A[ÑN]OS"
COURT_ORDER_PREFIX = "6 "
COURT_ORDER_PHRASE = "OFICIO JUDICIAL"
RED_CODES = "14"
FEMALE_MARKERS = (
    r"FEMENIN|\bFEM\b|MUJER|\bINTERNA\b|\bDETENIDA\b|SE[ÑN]ORA|EMBARAZ|GESTAN|\bLA MISMA\b"
)
MALE_MARKERS = (
    r"MASCULIN|\bMASC\b|HOMBRE|VAR[OÓ]N|\bINTERNO\b|\bDETENIDO\b|PREVENIDO|\bEL MISMO\b"
)
NAME_CANDIDATE = r"DE NOMBRE|\bSRA?\.?\b|\bOFICIAL\b|\bAGENTE\b|\bLP \d"
DIAGNOSIS_GROUPS = {
    "01": "trauma",
    "03": "trauma",
    "04": "trauma",
    "08": "trauma",
    "18": "psiq",
    "10": "cardiovascular",
    "11": "resp",
    "15": "neuro",
}
DIAGNOSIS_DEFAULT = "otros/clínico"
DIAGNOSIS_MISSING = "00"
DIAGNOSIS_ORDER = ["trauma", "psiq", "otros/clínico", "cardiovascular"]

# --- Fixed values: attribute contract, first category is the default -----------------
ATTRIBUTE_VERSION = "vars-v2"
CATEGORIES = {
    "sexo": ["desconocido", "M", "F"],
    "tipo_sujeto": ["desconocido", "detenido", "personal_policial", "civil"],
    "tipo_dependencia": [
        "desconocido", "comisaria", "alcaidia", "unidad_penitenciaria", "otra",
    ],
    "quien_solicita": [
        "desconocido", "alcaidia", "personal_policial", "jefe_servicio", "paciente", "tercero",
    ],
}
FLAGS = [
    "violencia_genero",
    "autolesion",
    "intento_suicidio",
    "agresion_por_terceros",
    "arma_blanca",
    "arma_de_fuego",
    "intoxicacion_sustancias",
    "crisis_psiquiatrica",
    "convulsiones",
    "perdida_de_conocimiento",
    "huelga_de_hambre",
    "embarazo",
    "menor_de_edad",
    "multiples_pacientes",
    "ingesta_cuerpo_extrano",
    "fallecimiento",
    "motin_o_conflicto_colectivo",
    "negativa_del_paciente",
    "condicion_cronica",
    "episodio_previo_mencionado",
]
VIEW_CATEGORIES = ["tipo_sujeto", "tipo_dependencia", "quien_solicita"]
VIEW_FLAGS = [
    "violencia_genero",
    "autolesion",
    "agresion_por_terceros",
    "crisis_psiquiatrica",
    "ingesta_cuerpo_extrano",
    "fallecimiento",
]

# Attributes that stay out of public reports.
SENSITIVE_FLAGS = ["autolesion", "intento_suicidio", "ingesta_cuerpo_extrano"]

# --- Fixed values: geography ---------------------------------------------------------
CITY_BOX = {"lat": (-34.71, -34.52), "lon": (-58.54, -58.33)}
SRID = 4326
