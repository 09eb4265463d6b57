"""Raw page rows to typed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.functions import text as tx
from casewell.functions import values as vl
from casewell.operators.keys import number_rows


def ingest_rows(
    df: DataFrame,
    columns: Sequence[str] = R.RECORD_COLUMNS,
    header: str = R.HEADER_START,
    title: str = R.TITLE_TEXT,
    page: str = "page",
    order: Sequence[str] = ("table_no", "row_no"),
    row: str = "row",
) -> DataFrame:
    """Cleaned records of raw rows (`page`, order columns, `cells ARRAY<STRING>`).

    Empty and noise rows are dropped, long rows cut and short ones filled with NULL;
    the rows kept are numbered inside their page.
    """
    cells = F.col("cells")
    kept = df.filter((F.size(cells) > 0) & ~tx.is_noise_row(cells, header, title))
    # Numbered first: a sort by ranges computes its rows twice.
    raw = kept.select(page, *order, F.slice(cells, 1, len(columns)).alias("cells"))
    cleaned = [
        tx.clean_text(F.try_element_at(cells, F.lit(i))).alias(c)
        for i, c in enumerate(columns, start=1)
    ]
    return number_rows(raw, [page], list(order), row).select(*cleaned, page, row)


def typed_incidents(records: DataFrame) -> DataFrame:
    """Typed, de-identified incidents from cleaned records of the incident layout."""
    return records.withColumns(
        {
            "fecha_hora": vl.parse_dayfirst(F.col("fecha_hora")),
            "traslado": tx.parse_yes_no(F.col("traslado")),
            "motivo": tx.deidentify(F.col("motivo")),
        }
    )
