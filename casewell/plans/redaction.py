"""De-identification of texts and rates of what it found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.functions import text as tx
from casewell.operators.joins import attach_unique
from casewell.operators.rates import rates


def redaction_by_group(texts: DataFrame, marks: DataFrame, key: str, col: str, by: str) -> DataFrame:
    """Share of texts that de-identification changes, and of flagged texts, per group.

    Texts are cleaned, de-identified and joined to their marks (`key`, `flagged`). Only
    the flag of a change goes into the join, not the text.
    """
    cleaned = texts.withColumn("_clean", tx.clean_text(F.col(col)))
    redacted = cleaned.withColumn("redacted", tx.deidentify(F.col("_clean")) != F.col("_clean"))
    joined = attach_unique(redacted.select(key, by, "redacted"), marks.select(key, "flagged"), key)
    return rates(joined, [by], ["redacted", "flagged"])
