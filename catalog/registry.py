"""Names, callables and SQL texts of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewell.sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one data folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, *cols: str) -> DataFrame:
        """Columns of a table, its rows over all cores, for costly expressions."""
        return spread(getattr(self, name).select(*cols))

    def texts(self, *cols: str) -> DataFrame:
        return self.spread("documents", *cols)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of `Tables` under its own name, with its SQL text."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# Character classes and patterns for a regex engine without Unicode \s and \d.
WS = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = (
    "' ' || " + " || ".join(
        f"chr({c})"
        for c in [
            *range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
            0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ]
    )
)
REFERENCE_ID = rf"(?i)\[?[{WS}]*id\.?[{WS}]*remoto[{WS}]*:?[{WS}]*[\p{{Nd}}.\-]*\]?"
BADGE = rf"(?i)\b(?:L\.?[{WS}]?P\.?|LEGAJO)[{WS}]*\p{{Nd}}+"
LONG_NUMBER = r"\p{Nd}(?:[.\- ]*\p{Nd}){6,}"


def strip_sql(text: str) -> str:
    return f"trim({text}, {WS_CHARS})"


def deidentify_sql(text: str) -> str:
    text = f"regexp_replace({text}, '{REFERENCE_ID}', '', 'g')"
    text = f"regexp_replace({text}, '{BADGE}', '[LP]', 'g')"
    text = f"regexp_replace({text}, '{LONG_NUMBER}', '[NUM]', 'g')"
    return strip_sql(f"regexp_replace({text}, '[ \\t]{{2,}}', ' ', 'g')")
