"""Date, number, boolean, JSON and array functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell import rules as R


def parse_dayfirst(col: Column, fmt: str = R.DAYFIRST_FORMAT) -> Column:
    """Day-first text to a timestamp without zone; impossible dates and bad text to NULL."""
    return F.try_to_timestamp(col, F.lit(fmt)).cast("timestamp_ntz")


def int_or_null(col: Column) -> Column:
    return F.trim(col).try_cast("int")


def int_or_reject(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is an integer (converted), and the rejected rows (unchanged)."""
    number = int_or_null(F.col(col))
    return (
        df.filter(number.isNotNull()).withColumn(col, number),
        df.filter(number.isNull()),
    )


def flag_or_present(flag: Column, other: Column) -> Column:
    """`flag OR other IS NOT NULL`: a NULL flag with no other value stays NULL."""
    return flag | other.isNotNull()


def null_to_false(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def json_field(col: Column, path: str, dtype: str = "string") -> Column:
    """One field of a JSON text as text or as another type; bad JSON gives NULL."""
    text = F.get_json_object(col, path)
    return text if dtype == "string" else text.try_cast(dtype)


def json_texts(col: str, fields: Sequence[str]) -> Column:
    """Several fields of a JSON text as a struct of texts, from one parse."""
    return F.from_json(col, T.StructType([T.StructField(f, T.StringType()) for f in fields]))


def parse_or_default(col: Column, schema: T.StructType, default: Mapping[str, object]) -> Column:
    """Object from JSON text; the default object when the text is not JSON."""
    fallback = F.struct(
        *[F.lit(default[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    return F.when(F.try_parse_json(col).isNull(), fallback).otherwise(F.from_json(col, schema))


def attribute_schema(categories: Mapping[str, Sequence[str]], flags: Sequence[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in categories]
        + [T.StructField(b, T.BooleanType()) for b in flags]
    )


def attribute_default(
    categories: Mapping[str, Sequence[str]], flags: Sequence[str]
) -> dict[str, object]:
    return {**{c: values[0] for c, values in categories.items()}, **dict.fromkeys(flags, False)}


def contract_report(
    df: DataFrame, col: str, categories: Mapping[str, Sequence[str]], flags: Sequence[str]
) -> DataFrame:
    """Violations of the attribute contract, one row per field, from one scan.

    Counts rows where a required field is absent, where a category is outside its list or
    a flag is no boolean, and (field `*`) where the object has fields beyond the contract.
    """
    fields = [*categories, *flags]
    known = F.array(*[F.lit(f) for f in fields])
    parsed = df.select(F.col(col).alias("text"), F.try_parse_json(col).alias("object"))

    def row(field: str, missing: Column, not_allowed: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            missing.cast("bigint").alias("missing"),
            F.count_if(not_allowed).alias("not_allowed"),
        )

    reports = []
    for field in fields:
        value = F.try_variant_get("object", f"$.{field}", "variant")
        kind = F.schema_of_variant(value)
        if field in categories:
            text = F.try_variant_get("object", f"$.{field}", "string")
            wrong = (kind != "STRING") | ~text.isin(*categories[field])
        else:
            wrong = kind != "BOOLEAN"
        reports.append(row(field, F.count_if(value.isNull()), wrong))
    extra = F.size(F.array_except(F.json_object_keys("text"), known)) > 0
    reports.append(row("*", F.lit(0), extra))
    return parsed.agg(F.array(*reports).alias("report")).select(F.inline("report"))


def first_valid_point(points: Column, x: str = "x", y: str = "y") -> Column:
    """(lat, lon) of the first element with both coordinates present and non-zero.

    Elements are structs of numbers or of numeric text. NULL when there is none.
    """

    def present(value: Column) -> Column:
        return F.coalesce(value.try_cast("double") != 0, F.lit(False))

    hit = F.try_element_at(F.filter(points, lambda p: present(p[x]) & present(p[y])), F.lit(1))
    return F.when(
        hit.isNotNull(),
        F.struct(hit[y].try_cast("double").alias("lat"), hit[x].try_cast("double").alias("lon")),
    )


def in_box(lat: Column, lon: Column, box: Mapping[str, tuple[float, float]] = R.CITY_BOX) -> Column:
    """Bounding-box test, both ends included."""
    return lat.between(*box["lat"]) & lon.between(*box["lon"])


def point(lon: Column, lat: Column) -> Column:
    """Point struct, NULL when a coordinate is missing."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def date_range(df: DataFrame, col: str, fmt: str = "yyyy-MM") -> DataFrame:
    return df.agg(
        F.date_format(F.min(col), fmt).alias("first_period"),
        F.date_format(F.max(col), fmt).alias("last_period"),
    )


def stamp(df: DataFrame, run_ts: str, **labels: str) -> DataFrame:
    """Processing time and labels, given by the caller so that re-runs give equal rows."""
    stamped = df.withColumn("processed_at", F.lit(run_ts).cast("timestamp_ntz"))
    return stamped.withColumns({name: F.lit(value) for name, value in labels.items()})


def any_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, [null_to_false(f) for f in flags])
