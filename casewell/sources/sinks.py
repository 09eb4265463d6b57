"""Writers and write modes. Tables are folders of numbered versions: a job writes a new
version from the ones it reads, and readers take the newest version that is complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.sources.keyed_log import KeyedLog


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; NULL and empty text stay apart."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_ordered(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Fixed columns in key order. The sort is range-partitioned, so written parts
    follow each other without being merged into one file."""
    return df.select(*dict.fromkeys([*cols, key])).orderBy(key).select(*cols)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions in a table folder."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS"))
    names = [m.getPath().getParent().getName() for m in (marks or [])]
    return sorted(int(n.split("=")[1]) for n in names)


def write_version(df: DataFrame, path: str) -> int:
    """Write the next version of a table; earlier versions stay readable meanwhile."""
    spark = df.sparkSession
    number = max(_versions(spark, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def read_current(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """The newest complete version, or the rows of a keyed log; with a schema, an absent table
    reads as empty."""
    log = KeyedLog.open(spark, path)
    if log is not None:
        return log.read(spark)
    versions = _versions(spark, path)
    if not versions:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/version={versions[-1]}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN has no place in the stored tables; it is written as NULL."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def refresh(df: DataFrame, path: str, dependents: Mapping[str, T.StructType]) -> None:
    """Replace a table, and empty the tables that hang on its ids first."""
    spark = df.sparkSession
    for dependent, schema in dependents.items():
        write_version(spark.createDataFrame([], schema), dependent)
    write_version(nan_to_null(df), path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there; one that can't be read is an error."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True
