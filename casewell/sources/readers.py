"""Table, GeoJSON and CSV readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOTAL_ROW = "total"

RING = T.ArrayType(T.ArrayType(T.DoubleType()))
POLYGON = T.ArrayType(RING)
MULTIPOLYGON = T.ArrayType(POLYGON)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; filters and column choices of the caller reach the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, for costly expressions on few or unsplittable files.

    A scan that already has a partition per core, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """A database table, read in parallel ranges of an integer column when one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds and partitions:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


PAGE_ROWS = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("table_no", T.IntegerType()),
        T.StructField("row_no", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)


def read_page_rows(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Decoded page tables, one row of cells per record, as JSON lines or Parquet."""
    return spark.read.schema(PAGE_ROWS).format(form).load(path)


def zones_from_geojson(documents: DataFrame, col: str, zone: str, name: str) -> DataFrame:
    """FeatureCollection texts to `(zone SMALLINT, name, rings)` with MultiPolygon rings.

    Coordinates are first taken as text, since the nesting depth depends on the geometry
    type. The zone id may be a number or numeric text with decimals.
    """
    feature = T.StructType(
        [
            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField(
                "geometry",
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("coordinates", T.StringType()),
                    ]
                ),
            ),
        ]
    )
    collection = T.StructType([T.StructField("features", T.ArrayType(feature))])
    features = documents.select(F.explode(F.from_json(col, collection)["features"]).alias("f"))
    coordinates = F.col("f.geometry.coordinates")
    rings = F.when(
        F.col("f.geometry.type") == "Polygon", F.array(F.from_json(coordinates, POLYGON))
    ).when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(coordinates, MULTIPOLYGON))
    zone_id = F.element_at("f.properties", zone).cast("double").cast("int").cast("smallint")
    zones = features.select(
        zone_id.alias("zone"),
        F.element_at("f.properties", name).alias("name"),
        rings.alias("rings"),
    )
    # A zone id that comes twice keeps one row, as an insert-if-absent would.
    return zones.groupBy("zone").agg(
        F.min_by(F.struct("name", "rings"), F.struct("name", F.to_json("rings"))).alias("z")
    ).select("zone", "z.name", "z.rings")


def read_geojson(
    spark: SparkSession, path: str, zone: str = "comuna", name: str = "barrios"
) -> DataFrame:
    return zones_from_geojson(spark.read.text(path, wholetext=True), "value", zone, name)


def read_indicator_csv(
    spark: SparkSession,
    path: str,
    zone: str = "Comuna",
    value: str = "Hogares con NBI",
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """`(zone INT, indicator DOUBLE)` of a CSV file, without its total row."""
    raw = spark.read.option("encoding", encoding).option("header", True).csv(path)
    return raw.filter(F.col(zone) != TOTAL_ROW).select(
        F.col(zone).cast("int").alias("zone"), F.col(value).cast("double").alias("indicator")
    )
