"""Content-keyed enrichment of incidents and locations. Each flow may be run again: what
the caches or tables hold is not asked for a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.functions.text import content_key
from casewell.functions.values import attribute_default
from casewell.operators import resolve as X
from casewell.operators.geo import assign_zones
from casewell.operators.keys import upsert
from casewell.sources.caches import TEXT_CACHE, failures


def redact_names(
    incidents: DataFrame,
    resolver: X.TextResolver,
    cache: str,
    options: X.Options = X.Options(),
) -> tuple[DataFrame, DataFrame]:
    """Incidents without names in their text, and the counts of the run: texts, changed ones,
    and those whose calls failed so far, as rows and as distinct texts."""
    rows, _ = X.resolve_text(incidents, "motivo", resolver, cache, options)
    keys = incidents.select(content_key(F.col("motivo")).alias("key")).filter("key IS NOT NULL")
    # Counted by key first, so that the join meets each text once.
    texts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    unanswered = texts.join(failures(rows.sparkSession, cache, TEXT_CACHE).select("key"), "key", "left_semi")
    parts = [
        rows.agg(F.count("motivo").alias("texts"), F.count_if("changed").alias("changed")).withColumns(
            {"failed": F.lit(0), "failed_texts": F.lit(0)}
        ),
        unanswered.agg(F.sum("n").alias("failed"), F.count(F.lit(1)).alias("failed_texts")).select(
            F.lit(0).alias("texts"), F.lit(0).alias("changed"), "failed", "failed_texts"
        ),
    ]
    names = ("texts", "changed", "failed", "failed_texts")
    report = parts[0].unionByName(parts[1]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return rows.drop("changed"), report


def enrich(
    incidents: DataFrame,
    stored: DataFrame,
    resolver: X.TextResolver,
    cache: str,
    model: str,
    run_ts: str,
    version: str = R.ATTRIBUTE_VERSION,
    options: X.Options = X.Options(),
) -> DataFrame:
    """The stored attributes with those of this run in place of older ones."""
    default = attribute_default(R.CATEGORIES, R.FLAGS)
    fresh = X.resolve_attributes(
        incidents, "id", "motivo", resolver, cache, default, run_ts, model, version, options
    )
    named = fresh.select(
        F.col("id").alias("intervencion_id"),
        F.col("attributes").alias("atributos"),
        F.col("model").alias("modelo"),
        F.col("version").alias("prompt_version"),
        F.col("processed_at").alias("analizado_at"),
    )
    return upsert(stored, named, ["intervencion_id"])


def locate(
    locations: DataFrame,
    resolver: X.PointResolver,
    zones: DataFrame,
    cache: str,
    source: str,
    run_ts: str,
    cell: float = 0.01,
    options: X.Options = X.Options(),
) -> DataFrame:
    """Locations with points for those that had none, and zones for points without one."""
    kept = locations.filter(F.col("lat").isNotNull())
    unplaced = locations.filter(F.col("lat").isNull())
    bare = unplaced.drop("lat", "lon", "source", "located_at")
    found = X.resolve_points(
        bare, "direccion", "altura", resolver, cache, source, run_ts, options=options
    )
    placed = kept.unionByName(found.select(*locations.columns))
    named = zones.withColumn("zone", F.col("zone").cast("smallint"))
    rezoned = assign_zones(placed.withColumnRenamed("comuna", "zone"), named, "id", cell)
    return rezoned.withColumnRenamed("zone", "comuna").select(*locations.columns)
