"""Queries of stored tables: logs that grow by batches, caches, exports, refreshed versions, reruns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.functions import text as tx
from casewell.operators import joins as J
from casewell.plans.increment import Counts, Increment
from casewell.plans.transform import load_incidents, run_transform
from casewell.session import staging_root
from casewell.sources import sinks
from casewell.sources.caches import TEXT_CACHE, append_cache, read_cache
from casewell.sources.keyed_log import KeyedLog
from catalog.dims import LINKED_SQL, page_rows
from catalog.registry import Tables, query

KINDS = ["purchase", "click", "view"]


def folder(t: Tables, label: str) -> str:
    return f"{staging_root(t.spark)}/{label}-{uuid.uuid4().hex}"


def event_batches(t: Tables) -> list[DataFrame]:
    """All events, in one batch for each kind and one for the rest."""
    rows = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    rest = rows.filter(~F.coalesce(F.col("event_type").isin(*KINDS), F.lit(False)))
    return [*[rows.filter(F.col("event_type") == kind) for kind in KINDS], rest]


def grown(t: Tables, keep: str) -> DataFrame:
    batches = event_batches(t)
    log = KeyedLog(folder(t, f"log-{keep}"), batches[0].schema, ("user_id",), ("ts", "event_id"), keep, fan=3)
    for batch in batches:
        log.append(batch)
    return log.read(t.spark)


@query("""
SELECT user_id, ts, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1""")
def last_of_batches(t: Tables) -> DataFrame:
    """The last event of every user, whichever batch brought it."""
    return grown(t, "last")


@query(f"""
SELECT user_id, ts, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(nullif(list_position({KINDS}, event_type), 0), 9),
                           ts NULLS FIRST, event_id NULLS FIRST) = 1""")
def first_of_batches(t: Tables) -> DataFrame:
    """The first event of every user in the first batch that has one."""
    return grown(t, "first")


@query("""
SELECT sha256(text) AS key, CASE WHEN bool_or(coalesce(quality = 1, false)) THEN 'good' ELSE 'any' END AS value
FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY text""")
def cache_growth(t: Tables) -> DataFrame:
    """Answers for good texts, then for all: the first ones stay."""
    path = folder(t, "cache")
    texts = t.documents.filter("text IS NOT NULL").select("doc_id", tx.content_key(F.col("text")).alias("key"))
    good = texts.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    for rows, value in ((good, "good"), (texts, "any")):
        append_cache(rows.select("key", F.lit(value).alias("value")), path, TEXT_CACHE)
    return read_cache(t.spark, path, TEXT_CACHE)


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '"' || o_orderpriority || '", a' END AS label, o_totalprice FROM orders""")
def csv_export(t: Tables) -> DataFrame:
    """Orders written as CSV and read back; NULL and quoted texts come through."""
    path = folder(t, "csv")
    label = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('", a')))
    rows = t.orders.select("o_orderkey", label.alias("label"), "o_totalprice")
    sinks.write_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, 0 AS notes FROM customer""")
def refreshed(t: Tables) -> DataFrame:
    """A table replaced, with NaN as NULL, and the one that hangs on it emptied."""
    path, notes = folder(t, "base"), folder(t, "notes")
    sinks.write_version(t.customer.select("c_custkey"), notes)
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    rows = t.customer.select("c_custkey", balance.alias("balance"))
    sinks.refresh(rows, path, {notes: t.customer.select("c_custkey").schema})
    left = sinks.read_current(t.spark, notes).count()
    return sinks.read_current(t.spark, path).withColumn("notes", F.lit(left))


@query(f"""{LINKED_SQL}
SELECT id, codigo_comisaria, hospital_id, ubicacion_id FROM linked""")
def rerun_links(t: Tables) -> DataFrame:
    """The transform run a second time over its own tables: keys stay as they are."""
    root = folder(t, "rerun")
    incidents = load_incidents(page_rows(t))
    run_transform(incidents, root)
    return run_transform(incidents, root).select("id", "codigo_comisaria", "hospital_id", "ubicacion_id")


@query(f"""{LINKED_SQL}
SELECT codigo_comisaria, regexp_matches(coalesce(prioridad, ''), '^[14] ') AS rojo, count(*) AS n,
       CAST(count(*) FILTER (traslado OR destino IS NOT NULL) AS DOUBLE) * 100 / count(*) AS moved_rate,
       CAST(count(*) FILTER (traslado AND fecha_hora >= TIMESTAMP '1995-01-01') AS DOUBLE) * 100 / count(*) AS harm_rate
FROM linked GROUP BY ALL""")
def rerun_changes(t: Tables) -> DataFrame:
    """Rates after a second run that sees new, changed and lost incidents and attributes only."""
    counts = Counts(
        {"codigo_comisaria": "codigo_comisaria", "rojo": "coalesce(codigo_prioridad rlike '^[14] ', false)"},
        {"moved": "trasladado", "harm": "autolesion"},
    )
    step = Increment(folder(t, "increment"), counts)
    pages = page_rows(t)
    hospital = F.try_element_at("cells", F.lit(8))
    other = F.when(F.size("cells") > 8, F.transform("cells", lambda c, i: F.when(i == 7, "HOSPITAL 9").otherwise(c)))
    # Formerly some pages were not there yet, some had rows that are now lost, others another hospital.
    early = pages.filter("page < 60 OR page > 80")
    renamed = early.withColumn("cells", F.when((F.col("page") < 20) & hospital.isNotNull(), other).otherwise(F.col("cells")))
    lost = early.filter("page > 80").withColumn("table_no", F.lit(2))
    for rows, flag in ((renamed.unionByName(lost), F.col("pagina") < 40), (pages, F.col("fecha_hora") >= "1995-01-01")):
        incidents = step.number(rows)
        harmed = F.coalesce(F.col("traslado") & flag, F.lit(False))
        notes = F.to_json(F.struct(harmed.alias("autolesion"))).alias("atributos")
        step.run(incidents, incidents.select(F.col("id").alias("intervencion_id"), notes))
    return step.counts.rates(step.current_counts(t.spark))


@query("""
SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE l_discount > 0.05 AND NOT coalesce(CASE WHEN l_quantity > 10 THEN l_quantity > 30 END, false) GROUP BY l_returnflag""")
def where_flags(t: Tables) -> DataFrame:
    """Lines with one flag and without another, where NULL counts as false."""
    large = F.when(F.col("l_quantity") > 10, F.col("l_quantity") > 30)
    rows = t.lineitem.select("l_returnflag", (F.col("l_discount") > 0.05).alias("cheap"), large.alias("large"))
    kept = J.where_all(rows, {"cheap": True, "large": False})
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
