"""Queries of the resolvers. The resolvers here are rules, so SQL can state the answers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.functions import text as tx
from casewell.operators import keys as K
from casewell.operators import resolve as X
from casewell.session import staging_root
from catalog.registry import Tables, deidentify_sql, query, strip_sql


def fresh_cache(t: Tables, label: str) -> str:
    return f"{staging_root(t.spark)}/cache-{label}-{uuid.uuid4().hex}"


@query("""
WITH known AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id))
SELECT DISTINCT sha256(text) AS key, text FROM documents
WHERE text NOT IN (SELECT text FROM known) AND NOT contains(text, '###')""")
def pending_texts(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels.select("doc_id"), "doc_id")
    cache = labelled.select(tx.content_key(F.col("text")).alias("key")).distinct()
    return X.pending_texts(t.documents, "text", cache, mark="###")


def name_rule(texts: pd.Series) -> pd.Series:
    """Quoted answer with one word replaced; no answer for texts that hold a hash sign."""
    answers = '" ' + texts.str.replace("the ", "[NOMBRE] ", regex=False) + '"'
    return answers.where(~texts.str.contains("#", regex=False), None)


def _answer_sql(text: str) -> str:
    return f"""CASE WHEN contains({text}, '[NOMBRE]') OR contains({text}, '#') THEN {text}
               ELSE {strip_sql(f"replace({text}, 'the ', '[NOMBRE] ')")} END"""


@query(f"""
SELECT doc_id, {deidentify_sql(_answer_sql("text"))} AS text,
       {deidentify_sql(_answer_sql("text"))} <> text AS changed
FROM documents""")
def resolve_text(t: Tables) -> DataFrame:
    documents = t.documents.select("doc_id", "text")
    rows, _ = X.resolve_text(documents, "text", name_rule, fresh_cache(t, "names"))
    return rows


def size_rule(texts: pd.Series) -> pd.Series:
    """JSON attributes, a broken answer for some texts and none for others."""
    answers = '{"long": ' + (texts.str.len() > 1000).map({True: "true", False: "false"}) + "}"
    answers = answers.where(~texts.str.contains("#", regex=False), "no answer")
    return answers.where(~texts.str.contains("$", regex=False), None)


@query("""
SELECT doc_id, CASE WHEN contains(text, '#') OR contains(text, '$') THEN '{"long": null}'
                    WHEN length(text) > 1000 THEN '{"long": true}' ELSE '{"long": false}' END AS attributes,
       TIMESTAMP '2024-01-01 00:00:00' AS processed_at, 'rule' AS model, 'vars-v2' AS version
FROM documents""")
def resolve_attributes(t: Tables) -> DataFrame:
    return X.resolve_attributes(
        t.documents, "doc_id", "text", size_rule, fresh_cache(t, "attributes"),
        default={"long": None}, run_ts="2024-01-01 00:00:00", model="rule",
    )


def grid_rule(places: pd.DataFrame) -> pd.DataFrame:
    """A point by brand number and size; a miss for some sizes and an error for others."""
    brand = places["p_brand"].str.slice(6).astype("int64")
    status = pd.Series("ok", index=places.index)
    status = status.where(places["p_size"] % 7 != 0, "miss").where(places["p_size"] % 11 != 0, "error")
    found = status == "ok"
    return pd.DataFrame(
        {
            "lat": (brand + places["p_size"] / 64.0).where(found),
            "lon": (places["p_size"] - brand / 32.0).where(found),
            "status": status,
        }
    )


@query("""
WITH l AS (SELECT DISTINCT p_brand, nullif(p_size, 50) - 3 AS p_size FROM part),
     n AS (SELECT *, CAST(substr(p_brand, 7) AS BIGINT) AS b FROM l),
     r AS (SELECT *, b + p_size / 64.0::DOUBLE AS lat, p_size - b / 32.0::DOUBLE AS lon,
                  p_size > 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0 AS found FROM n),
     k AS (SELECT *, coalesce(found AND lat BETWEEN 2 AND 20 AND lon BETWEEN 1 AND 40, false) AS ok FROM r)
SELECT p_brand, p_size, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon,
       CASE WHEN ok THEN 'grid' END AS source,
       CASE WHEN ok THEN TIMESTAMP '2024-01-01 00:00:00' END AS located_at
FROM k""")
def resolve_points(t: Tables) -> DataFrame:
    size = F.nullif(F.col("p_size"), F.lit(50)) - 3
    locations = K.distinct_of(t.part.select("p_brand", size.alias("p_size")), "p_brand", "p_size")
    return X.resolve_points(
        locations, "p_brand", "p_size", grid_rule, fresh_cache(t, "points"), "grid",
        "2024-01-01 00:00:00", {"lat": (2.0, 20.0), "lon": (1.0, 40.0)},
    )
