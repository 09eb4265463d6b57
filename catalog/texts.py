"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.functions import text as tx
from casewell.plans.redaction import redaction_by_group
from catalog.registry import (
    BADGE,
    LONG_NUMBER,
    REFERENCE_ID,
    WS,
    Tables,
    deidentify_sql,
    query,
    strip_sql,
)

CLEAN_SQL = f"nullif(trim(regexp_replace(text, '[{WS}]+', ' ', 'g')), '')"

# Texts with badge numbers, reference ids and phone numbers added to what they hold.
TAGGED_SQL = (
    "text || ' OF L.P. ' || doc_id || ' [Id.Remoto: ' || n_chars || '] LEGAJO ' || n_chars"
    " || '  TEL 11-' || (22000000 + doc_id) || '- 4057 '"
)


def tagged(documents: DataFrame) -> DataFrame:
    doc, size = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    return documents.withColumn(
        "text",
        F.concat(
            "text", F.lit(" OF L.P. "), doc, F.lit(" [Id.Remoto: "), size, F.lit("] LEGAJO "), size,
            F.lit("  TEL 11-"), (F.col("doc_id") + 22000000).cast("string"), F.lit("- 4057 "),
        ),
    )


@query(f"SELECT doc_id, {CLEAN_SQL} AS clean FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.texts("doc_id", "text").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query(f"""
WITH rows_ AS (SELECT doc_id, string_split(text, chr(10)) AS cells FROM documents),
     firsts AS (SELECT *, lower({strip_sql("cells[1]")}) AS first_ FROM rows_)
SELECT doc_id,
       starts_with(first_, 'the') OR (contains(first_, 'on') AND
           len(list_filter(cells[2:], lambda c: regexp_matches(c, '[^{WS}]'))) = 0) AS noise
FROM firsts""")
def noise_rows(t: Tables) -> DataFrame:
    cells = F.split("text", "\n")
    return t.texts("doc_id", "text").select("doc_id", tx.is_noise_row(cells, "the", "on").alias("noise"))


@query("""
SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN true WHEN 'o' THEN false END AS answer
FROM orders""")
def parse_yes_no(t: Tables) -> DataFrame:
    answer = F.concat(F.lit(" \t"), "o_orderstatus", F.lit("x"))
    return t.orders.select("o_orderkey", tx.parse_yes_no(answer, "f", "o").alias("answer"))


@query(f"SELECT doc_id, {deidentify_sql(TAGGED_SQL)} AS redacted FROM documents")
def redact_rules(t: Tables) -> DataFrame:
    return tagged(t.texts("doc_id", "text", "n_chars")).select("doc_id", tx.deidentify(F.col("text")).alias("redacted"))


@query(f"""
WITH a AS (SELECT doc_id, {TAGGED_SQL} AS t FROM documents),
     b AS (SELECT *, len(regexp_extract_all(t, '{REFERENCE_ID}')) AS h1,
                  regexp_replace(t, '{REFERENCE_ID}', '', 'g') AS t2 FROM a),
     c AS (SELECT *, len(regexp_extract_all(t2, '{BADGE}')) AS h2,
                  regexp_replace(t2, '{BADGE}', '[LP]', 'g') AS t3 FROM b),
     d AS (SELECT *, len(regexp_extract_all(t3, '{LONG_NUMBER}')) AS h3,
                  regexp_replace(t3, '{LONG_NUMBER}', '[NUM]', 'g') AS t4 FROM c)
SELECT doc_id, CAST(h1 AS INTEGER) AS hits_reference_id, CAST(h2 AS INTEGER) AS hits_badge,
       CAST(h3 AS INTEGER) AS hits_long_number,
       CAST(len(regexp_extract_all(t4, '[ \\t]{{2,}}')) AS INTEGER) AS hits_blank_run,
       sha256({strip_sql("regexp_replace(t4, '[ \\t]{2,}', ' ', 'g')")}) AS text_key
FROM d""")
def redaction_hits(t: Tables) -> DataFrame:
    applied = tx.apply_rules(tagged(t.texts("doc_id", "text", "n_chars")), "text", tx.deidentify_rules())
    hits = [f"hits_{r.name}" for r in tx.deidentify_rules()]
    return applied.select("doc_id", *hits, tx.content_key(F.col("text")).alias("text_key"))


@query("""
SELECT p_partkey, nullif(regexp_extract(p_brand || ' ' || p_type, 'Brand#([0-9]{1,2}) [EPS]', 1), '')
       AS brand_no
FROM part""")
def extract_group(t: Tables) -> DataFrame:
    label = F.concat_ws(" ", "p_brand", "p_type")
    group = tx.first_group(label, "Brand#([0-9]{1,2}) [EPS]")
    return t.part.select("p_partkey", group.alias("brand_no"))


@query("""
SELECT doc_id, CAST(nullif(regexp_extract(text, '([0-9]{1,3}) ?[A-Za-z]', 1), '') AS INTEGER) AS number
FROM documents""")
def extract_int(t: Tables) -> DataFrame:
    number = tx.first_int(F.col("text"), "([0-9]{1,3}) ?[A-Za-z]")
    return t.documents.select("doc_id", number.alias("number"))


@query("""
SELECT o_orderkey,
       (nullif(o_orderpriority, '3-MEDIUM') LIKE '1-%' OR regexp_matches(text, '(?i)ON THE|CIÓN'))
       AS flag
FROM orders LEFT JOIN documents ON doc_id = o_orderkey""")
def flag_prefix_or_phrase(t: Tables) -> DataFrame:
    joined = t.orders.join(t.documents, F.col("doc_id") == F.col("o_orderkey"), "left")
    code = F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM"))
    flag = tx.prefix_or_phrase(code, F.col("text"), "1-", "ON THE|CIÓN")
    return joined.select("o_orderkey", flag.alias("flag"))


EN_MARKER = r"(^|[^\p{L}\p{N}\p{M}_])the([^\p{L}\p{N}\p{M}_]|$)"
ES_MARKER = "QUE|ACIÓN|ÑA"


@query(f"""
WITH m AS (SELECT doc_id, nullif(lang, 'fr') AS o,
                  regexp_matches(text, '(?i){EN_MARKER}') AS a,
                  regexp_matches(text, '(?i){ES_MARKER}') AS b FROM documents)
SELECT doc_id, CASE WHEN o IN ('de', 'es') THEN o WHEN a AND NOT b THEN 'de'
                    WHEN b AND NOT a THEN 'es' ELSE 'unknown' END AS class
FROM m""")
def marker_class(t: Tables) -> DataFrame:
    override = F.nullif(F.col("lang"), F.lit("fr"))
    markers = {"de": EN_MARKER, "es": ES_MARKER}
    found = tx.marker_class(F.col("text"), override, markers, "unknown")
    return t.texts("doc_id", "text", "lang").select("doc_id", found.alias("class"))


@query("""
SELECT o_orderkey, regexp_matches(coalesce(replace(nullif(o_orderpriority, '5-LOW'), '-', ' '), ''),
                                  '^[14] ') AS severe
FROM orders""")
def prefix_flag(t: Tables) -> DataFrame:
    code = F.replace(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("-"), F.lit(" "))
    return t.orders.select("o_orderkey", tx.has_prefix(code, R.RED_CODES).alias("severe"))


@query("""
SELECT p_partkey,
       CASE substr(coalesce(nullif(lpad(CAST(p_size AS VARCHAR), 2, '0') || ' - ' || p_type,
                                   '04 - PROMO'), '00'), 1, 2)
         WHEN '01' THEN 'trauma' WHEN '03' THEN 'trauma' WHEN '04' THEN 'trauma'
         WHEN '08' THEN 'trauma' WHEN '18' THEN 'psiq' WHEN '10' THEN 'cardiovascular'
         WHEN '11' THEN 'resp' WHEN '15' THEN 'neuro' ELSE 'otros/clínico' END AS grp
FROM part""")
def code_group(t: Tables) -> DataFrame:
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    label = F.nullif(F.concat(size, F.lit(" - "), "p_type"), F.lit("04 - PROMO"))
    group = tx.code_group(label, R.DIAGNOSIS_GROUPS, R.DIAGNOSIS_DEFAULT)
    return t.part.select("p_partkey", group.alias("grp"))


@query("SELECT doc_id, sha256(text) AS key, sha256('vars-v2|' || text) AS versioned FROM documents")
def content_key(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        tx.content_key(text).alias("key"),
        tx.content_key(text, R.ATTRIBUTE_VERSION).alias("versioned"),
    )


WRAPPED_SQL = """CASE lang WHEN 'en' THEN '  "' || text || ' " ' WHEN 'fr' THEN '''' || text || ''''
                 WHEN 'de' THEN '"' || text || '''' ELSE text || ' ' END"""


@query(f"""
WITH w AS (SELECT doc_id, {strip_sql(WRAPPED_SQL)} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) >= 2 AND left(t, 1) = right(t, 1) AND left(t, 1) IN ('"', '''')
               THEN {strip_sql("substr(t, 2, length(t) - 2)")} ELSE t END AS answer
FROM w""")
def unwrap_quotes(t: Tables) -> DataFrame:
    lang = F.col("lang")
    wrapped = (
        F.when(lang == "en", F.concat(F.lit('  "'), "text", F.lit(' " ')))
        .when(lang == "fr", F.concat(F.lit("'"), "text", F.lit("'")))
        .when(lang == "de", F.concat(F.lit('"'), "text", F.lit("'")))
        .otherwise(F.concat("text", F.lit(" ")))
    )
    return t.documents.select("doc_id", tx.unwrap_quotes(wrapped).alias("answer"))


@query("""
SELECT DISTINCT text FROM documents WHERE regexp_matches(text, '(?i)ON THE|ACIÓN')
ORDER BY text LIMIT 20""")
def candidate_texts(t: Tables) -> DataFrame:
    return tx.candidates(t.documents, "text", "ON THE|ACIÓN", 20)


@query("SELECT DISTINCT p_brand || '|' || p_size AS key FROM part")
def location_keys(t: Tables) -> DataFrame:
    return t.part.select(tx.pair_key(F.col("p_brand"), F.col("p_size")).alias("key")).distinct()


@query("""
SELECT replace(o_orderpriority, '-', ' - ') AS label, split_part(o_orderpriority, '-', 1) AS code,
       CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY ALL""")
def coded_link(t: Tables) -> DataFrame:
    from casewell.operators.keys import link_code

    labels = t.orders.select(F.replace("o_orderpriority", F.lit("-"), F.lit(" - ")).alias("label"))
    return link_code(labels, "label", "code").groupBy("label", "code").agg(
        F.count(F.lit(1)).alias("n")
    )


REDACTION_SQL = f"""
WITH c AS (SELECT doc_id, source, {CLEAN_SQL} AS t FROM documents),
     r AS (SELECT doc_id, source, {deidentify_sql("t")} <> t AS redacted FROM c),
     j AS (SELECT source, coalesce(redacted, false) AS redacted,
                  coalesce(toxic = 1, false) AS flagged
           FROM r LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS n,
       avg(CASE WHEN redacted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS redacted_rate,
       avg(CASE WHEN flagged THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS flagged_rate
FROM j GROUP BY source"""


@query(REDACTION_SQL)
def redaction_by_source(t: Tables) -> DataFrame:
    marks = t.labels.select("doc_id", (F.col("toxic") == 1).alias("flagged"))
    return redaction_by_group(t.texts("doc_id", "text", "source"), marks, "doc_id", "text", "source")
