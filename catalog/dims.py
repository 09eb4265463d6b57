"""Queries of ingestion, dimensions, keys, joins and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.functions import text as tx
from casewell.operators import audit as A
from casewell.operators import joins as J
from casewell.operators import keys as K
from casewell.operators.ingest import ingest_rows as ingest
from casewell.plans import findings
from casewell.plans.flat import analysis_frame, flat_view as build_view
from casewell.plans.transform import LOCATIONS, load_incidents, run_transform
from casewell.session import staging_root
from casewell.sources.sinks import export_ordered, read_current
from catalog.registry import WS, Tables, deidentify_sql, query, strip_sql


def _clean_sql(cell: str) -> str:
    return f"nullif(trim(regexp_replace({cell}, '[{WS}]+', ' ', 'g')), '')"


@query(f"""
WITH lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS row_no
               FROM conversations),
     c AS (SELECT *, string_split(line, ' ') AS cells FROM lines),
     f AS (SELECT *, lower({strip_sql("cells[1]")}) AS first_ FROM c),
     k AS (SELECT * FROM f WHERE NOT (starts_with(first_, 'the') OR (contains(first_, 'on') AND
             len(list_filter(cells[2:], lambda x: regexp_matches(x, '[^{WS}]'))) = 0)))
SELECT {_clean_sql("cells[1]")} AS a, {_clean_sql("cells[2]")} AS b, {_clean_sql("cells[3]")} AS c,
       {_clean_sql("cells[4]")} AS d, conv_id,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn, row_no) AS row_number
FROM k""")
def ingest_rows(t: Tables) -> DataFrame:
    lines = t.conversations.select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("row_no", "line")
    )
    cells = lines.select("conv_id", "turn", "row_no", F.split("line", " ").alias("cells"))
    return ingest(
        cells, ["a", "b", "c", "d"], "the", "on", "conv_id", ["turn", "row_no"], "row_number"
    )


@query("""
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_number
FROM conversations WHERE role <> 'system'""")
def row_numbers(t: Tables) -> DataFrame:
    kept = t.conversations.filter("role <> 'system'").select("conv_id", "turn", "role")
    return K.number_rows(kept, ["conv_id"], ["turn"])


@query("""
SELECT row_number() OVER (ORDER BY p_name) AS id, p_name
FROM (SELECT DISTINCT p_name FROM part)""")
def surrogate_ids(t: Tables) -> DataFrame:
    return K.dense_ids(K.distinct_of(t.part, "p_name"), ["p_name"])


@query("""
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders""")
def insertion_ids(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderdate", "o_orderkey")
    return K.dense_ids(rows, ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")


@query("""
WITH target AS (SELECT row_number() OVER (ORDER BY name) AS id, name
                FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_type = 'PROMO' AND p_size > 25)),
     fresh AS (SELECT DISTINCT p_name AS name FROM part
               WHERE p_name NOT IN (SELECT name FROM target))
SELECT * FROM target UNION ALL
SELECT (SELECT max(id) FROM target) + row_number() OVER (ORDER BY name), name FROM fresh""")
def ids_continued(t: Tables) -> DataFrame:
    first = t.part.filter("p_type = 'PROMO' AND p_size > 25")
    target = K.dense_ids(first.select(F.col("p_name").alias("name")).distinct(), ["name"])
    names = t.part.select(F.col("p_name").alias("name"))
    return K.insert_missing_with_ids(target, names, ["name"])


@query("""
SELECT split_part(o_orderpriority, '-', 1) AS code,
       min(regexp_replace(replace(o_orderpriority, '-', ' - '), '^[0-9]+ - ', '')) AS name
FROM orders GROUP BY 1""")
def coded_dim(t: Tables) -> DataFrame:
    labels = t.orders.select(F.replace("o_orderpriority", F.lit("-"), F.lit(" - ")).alias("label"))
    return K.coded_dim(labels, "label")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_pairs(t: Tables) -> DataFrame:
    return K.distinct_of(t.part, "p_brand", "p_size")


FIRST_ORDER = "SELECT o_custkey, min(o_orderdate) AS first_order FROM orders"


@query(f"""
WITH target AS ({FIRST_ORDER} WHERE o_orderstatus = 'F' GROUP BY 1),
     source AS ({FIRST_ORDER} GROUP BY 1)
SELECT * FROM target UNION ALL
SELECT * FROM source WHERE o_custkey NOT IN (SELECT o_custkey FROM target)""")
def insert_missing(t: Tables) -> DataFrame:
    def first(orders: DataFrame) -> DataFrame:
        return orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))

    source = t.orders.select("o_custkey", F.col("o_orderdate").alias("first_order"))
    return K.insert_missing(first(t.orders.filter("o_orderstatus = 'F'")), source, ["o_custkey"])


LATEST = """SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders WHERE o_orderstatus = '{}') WHERE r = 1"""


@query(f"""
WITH target AS ({LATEST.format("F")}), source AS ({LATEST.format("O")})
SELECT * FROM source UNION ALL
SELECT * FROM target WHERE o_custkey NOT IN (SELECT o_custkey FROM source)""")
def upsert_latest(t: Tables) -> DataFrame:
    def latest(status: str) -> DataFrame:
        rows = t.orders.filter(F.col("o_orderstatus") == status)
        last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey")
        return rows.groupBy("o_custkey").agg(last).withColumn("o_orderstatus", F.lit(status))

    return K.upsert(latest("F"), latest("O"), ["o_custkey"])


@query("""
SELECT o_orderdate, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
ORDER BY o_orderkey""")
def export_projection(t: Tables) -> DataFrame:
    cols = ["o_orderdate", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return export_ordered(t.orders, cols, "o_orderkey")


SHIPPED = "SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1"


@query(f"""
WITH p AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS street,
                  CAST(floor(o_totalprice - 100000) AS INTEGER) AS number
           FROM orders LEFT JOIN ({SHIPPED}) ON l_orderkey = o_orderkey WHERE shipped IS NULL)
SELECT o_orderkey, CASE WHEN street IS NULL THEN 'no_street' WHEN number <= 0 THEN 'no_number' END
       AS reason
FROM p""")
def pending_rows(t: Tables) -> DataFrame:
    shipped = t.lineitem.filter("l_linestatus = 'F'").groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(F.max("l_shipdate").alias("shipped"))
    orders = t.orders.select(
        "o_orderkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("street"),
        F.floor(F.col("o_totalprice") - 100000).cast("int").alias("number"),
    )
    waiting = J.pending(J.attach(orders, shipped, "o_orderkey"), "shipped")
    return J.skip_reason(waiting, "street", "number").select("o_orderkey", "reason")


@query("""
SELECT event_id, o.n AS open_orders FROM events
JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders
      GROUP BY 1) o ON o_custkey = user_id""")
def inner_attrs(t: Tables) -> DataFrame:
    attrs = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("open_orders")
    )
    return J.require(t.events.select("event_id", "user_id"), attrs, "user_id").drop("user_id")


@query("""
SELECT c_custkey, n_nationkey AS nation_id
FROM customer LEFT JOIN nation ON n_name = CASE WHEN c_acctbal >= 0 THEN 'NATION_' || c_nationkey
                                                ELSE 'NOWHERE' END""")
def link_by_name(t: Tables) -> DataFrame:
    name = F.when(
        F.col("c_acctbal") >= 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    ).otherwise("NOWHERE")
    facts = t.customer.select("c_custkey", name.alias("nation"))
    dim = t.nation.select(F.col("n_nationkey").alias("nation_id"), "n_name")
    return K.link_by_name(facts, dim, "nation", "n_name", "nation_id").drop("nation")


@query("""
WITH dim AS (SELECT row_number() OVER (ORDER BY p_brand, p_size) AS pair_id, p_brand, p_size
             FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_type <> 'PROMO'))
SELECT p_partkey, pair_id FROM part LEFT JOIN dim USING (p_brand, p_size)""")
def link_by_pair(t: Tables) -> DataFrame:
    pairs = K.distinct_of(t.part.filter("p_type <> 'PROMO'"), "p_brand", "p_size")
    dim = K.dense_ids(pairs, ["p_brand", "p_size"], "pair_id")
    size = F.concat(F.lit(" "), F.col("p_size").cast("string"))
    facts = t.part.select("p_partkey", "p_brand", size.alias("p_size"))
    return K.link_by_pair(facts, dim, "p_brand", "p_size", "pair_id").select("p_partkey", "pair_id")


@query("""
SELECT n_nationkey, n_name, n FROM nation
LEFT JOIN (SELECT nullif(c_nationkey, 3) AS c_nationkey, count(*) AS n FROM customer GROUP BY 1)
ON c_nationkey = n_nationkey""")
def zone_volume(t: Tables) -> DataFrame:
    # One zone's customers have no zone, so that it is left without a volume.
    zone = F.nullif(F.col("c_nationkey"), F.lit(3)).alias("n_nationkey")
    volume = t.customer.groupBy(zone).agg(F.count(F.lit(1)).alias("n"))
    return J.keep_all(t.nation.select("n_nationkey", "n_name"), volume, "n_nationkey")


@query("""
SELECT 'unique' AS rule, 'orders' AS table_name, 'o_orderkey' AS columns,
       CAST(count(o_orderkey) - count(DISTINCT o_orderkey) AS BIGINT) AS violations FROM orders
UNION ALL SELECT 'unique', 'lineitem', 'l_orderkey,l_linenumber',
       count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'required', 'documents', 'text', count(*) FILTER (text IS NULL) FROM documents
UNION ALL SELECT 'required', 'documents', 'lang', count(*) FILTER (lang IS NULL) FROM documents
UNION ALL SELECT 'reference', 'lineitem', 'l_orderkey->orders.o_orderkey', count(*)
       FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'reference', 'customer', 'c_custkey->events.user_id', count(*)
       FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def integrity_report(t: Tables) -> DataFrame:
    tables = {n: getattr(t, n) for n in ("orders", "lineitem", "documents", "customer", "events")}
    rules = [
        A.Unique("orders", ["o_orderkey"]),
        A.Unique("lineitem", ["l_orderkey", "l_linenumber"]),
        A.Required("documents", ["text", "lang"]),
        A.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
        A.Reference("customer", "c_custkey", "events", "user_id"),
    ]
    return A.integrity_report(tables, rules)


# Incidents made of orders, with customers as locations and events as attributes.
INCIDENTS_SQL = """
SELECT o_orderkey AS id, o_orderdate AS fecha_hora, 'CALLE ' || o_custkey AS direccion,
       CAST(o_custkey AS VARCHAR) AS altura,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'MUJER EMBARAZADA DE ' || o_custkey || ' AÑOS'
         WHEN '2-HIGH' THEN 'MASC detenido, comisaria ' || o_custkey || ' ANOS'
         WHEN '3-MEDIUM' THEN 'señora y hombre OFICIO JUDICIAL' WHEN '5-LOW' THEN 'SIN DATOS' END
       AS motivo,
       replace(o_orderpriority, '-', ' - ') AS diagnostico,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS traslado,
       CASE WHEN o_totalprice > 400000 THEN 'HOSPITAL ' || o_orderstatus END AS destino_traslado,
       CASE WHEN o_totalprice < 30000 THEN NULL WHEN o_totalprice < 100000 THEN '6 - BAJA'
            ELSE replace(o_orderpriority, '-', ' - ') END AS codigo_prioridad,
       o_orderpriority AS movil, 1 AS pagina, CAST(o_orderkey AS BIGINT) AS fila,
       NULL::VARCHAR AS codigo_comisaria, o_custkey AS ubicacion_id
FROM orders"""
ATTRIBUTES_SQL = """
SELECT event_id AS intervencion_id,
       '{"sexo": "' || CASE event_type WHEN 'click' THEN 'M' WHEN 'view' THEN 'F' ELSE 'desconocido' END
       || '", "tipo_sujeto": "' || event_type || '", "autolesion": '
       || CASE WHEN value > 20 THEN 'true' ELSE 'false' END
       || CASE WHEN value > 5 THEN ', "fallecimiento": false' ELSE '' END || '}' AS atributos
FROM events"""
FEMALE = (
    "(?i)FEMENIN|\\bFEM\\b|MUJER|\\bINTERNA\\b|\\bDETENIDA\\b|SE[ÑN]ORA|EMBARAZ|GESTAN|\\bLA MISMA\\b"
)
MALE = (
    "(?i)MASCULIN|\\bMASC\\b|HOMBRE|VAR[OÓ]N|\\bINTERNO\\b|\\bDETENIDO\\b|PREVENIDO|\\bEL MISMO\\b"
)
VIEW_SQL = f"""
SELECT i.* EXCLUDE (ubicacion_id),
       CAST(nullif(regexp_extract(motivo, '([0-9]{{1,3}}) ?A[ÑN]OS', 1), '') AS INTEGER) AS edad,
       (codigo_prioridad LIKE '6 %' OR regexp_matches(motivo, '(?i)OFICIO JUDICIAL'))
       AS es_oficio_judicial,
       (traslado OR destino_traslado IS NOT NULL) AS trasladado,
       c_acctbal AS lat, c_acctbal / 2 AS lon, c_nationkey AS comuna,
       CASE WHEN json_extract_string(atributos, '$.sexo') IN ('M', 'F')
              THEN json_extract_string(atributos, '$.sexo')
            WHEN regexp_matches(motivo, '{FEMALE}') AND NOT regexp_matches(motivo, '{MALE}') THEN 'F'
            WHEN regexp_matches(motivo, '{MALE}') AND NOT regexp_matches(motivo, '{FEMALE}') THEN 'M'
            ELSE 'desconocido' END AS sexo,
       json_extract_string(atributos, '$.tipo_sujeto') AS tipo_sujeto,
       json_extract_string(atributos, '$.tipo_dependencia') AS tipo_dependencia,
       json_extract_string(atributos, '$.quien_solicita') AS quien_solicita,
       {", ".join(
           f"json_extract_string(atributos, '$.{f}') = 'true' AS {f}"
           for f in ("violencia_genero", "autolesion", "agresion_por_terceros",
                     "crisis_psiquiatrica", "ingesta_cuerpo_extrano", "fallecimiento"))}
FROM i LEFT JOIN customer ON c_custkey = ubicacion_id LEFT JOIN a ON intervencion_id = id"""


def incident_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    priority, status, price = (F.col(f"o_{c}") for c in ("orderpriority", "orderstatus", "totalprice"))
    customer = F.col("o_custkey").cast("string")
    label = F.replace(priority, F.lit("-"), F.lit(" - "))
    text = (
        F.when(priority == "1-URGENT", F.concat(F.lit("MUJER EMBARAZADA DE "), customer, F.lit(" AÑOS")))
        .when(priority == "2-HIGH", F.concat(F.lit("MASC detenido, comisaria "), customer, F.lit(" ANOS")))
        .when(priority == "3-MEDIUM", "señora y hombre OFICIO JUDICIAL")
        .when(priority == "5-LOW", "SIN DATOS")
    )
    incidents = t.spread("orders", "*").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("fecha_hora"),
        F.concat(F.lit("CALLE "), customer).alias("direccion"),
        customer.alias("altura"),
        text.alias("motivo"),
        label.alias("diagnostico"),
        F.when(status == "F", True).when(status == "O", False).alias("traslado"),
        F.when(price > 400000, F.concat(F.lit("HOSPITAL "), status)).alias("destino_traslado"),
        F.when(price < 30000, None).when(price < 100000, "6 - BAJA").otherwise(label).alias(
            "codigo_prioridad"
        ),
        priority.alias("movil"),
        F.lit(1).alias("pagina"),
        F.col("o_orderkey").alias("fila"),
        F.lit(None).cast("string").alias("codigo_comisaria"),
        F.col("o_custkey").alias("ubicacion_id"),
    )
    locations = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("lat"),
        (F.col("c_acctbal") / 2).alias("lon"),
        F.col("c_nationkey").alias("comuna"),
    )
    kind, value = F.col("event_type"), F.col("value")
    notes = F.concat(
        F.lit('{"sexo": "'),
        F.when(kind == "click", "M").when(kind == "view", "F").otherwise("desconocido"),
        F.lit('", "tipo_sujeto": "'),
        kind,
        F.lit('", "autolesion": '),
        F.when(value > 20, "true").otherwise("false"),
        F.when(value > 5, ', "fallecimiento": false').otherwise(""),
        F.lit("}"),
    )
    attributes = t.events.select(F.col("event_id").alias("intervencion_id"), notes.alias("atributos"))
    return incidents, locations, attributes


@query(f"WITH i AS ({INCIDENTS_SQL}), a AS ({ATTRIBUTES_SQL}) {VIEW_SQL}")
def flat_view(t: Tables) -> DataFrame:
    return build_view(*incident_tables(t))


@query(f"""
WITH i AS ({INCIDENTS_SQL}), a AS ({ATTRIBUTES_SQL}), v AS ({VIEW_SQL})
SELECT tipo_sujeto, regexp_matches(coalesce(codigo_prioridad, ''), '^[14] ') AS rojo,
       CASE substr(coalesce(diagnostico, '00'), 1, 2) WHEN '01' THEN 'trauma'
            ELSE 'otros/clínico' END AS grupo_diagnostico,
       count(*) AS n,
       avg(CASE WHEN trasladado THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS trasladado_rate,
       avg(CASE WHEN autolesion THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS au_rate
FROM v WHERE id IN (SELECT intervencion_id FROM a) GROUP BY ALL""")
def view_rates(t: Tables) -> DataFrame:
    from casewell.operators.rates import rates

    incidents, locations, attributes = incident_tables(t)
    view = build_view(incidents, locations, attributes)
    rows = analysis_frame(view, attributes, {"au": "autolesion"})
    by = ["tipo_sujeto", "rojo", "grupo_diagnostico"]
    return rates(rows, by, ["trasladado", "au"])


@query(f"""
WITH i AS ({INCIDENTS_SQL}), a AS ({ATTRIBUTES_SQL}), v AS ({VIEW_SQL}),
     r AS (SELECT sexo, coalesce(trasladado, false) AS moved,
                  regexp_matches(coalesce(codigo_prioridad, ''), '^[14] ') AS rojo
           FROM v WHERE id IN (SELECT intervencion_id FROM a)),
     s AS (SELECT 'crude' AS scenario, * FROM r UNION ALL SELECT 'without pregnancy', * FROM r
           UNION ALL SELECT 'severe, without pregnancy', * FROM r WHERE rojo)
SELECT scenario, sexo, count(*) AS n, CAST(count(*) FILTER (moved) AS DOUBLE) * 100 / count(*) AS rate
FROM s WHERE sexo IN ('M', 'F') GROUP BY ALL""")
def transfer_by_sex(t: Tables) -> DataFrame:
    incidents, locations, attributes = incident_tables(t)
    view = build_view(incidents, locations, attributes)
    return findings.transfer_by_sex(analysis_frame(view, attributes, findings.FLAGS))


@query(f"""
WITH i AS ({INCIDENTS_SQL}), a AS ({ATTRIBUTES_SQL}), v AS ({VIEW_SQL}),
     r AS (SELECT CASE substr(coalesce(diagnostico, '00'), 1, 2) WHEN '01' THEN 'trauma'
                  ELSE 'otros/clínico' END AS grp, sexo,
                  CASE WHEN trasladado THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS moved
           FROM v WHERE id IN (SELECT intervencion_id FROM a))
SELECT g AS grupo_diagnostico, avg(moved) FILTER (sexo = 'M') * 100 AS "M",
       avg(moved) FILTER (sexo = 'F') * 100 AS "F"
FROM (VALUES ('trauma'), ('psiq'), ('otros/clínico'), ('cardiovascular')) x(g) LEFT JOIN r ON grp = g
GROUP BY g""")
def transfer_by_diagnosis(t: Tables) -> DataFrame:
    incidents, locations, attributes = incident_tables(t)
    view = build_view(incidents, locations, attributes)
    return findings.transfer_by_diagnosis(analysis_frame(view, attributes, findings.FLAGS))


# Page rows made of orders: a header where the priority is not specified, else one incident.
PAGE_ROWS_SQL = f"""
SELECT CAST(o_custkey % 97 AS INTEGER) AS page, o_orderkey AS row_no,
       strftime(o_orderdate, '%-d/%-m/%Y') || ' 7:05' AS fecha, 'CALLE ' || (o_custkey % 40) AS direccion,
       CASE o_orderstatus WHEN 'P' THEN 'S/N' ELSE CAST(o_custkey % 30 AS VARCHAR) END AS altura,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'MUJER EN COMISARIA ' || (o_custkey % 60) || 'A LP 77 TEL 11' || (10000000 + o_custkey)
         WHEN '2-HIGH' THEN 'HOMBRE DE ' || (o_custkey % 90) || ' AÑOS, COMISARÍA' || (o_custkey % 9)
         WHEN '3-MEDIUM' THEN 'OFICIO JUDICIAL COMISARIA VECINAL 3B' ELSE 'SIN DATOS' END AS motivo,
       (o_custkey % 12) || ' - GRUPO ' || (o_custkey % 12) AS diagnostico,
       CASE o_orderstatus WHEN 'F' THEN 'Si' WHEN 'O' THEN 'No' END AS traslado,
       CASE WHEN o_totalprice > 300000 THEN 'HOSPITAL ' || (o_custkey % 7) END AS destino,
       replace(o_orderpriority, '-', ' - ') AS prioridad
FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'"""
LINKED_SQL = f"""
WITH raw AS ({PAGE_ROWS_SQL}),
     inc AS (SELECT row_number() OVER (ORDER BY page, row_no) AS id, page AS pagina,
                    row_number() OVER (PARTITION BY page ORDER BY row_no) AS fila, *,
                    strptime(fecha, '%-d/%-m/%Y %-H:%M') AS fecha_hora, {deidentify_sql("motivo")} AS texto,
                    TRY_CAST(altura AS INTEGER) AS numero FROM raw),
     hosp AS (SELECT row_number() OVER (ORDER BY destino) AS hospital_id, destino
              FROM (SELECT DISTINCT destino FROM inc WHERE destino IS NOT NULL)),
     place AS (SELECT row_number() OVER (ORDER BY direccion, numero) AS ubicacion_id, direccion, numero
               FROM (SELECT DISTINCT direccion, numero FROM inc WHERE numero IS NOT NULL)),
     linked AS (SELECT id, pagina, fila, fecha_hora, texto AS motivo, traslado = 'Si' AS traslado, diagnostico, destino, prioridad,
                       split_part(diagnostico, ' - ', 1) AS diagnostico_codigo, split_part(prioridad, ' - ', 1) AS prioridad_codigo,
                       nullif(regexp_extract(texto, '(?i)COMISAR[IÍ]A[ ]*([0-9]{{1,2}}[A-Z]?)', 1), '') AS codigo_comisaria,
                       hospital_id, ubicacion_id
                FROM inc LEFT JOIN hosp USING (destino) LEFT JOIN place USING (direccion, numero))"""


def page_rows(t: Tables) -> DataFrame:
    """Rows of cells as a page decoder gives them."""
    customer, priority, status = F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    text = lambda c: c.cast("string")
    motivo = (
        F.when(
            priority == "1-URGENT",
            F.concat(F.lit("MUJER EN COMISARIA "), text(customer % 60), F.lit("A  LP 77 TEL 11"), text(customer + 10000000)),
        )
        .when(
            priority == "2-HIGH",
            F.concat(F.lit("HOMBRE DE "), text(customer % 90), F.lit(" AÑOS, COMISARÍA"), text(customer % 9)),
        )
        .when(priority == "3-MEDIUM", "OFICIO JUDICIAL\nCOMISARIA VECINAL 3B")
        .otherwise("SIN DATOS")
    )
    group = text(customer % 12)
    cells = F.array(
        F.concat(F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" 7:05")),
        F.concat(F.lit(" CALLE "), text(customer % 40)),
        F.when(status == "P", "S/N").otherwise(text(customer % 30)),
        F.lit(None).cast("string"),
        motivo,
        F.concat(group, F.lit(" - GRUPO "), group),
        F.when(status == "F", "Si").when(status == "O", "No"),
        F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("HOSPITAL "), text(customer % 7))),
        F.replace(priority, F.lit("-"), F.lit(" - ")),
        F.lit("M1"),
    )
    header = F.array(F.lit("Fecha y Hora"), F.lit("Dirección"))
    return t.spread("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice").select(
        (customer % 97).cast("int").alias("page"),
        F.lit(1).alias("table_no"),
        F.col("o_orderkey").alias("row_no"),
        F.when(priority == "4-NOT SPECIFIED", header).otherwise(cells).alias("cells"),
    )


def transformed(t: Tables) -> tuple[DataFrame, str]:
    """Linked incidents, and the folder with the dimensions they point to."""
    root = f"{staging_root(t.spark)}/transform-{uuid.uuid4().hex}"
    return run_transform(load_incidents(page_rows(t)), root), root


@query(f"""{LINKED_SQL}
SELECT id, pagina, fila, fecha_hora, motivo, traslado, diagnostico_codigo, prioridad_codigo, codigo_comisaria,
       hospital_id, ubicacion_id FROM linked""")
def transform_links(t: Tables) -> DataFrame:
    linked, _ = transformed(t)
    return linked.select(
        "id", "pagina", F.col("fila").cast("bigint").alias("fila"), "fecha_hora", "motivo", "traslado",
        "diagnostico_codigo", "prioridad_codigo", "codigo_comisaria", "hospital_id", "ubicacion_id",
    )


@query(f"""{LINKED_SQL}, a AS ({ATTRIBUTES_SQL})
SELECT codigo_comisaria, regexp_matches(coalesce(prioridad, ''), '^[14] ') AS rojo, count(*) AS n,
       avg(CASE WHEN traslado OR destino IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS trasladado_rate,
       avg(CASE WHEN json_extract_string(atributos, '$.autolesion') = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS au_rate
FROM linked JOIN a ON intervencion_id = id GROUP BY ALL""")
def transform_rates(t: Tables) -> DataFrame:
    """Cells to dimensions, links, view, analysis frame and rates."""
    from casewell.operators.rates import rates

    linked, root = transformed(t)
    _, _, attributes = incident_tables(t)
    places = read_current(t.spark, f"{root}/ubicaciones", LOCATIONS)
    rows = analysis_frame(build_view(linked, places, attributes), attributes, {"au": "autolesion"})
    return rates(rows, ["codigo_comisaria", "rojo"], ["trasladado", "au"])


MAPPING_SQL = """
SELECT text AS old, min('REVIEWED ' || quality || left(lang, 1)) AS new
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY text"""


@query(f"""
SELECT doc_id, coalesce(new, text) AS text, coalesce(new <> text, false) AS changed
FROM documents LEFT JOIN ({MAPPING_SQL}) ON old = text""")
def apply_mapping(t: Tables) -> DataFrame:
    good = t.documents.join(t.labels.filter("quality = 1"), "doc_id")
    new = F.concat(F.lit("REVIEWED "), F.col("quality").cast("string"), F.left("lang", F.lit(1)))
    mapping = good.select(F.col("text").alias("old"), new.alias("new")).distinct()
    unique = K.one_per_key(mapping, ["old"])
    documents = t.documents.select("doc_id", "text")
    return J.apply_mapping(documents, unique, "text")


@query(f"""
SELECT doc_id, coalesce(new, text) AS answer FROM documents LEFT JOIN ({MAPPING_SQL}) ON old = text""")
def cache_apply(t: Tables) -> DataFrame:
    good = t.documents.join(t.labels.filter("quality = 1"), "doc_id")
    new = F.concat(F.lit("REVIEWED "), F.col("quality").cast("string"), F.left("lang", F.lit(1)))
    key = tx.content_key(F.col("text"))
    cache = good.select(key.alias("key"), new.alias("value")).groupBy("key").agg(
        F.min("value").alias("value")
    )
    rows = t.documents.select("doc_id", "text", key.alias("key"))
    return J.cache_apply(rows, cache, "key", F.col("text"), "answer").select("doc_id", "answer")
