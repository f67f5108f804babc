"""Views that map the driver's tables onto the stored-data contracts.

The view bodies are plain SQL that runs unchanged on Spark and DuckDB, so a
Spark query and its DuckDB oracle read exactly the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import pin_session

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# The fixture view definitions (tenant = customer, document = order).
VIEW_SQL: dict[str, str] = {
    "v_documents": """
SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 13 = 0 OR o_orderstatus = 'P' THEN NULL
       ELSE o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT) END AS document_type_id,
  concat('doc_', CAST(o_orderkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG'
       WHEN 2 THEN '.jpg' WHEN 3 THEN '.csv' WHEN 4 THEN '.webp' ELSE '' END) AS filename,
  CASE WHEN o_orderkey % 17 = 0 THEN 'error' WHEN o_orderkey % 11 = 0 THEN 'queued'
       WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'processing'
       ELSE 'pending_confirmation' END AS status,
  CAST((o_orderkey % 101) / 100.0 AS DECIMAL(5,2)) AS confidence_score,
  substr(o_orderpriority, 3) AS inferred_type,
  CAST((o_orderkey * 997) % 20000000 AS BIGINT) AS size_bytes,
  CASE WHEN o_orderkey % 4 = 0 THEN
    concat('{"summary":"', substr(o_orderpriority, 3), '","key_fields":[{"name":"total","type":"currency","value":"',
           CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '"}]}')
  ELSE
    concat('{"summary":"', substr(o_orderpriority, 3), '","fields":[{"name":"total","type":"number","value":"',
           CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '"},{"name":"cliente","type":"string","value":',
           CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE concat('"', CAST(o_custkey AS STRING), '"') END, '}]}') END AS extracted_data,
  o_orderdate AS created_at
FROM orders""",
    "v_document_types": """
SELECT c.c_custkey * 10 + p.k AS id, c.c_custkey AS user_id, p.name,
  CASE WHEN p.k % 2 = 0 THEN concat('Tipo ', p.name) END AS description,
  c.c_nationkey AS nation_key
FROM customer c CROSS JOIN (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS k,
                                   substr(o_orderpriority, 3) AS name FROM orders) p
WHERE (c.c_custkey + p.k) % 3 <> 0""",
    # Types with their field schema, and a catch-all type for some tenants.
    "v_types": """
SELECT id, user_id, name, description,
  concat('{"fields":[{"name":"total","type":"number","label":"Total","required":true,"description":""}',
         CASE WHEN id % 2 = 0 THEN ',{"name":"cliente","type":"string","label":"Cliente","required":false,"description":""}' ELSE '' END,
         CASE WHEN id % 3 = 0 THEN ',{"name":"fecha","type":"date","label":"Fecha","required":false,"description":""}' ELSE '' END,
         ']}') AS field_schema
FROM v_document_types
UNION ALL
SELECT c_custkey * 10 + 9, c_custkey, 'Otros Documentos', NULL, '{"fields":[]}' FROM customer WHERE c_custkey % 5 = 0""",
    "v_fields": """
SELECT o_orderkey AS doc_id, o_custkey AS user_id, substr(o_orderpriority, 3) AS type_name, 'cliente' AS name, 'string' AS type,
       CAST(o_custkey AS STRING) AS value FROM orders
UNION ALL SELECT o_orderkey, o_custkey, substr(o_orderpriority, 3), 'total', CASE WHEN o_orderkey % 3 = 0 THEN 'currency' ELSE 'Number' END,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, o_custkey, substr(o_orderpriority, 3), 'fecha', 'datetime', substr(CAST(o_orderdate AS STRING), 1, 10)
       FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_custkey, substr(o_orderpriority, 3), 'estado', 'string', o_orderstatus FROM orders WHERE o_orderkey % 3 = 0""",
    "v_subscriptions": """
SELECT c_custkey AS user_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'starter' WHEN 'FURNITURE' THEN 'pro' WHEN 'HOUSEHOLD' THEN 'enterprise' ELSE 'free' END AS plan,
  CAST(c_custkey % 60 AS INT) AS docs_used_this_period,
  TIMESTAMP '1998-01-01 00:00:00' AS period_start,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE TIMESTAMP '1999-01-01 00:00:00' END AS period_end,
  TRUE AS active, concat('cus_', CAST(c_custkey AS STRING)) AS customer_ref
FROM customer""",
    "v_stage_metrics": """
SELECT event_id, CAST(floor(event_id / 5) AS BIGINT) AS run_id, ts,
  CASE event_type WHEN 'click' THEN 'upload' WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'classify'
       WHEN 'purchase' THEN 'extract' ELSE 'save' END AS stage,
  CASE event_type WHEN 'view' THEN 'ocr' WHEN 'signup' THEN 'model' WHEN 'purchase' THEN 'model' END AS provider,
  event_type = 'signup' AS is_vision,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS pages,
  CAST(event_id % 7000 AS BIGINT) AS input_chars, CAST(event_id % 900 AS BIGINT) AS output_chars,
  CAST(round(CAST(value AS DECIMAL(18,4)) * 10) AS BIGINT) AS duration_ms,
  concat('h', CAST(user_id AS STRING)) AS content_hash
FROM events""",
    "v_billing_events": """
SELECT event_id, ts, CASE WHEN user_id % 10 = 0 THEN 'cus_unknown' ELSE concat('cus_', CAST(user_id AS STRING)) END AS customer_ref,
  CASE event_type WHEN 'signup' THEN 'checkout.session.completed' WHEN 'purchase' THEN 'customer.subscription.updated'
       WHEN 'click' THEN 'customer.subscription.deleted' WHEN 'error' THEN 'invoice.payment_failed' ELSE 'other' END AS event_type,
  CASE event_id % 3 WHEN 0 THEN 'price_starter' WHEN 1 THEN 'price_pro' END AS price_id,
  CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' ELSE 'past_due' END AS status,
  CASE event_id % 5 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' END AS target_plan,
  CASE WHEN event_type = 'purchase' THEN ts END AS period_start,
  CASE WHEN event_type = 'purchase' AND event_id % 7 <> 0 THEN ts + INTERVAL 31 DAY END AS period_end
FROM events""",
    "v_object_keys": """
SELECT id, user_id, filename, size_bytes,
  concat(CAST(user_id AS STRING), CASE id % 4 WHEN 0 THEN '/extracted/' WHEN 1 THEN '/originals/' ELSE '/tipos/varios/' END, filename) AS key
FROM v_documents""",
    "v_responses": """
SELECT item_id AS id, CASE item_id % 5
  WHEN 0 THEN concat('{"inferred_type":"Factura","confidence":0.9,"n":', CAST(item_id AS STRING), '}')
  WHEN 1 THEN concat(repeat(chr(96), 3), 'json', chr(10), '{"inferred_type":"Boleta","n":', CAST(item_id AS STRING), '}', chr(10), repeat(chr(96), 3))
  WHEN 2 THEN concat('Claro: {"inferred_type":"Orden","fields":[1,2,],"n":', CAST(item_id AS STRING), ',} fin')
  WHEN 3 THEN concat('{', chr(39), 'inferred_type', chr(39), ': ', chr(39), 'Guia', chr(39), ', ', chr(39), 'ok', chr(39), ': True}')
  ELSE 'NO_SQL' END AS response
FROM benchmark""",
    "v_classified": """
SELECT d.doc_id, d.lang, d.source, CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE CAST((d.doc_id % 101) / 100.0 AS DECIMAL(5,2)) END AS confidence,
  l.toxic = 1 AS is_others
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # Documents with injected "Label: value" lines (invoice-like, order-like,
    # partial), so the lexical baseline and the label extractor have signal.
    "v_labeled_documents": """
SELECT doc_id, lang, source, concat(text, CASE doc_id % 4
  WHEN 0 THEN concat(chr(10), 'Folio: F-', CAST(doc_id AS STRING), chr(10), 'Emitido el: ',
       CAST(doc_id % 28 + 1 AS STRING), '/', CAST(doc_id % 12 + 1 AS STRING), '/2024', chr(10),
       'Importe: $ ', CAST(doc_id * 37 % 100000 AS STRING), ',50', chr(10), 'Comprador: Comprador ', CAST(doc_id % 50 AS STRING))
  WHEN 1 THEN concat(chr(10), 'Referencia Pedido: P-', CAST(doc_id AS STRING), chr(10), 'Pedido el: 2024-',
       lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), chr(10),
       'Suministrador: Casa ', CAST(doc_id % 30 AS STRING), chr(10), 'Valor Pedido: ', CAST(doc_id * 53 % 90000 AS STRING),
       chr(10), 'Avance: abierto')
  WHEN 2 THEN concat(chr(10), 'Emitido el: 2023-11-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), chr(10),
       'Importe: ', CAST(doc_id % 999 AS STRING))
  ELSE '' END) AS text
FROM documents""",
    # A shared catalogue of three types: how sales, orders and deliveries of
    # the order tables would be filed.
    "v_type_catalogue": """
SELECT * FROM (VALUES
  (1, 'Venta', 'Ventas a un comprador', 1, 'folio', 'Folio', 'string', TRUE),
  (1, 'Venta', 'Ventas a un comprador', 2, 'emitido_el', 'Emitido el', 'date', TRUE),
  (1, 'Venta', 'Ventas a un comprador', 3, 'importe', 'Importe', 'number', TRUE),
  (1, 'Venta', 'Ventas a un comprador', 4, 'comprador', 'Comprador', 'string', FALSE),
  (2, 'Pedido', 'Encargos a un suministrador', 1, 'referencia', 'Referencia Pedido', 'string', TRUE),
  (2, 'Pedido', 'Encargos a un suministrador', 2, 'pedido_el', 'Pedido el', 'date', TRUE),
  (2, 'Pedido', 'Encargos a un suministrador', 3, 'suministrador', 'Suministrador', 'string', TRUE),
  (2, 'Pedido', 'Encargos a un suministrador', 4, 'valor_pedido', 'Valor Pedido', 'number', TRUE),
  (2, 'Pedido', 'Encargos a un suministrador', 5, 'avance', 'Avance', 'string', FALSE),
  (3, 'Entrega', 'Bultos recibidos', 1, 'bultos', 'Bultos', 'number', FALSE),
  (3, 'Entrega', 'Bultos recibidos', 2, 'destino', 'Destino', 'string', FALSE),
  (3, 'Entrega', 'Bultos recibidos', 3, 'recibido_por', 'Recibido por', 'string', FALSE)
) AS t(type_id, type_name, description, position, name, label, type, required)""",
}

# As-of instants of the fixture data (fixed values).
ASOF_EVENTS = "2024-01-31 00:00:00"
ASOF_ORDERS = "2001-08-01 00:00:00"

_VIEW_RE = re.compile(r"\bv_[a-z_]+\b")


def _deps(name: str) -> list[str]:
    return [v for v in dict.fromkeys(_VIEW_RE.findall(VIEW_SQL[name])) if v != name and v in VIEW_SQL]


def views_needed(sql: str) -> list[str]:
    """Fixture views referenced by ``sql`` plus their dependencies, in
    definition order."""
    seen: set[str] = set()
    stack = [v for v in _VIEW_RE.findall(sql) if v in VIEW_SQL]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            stack.extend(_deps(v))
    return [v for v in VIEW_SQL if v in seen]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it reads, as CTEs (for the
    DuckDB oracle, where only the base tables are registered)."""
    needed = views_needed(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


@dataclass
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL or name in BASE_TABLES:
            return self.spark.table(name)
        raise AttributeError(name)


def _document_types(spark: SparkSession) -> DataFrame:
    """Same rows as the ``v_document_types`` SQL, without a cross join: the
    distinct priorities (a handful) become an array by scalar subquery that
    every customer row explodes."""
    from pyspark.sql import functions as F
    o = spark.table("orders")
    prios = (o.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("k"),
                      F.substring("o_orderpriority", 3, 1 << 20).alias("name")).distinct()
             .agg(F.collect_list(F.struct("k", "name"))).scalar())
    c = spark.table("customer").select("c_custkey", "c_nationkey", F.explode(prios).alias("p"))
    c = c.filter((F.col("c_custkey") + F.col("p.k")) % 3 != 0)
    return c.select((F.col("c_custkey") * 10 + F.col("p.k")).alias("id"), F.col("c_custkey").alias("user_id"),
                    F.col("p.name").alias("name"),
                    F.when(F.col("p.k") % 2 == 0, F.concat(F.lit("Tipo "), F.col("p.name"))).alias("description"),
                    F.col("c_nationkey").alias("nation_key"))


DATAFRAME_VIEWS = {"v_document_types": _document_types}

_registered: dict[int, str] = {}


def register(spark: SparkSession, sf_dir: str) -> Fixtures:
    """Register the base tables (parquet scans) and fixture views as temp
    views of this session. Cheap: nothing is read until an action runs."""
    pin_session(spark)
    key = id(spark)
    if _registered.get(key) != sf_dir or not spark.catalog.tableExists("v_documents"):
        for t in BASE_TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        for name, body in VIEW_SQL.items():
            if name in DATAFRAME_VIEWS:
                DATAFRAME_VIEWS[name](spark).createOrReplaceTempView(name)
            else:
                spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {body}")
        _registered[key] = sf_dir
    return Fixtures(spark, sf_dir)
