"""B8 guarded_select: run a caller's SELECT over the tenant's views only.

The guard checks the text, then the parsed plan: every relation in it, also
in subqueries and expressions, must be one of the tenant's two views or a name
the statement itself defines. Execution is plain ``spark.sql`` with a named
parameter; the two views are common table expressions over temp views whose
names exist for one call only, so calls of several tenants can run at once.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.gates import tenant_view, tenant_value

# Forbidden patterns, row cap and messages.
FORBIDDEN_PATTERNS = [
    re.compile(r"\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE|EXECUTE|COPY)\b", re.I),
    re.compile(r";\s*\w"),
    re.compile(r"--"),
    re.compile(r"/\*"),
    re.compile(r"`"),
    re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.I),
]
SELECT_ONLY = re.compile(r"^\s*SELECT\b", re.I)
HAS_LIMIT = re.compile(r"\bLIMIT\b", re.I)
MAX_ROWS = 1000
TENANT_PARAM = "$1"

MSG_FORBIDDEN = "La query generada contiene operaciones no permitidas."
MSG_SELECT_ONLY = "Solo se permiten queries SELECT."
MSG_NO_PARAM = "La query no incluye el parámetro de usuario $1. Rechazada por seguridad."


MSG_RELATION = "La query lee algo que no pertenece al usuario: %s"


class GuardError(ValueError):
    pass


def validate_sql(sql: str) -> None:
    for p in FORBIDDEN_PATTERNS:
        if p.search(sql):
            raise GuardError(MSG_FORBIDDEN)
    if not SELECT_ONLY.search(sql):
        raise GuardError(MSG_SELECT_ONLY)
    if TENANT_PARAM not in sql:
        raise GuardError(MSG_NO_PARAM)


def check_relations(spark: SparkSession, sql: str, allowed: tuple[str, ...]) -> None:
    """Reject every relation of the parsed statement but ``allowed`` and the
    statement's own common table expressions, as long as such a name means
    nothing else in the session: paths, qualified names, names computed at run
    time and table functions are all refused."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    if found := re.search(r"PlanWithUnresolvedIdentifier|TableValuedFunction\s*\[[^\]]*\]", plan):
        raise GuardError(MSG_RELATION % found.group())
    own = {n.strip() for names in re.findall(r"CTE \[([^\]]*)\]", plan) for n in names.split(",")}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan):
        if name.lower() in allowed:
            continue
        if name not in own or not re.fullmatch(r"\w+", name) or spark.catalog.tableExists(name):
            raise GuardError(MSG_RELATION % name)


def prepare_safe_query(sql: str, max_rows: int = MAX_ROWS) -> str:
    """Append the row cap when the query has no LIMIT; bind $1 by name."""
    if not HAS_LIMIT.search(sql):
        sql = f"{sql} LIMIT {max_rows}"
    return sql.replace(TENANT_PARAM, ":tenant")


def guarded_select(spark: SparkSession, sql: str, tenant, docs: DataFrame, types: DataFrame,
                   view_names=("my_documents", "my_document_types"), max_rows: int = MAX_ROWS) -> DataFrame:
    """Validate, cap (``max_rows``) and run ``sql`` for ``tenant``. Only the
    two tenant views can be read; a missing tenant sees no rows."""
    validate_sql(sql)
    safe = prepare_safe_query(sql, max_rows)
    check_relations(spark, safe, view_names)
    own = [f"tenant_{uuid.uuid4().hex}" for _ in view_names]
    for df, name in zip((docs, types), own, strict=True):
        tenant_view(df, tenant).createOrReplaceTempView(name)
    views = ", ".join(f"{v} AS (SELECT * FROM {name})" for v, name in zip(view_names, own, strict=True))
    try:
        return spark.sql(f"WITH {views} {safe}", args={"tenant": tenant_value(tenant)}).limit(max_rows)
    finally:
        for name in own:
            spark.catalog.dropTempView(name)
