"""Sorts, pages, top-k and set operations.

Per-tenant top-k uses ``row_number() <= k`` so Catalyst inserts a partial
WindowGroupLimit before the shuffle: each map task ships at most k rows per
tenant, which keeps a tenant holding a third of the data cheap. Totals come
from partial aggregates joined back, never from a window over the tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_size

MAX_PAGE_SIZE, DEFAULT_PAGE_SIZE = 100, 20


def clamp_page(page, limit) -> tuple[int, int]:
    """F1 request parsing: page >= 1; limit in 1..100, default 20."""
    try:
        p = int(page) if page not in (None, "") else 1
    except (TypeError, ValueError):
        p = 1
    try:
        lim = int(limit) if limit not in (None, "") else DEFAULT_PAGE_SIZE
    except (TypeError, ValueError):
        lim = DEFAULT_PAGE_SIZE
    if lim == 0:
        lim = DEFAULT_PAGE_SIZE  # parseInt(...) || 20
    return max(1, p), min(MAX_PAGE_SIZE, max(1, lim))


def newest_first() -> tuple[Column, ...]:
    return (F.col("created_at").desc(), F.col("id").desc())


def top_k_per_group(df: DataFrame, group_cols, order: tuple[Column, ...], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group (ties broken by the order given)."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def paginate(df: DataFrame, page=1, limit=20, group_cols=None, order=None) -> DataFrame:
    """page of ``limit`` rows, newest first, with total and total_pages.

    Without ``group_cols`` it is one tenant's page (distributed
    TakeOrdered with offset); with ``group_cols`` every group's page at once."""
    p, lim = clamp_page(page, limit)
    order = order or newest_first()
    if not group_cols:
        total = df.groupBy().agg(F.count(F.lit(1))).scalar()  # scalar subquery
        out = df.orderBy(*order).offset((p - 1) * lim).limit(lim).withColumn("total", total)
    else:
        ranked = top_k_per_group(df, group_cols, order, p * lim, "rank")
        rows = ranked.filter(F.col("rank") > (p - 1) * lim)
        total = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("total"))
        out = rows.join(total, list(group_cols), "inner")
    return (out.withColumn("page", F.lit(p)).withColumn("limit", F.lit(lim))
            .withColumn("total_pages", F.ceil(F.col("total") / F.lit(lim)).cast("bigint")))


def activity_text(status, filename) -> Column:
    """Status sentence of the activity feed."""
    s, f = F.col(status), F.col(filename)
    return (F.when(s == "completed", F.format_string('Documento "%s" procesado exitosamente', f))
            .when(s == "processing", F.format_string('Procesando documento "%s"', f))
            .otherwise(F.format_string('Error al procesar "%s"', f)))


def recent_activity(docs: DataFrame, n: int = 5, group_cols=("user_id",)) -> DataFrame:
    """newest ``n`` documents per tenant with their activity text."""
    top = top_k_per_group(docs, list(group_cols), newest_first(), n)
    return top.withColumn("text", activity_text("status", "filename"))


def sort_documents(docs: DataFrame, field: str = "date", group_cols=("user_id",)) -> DataFrame:
    """name asc, date desc, size (estimated) desc, status asc; id breaks
    ties. A global range-partitioned sort, so a large tenant spreads over
    many tasks."""
    keys = {
        "name": [F.col("filename").asc()],
        "date": [F.col("created_at").desc()],
        "size": [estimate_size("filename").desc()],
        "status": [F.col("status").asc()],
    }[field]
    return docs.orderBy(*[F.col(g) for g in group_cols], *keys, F.col("id").asc())


def take_queued(docs: DataFrame, n: int = 20, group_cols=("user_id",)) -> DataFrame:
    """up to ``n`` queued documents per tenant (oldest first, then id)."""
    q = docs.filter(F.col("status") == "queued")
    return top_k_per_group(q, list(group_cols), (F.col("created_at").asc(), F.col("id").asc()), n)


MAX_ROWS, PREVIEW_ROWS = 1000, 25


def cap_rows(df: DataFrame, order: tuple[Column, ...], max_rows: int = MAX_ROWS,
             preview: int = PREVIEW_ROWS) -> DataFrame:
    """at most ``max_rows`` rows (distributed top-k), with the preview
    flag and whether the input was truncated."""
    total = df.groupBy().agg(F.count(F.lit(1))).scalar()  # scalar subquery
    capped = df.orderBy(*order).limit(max_rows)
    # numbering max_rows (<= 1000) rows in one task is bounded work
    w = Window.orderBy(*order)
    capped = capped.withColumn("row_no", F.row_number().over(w))
    return (capped.withColumn("in_preview", F.col("row_no") <= preview)
            .withColumn("truncated", total > max_rows))


def top_users(docs: DataFrame, costs: DataFrame | None = None, k: int = 10) -> DataFrame:
    """users by document count, then cost (pre-aggregated, then top-k)."""
    per_user = docs.groupBy("user_id").agg(F.count(F.lit(1)).alias("doc_count"))
    if costs is not None:
        c = costs.groupBy("user_id").agg(F.sum("cost_usd").alias("cost_usd"))
        per_user = per_user.join(c, "user_id", "left").withColumn(
            "cost_usd", F.round(F.coalesce(F.col("cost_usd"), F.lit(0.0)), 6))
    order = [F.col("doc_count").desc()] + ([F.col("cost_usd").desc()] if costs is not None else []) \
        + [F.col("user_id").asc()]
    return per_user.orderBy(*order).limit(k)


def recent_users(docs: DataFrame, subs: DataFrame, k: int = 10) -> DataFrame:
    """newest users (first upload) with plan and document count."""
    per_user = docs.groupBy("user_id").agg(F.min("created_at").alias("first_seen"),
                                           F.count(F.lit(1)).alias("doc_count"))
    top = per_user.orderBy(F.col("first_seen").desc(), F.col("user_id").desc()).limit(k)
    return top.join(subs.select("user_id", "plan"), "user_id", "left")


def list_types(types: DataFrame, tenant, order_col: str = "id") -> DataFrame:
    """F8: the tenant's types, newest first (page/limit are ignored as in
    the original)."""
    from .gates import tenant_view
    return tenant_view(types, tenant).orderBy(F.col(order_col).desc())


def type_options_union(inferred: DataFrame, existing: DataFrame, user_col="user_id") -> DataFrame:
    """G1 (and C14): inferred names (new) ∪ existing types whose name is not
    among the inferred ones of the same tenant."""
    inf = inferred.select(user_col, F.lit(None).cast("bigint").alias("type_id"),
                          F.col("name"), F.lit(True).alias("is_new")).distinct()
    ex = existing.join(inferred.select(user_col, "name"), [user_col, "name"], "left_anti")
    ex = ex.select(user_col, F.col("id").alias("type_id"), "name", F.lit(False).alias("is_new"))
    return inf.unionByName(ex)


def merge_results(*parts: DataFrame) -> DataFrame:
    """Union of result tables with differing columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
