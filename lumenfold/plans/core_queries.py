"""Queries of the core operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.operators import incremental
from lumenfold.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p7_found",
    """
    WITH ok AS (SELECT started_at, finished_at FROM index_runs WHERE outcome = 'success'),
    com AS (SELECT * FROM files f WHERE coalesce(status, '') <> 'error' AND EXISTS (
        SELECT 1 FROM ok WHERE f.last_indexed_at BETWEEN ok.started_at AND ok.finished_at)),
    cur AS (SELECT id, content_hash, size, mtime, status FROM files WHERE id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
    base AS (SELECT id, content_hash, size, mtime, status FROM com WHERE id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
    j AS (SELECT c.id AS file_id, coalesce(c.status = 'deleted', false) AS gone, b.id IS NOT NULL AS has_base,
        CASE WHEN c.content_hash IS NULL OR b.content_hash IS NULL
             THEN c.size IS DISTINCT FROM b.size OR c.mtime IS DISTINCT FROM b.mtime
             ELSE c.content_hash <> b.content_hash END AS differs
        FROM cur c LEFT JOIN (SELECT * FROM base WHERE status IS DISTINCT FROM 'deleted') b ON c.id = b.id)
    SELECT file_id, action FROM (SELECT file_id, CASE WHEN gone AND has_base THEN 'delete' WHEN NOT gone AND NOT has_base THEN 'add'
        WHEN NOT gone AND has_base AND differs THEN 'change' END AS action FROM j) WHERE action IS NOT NULL
    """,
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending(table(spark, sf_dir, "files"), table(spark, sf_dir, "index_runs"))
