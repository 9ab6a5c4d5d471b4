"""Queries of the general training-data problems (1 and 6) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import references as refs
from ledgerloom.operators import units
from ledgerloom.sources.tables import table


def _named(spark: SparkSession, d: str) -> DataFrame:
    return units.named_units(table(spark, d, "metric_rows"), table(spark, d, "concall_claims"), table(spark, d, "metric_units"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose unit or scale isn't the common one."""
    return units.in_other_units(_named(spark, d))


def p1_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every figure in its common unit."""
    return units.to_common_units(_named(spark, d), table(spark, d, "fx_rates"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = {name: table(spark, d, name) for name in ("rag_chunks", "rag_documents", "rag_companies", "chunks")}
    return refs.references(tables), refs.key_facts(tables, table(spark, d, "deleted_rows"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references, one row each."""
    return refs.orphans(*_references(spark, d)).select("child_table", "ref_field", "child_id", "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    return refs.orphan_counts(*_references(spark, d))


_ORPHANS = r"""
WITH uuid_rows AS (
  SELECT id, created_at, lower(trim(qdrant_id)) AS t FROM rag_chunks WHERE qdrant_id IS NOT NULL),
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'rag_chunks' AS child_table, 'doc_id' AS ref_field, id AS child_id, CAST(doc_id AS VARCHAR) AS key, created_at AS seen
      FROM rag_chunks WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT 'rag_chunks', 'qdrant_id', id, regexp_replace(regexp_replace(t, '^urn:uuid:', ''), '[\s{}()-]', '', 'g'), created_at FROM uuid_rows
    UNION ALL
    SELECT 'rag_documents', 'company_id', id, CAST(company_id AS VARCHAR), created_at FROM rag_documents WHERE company_id IS NOT NULL)),
parents AS (
  SELECT child_table, ref_field, key, min(since) AS since FROM (
    SELECT 'rag_chunks' AS child_table, 'doc_id' AS ref_field, CAST(id AS VARCHAR) AS key, created_at AS since FROM rag_documents
    UNION ALL SELECT 'rag_chunks', 'qdrant_id', replace(lower(trim(chunk_id)), '-', ''), loaded_at FROM chunks
    UNION ALL SELECT 'rag_documents', 'company_id', CAST(id AS VARCHAR), created_at FROM rag_companies) GROUP BY ALL),
gone AS (
  SELECT DISTINCT CASE table_name WHEN 'rag_companies' THEN 'rag_documents' ELSE 'rag_chunks' END AS child_table,
    CASE table_name WHEN 'rag_documents' THEN 'doc_id' WHEN 'chunks' THEN 'qdrant_id' ELSE 'company_id' END AS ref_field,
    CASE table_name WHEN 'chunks' THEN replace(lower(trim(row_key)), '-', '') ELSE trim(row_key) END AS key
  FROM deleted_rows WHERE table_name IN ('rag_documents', 'chunks', 'rag_companies')),
orphans AS (
  SELECT r.child_table, r.ref_field, r.child_id, r.seen,
    CASE WHEN p.key IS NOT NULL AND p.since > r.seen THEN 'late' WHEN p.key IS NOT NULL THEN NULL
         WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
  FROM refs r LEFT JOIN parents p USING (child_table, ref_field, key) LEFT JOIN gone g USING (child_table, ref_field, key))
"""

QUERIES = {"p1_found": p1_found, "p1_converted": p1_converted, "p6_found": p6_found, "p6_report": p6_report}

ORACLE = {
    "p6_found": _ORPHANS + "SELECT child_table, ref_field, child_id, reason FROM orphans WHERE reason IS NOT NULL",
    "p6_report": _ORPHANS + """SELECT child_table, ref_field, strftime(seen, '%Y-%m') AS period, reason, count(*) AS orphans
      FROM orphans WHERE reason IS NOT NULL GROUP BY ALL""",
}
