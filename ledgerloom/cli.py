"""Command line: ingest files, list what is stored, and its counts."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from ledgerloom.operators.ledger import run_totals
from ledgerloom.session import build_session, logger
from ledgerloom.sources.objects import folder_exists
from ledgerloom.streaming.ingest import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("store", help="folder of the tables points, documents and log")
    p.add_argument("--root", help="folder of files to ingest: document type/company/year_title")
    p.add_argument("--symbol", help="only this company (listing)")
    p.add_argument("--type", dest="doc_type", help="only this type of document (listing)")
    p.add_argument("--year", type=int, help="only this year (listing)")
    p.add_argument("--force", action="store_true", help="ingest again what is ingested already")
    p.add_argument("--stats", action="store_true", help="counts of the log")
    p.add_argument("--list", action="store_true", help="the documents of the ledger")
    p.add_argument("--master", help="Spark master")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 if all went well, 1 if a document failed or there is nothing stored."""
    a, log, failed = parser().parse_args(argv), logger("ledgerloom"), 0
    spark = spark or build_session("ledgerloom", a.master)
    if a.root:
        done = ingest(spark, a.root, a.store, a.force)
        failed = done.where(~F.col("ok")).count()
        log.info("%d documents, %d failed", done.count(), failed)
    if (a.stats or a.list) and not folder_exists(spark, f"{a.store}/documents"):
        log.error("nothing is stored in %s", a.store)
        return 1
    if a.list:
        found = spark.read.parquet(f"{a.store}/documents").where(F.lit(True) if not a.symbol else F.col("symbol") == a.symbol.upper())
        found = found.where(F.col("doc_type") == a.doc_type) if a.doc_type else found
        found = found.where(F.col("year") == a.year) if a.year else found
        found.orderBy("symbol", "doc_type", "year", "minio_key").show(1000, False)
    if a.stats:
        run_totals(spark.read.parquet(f"{a.store}/log")).show()
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
