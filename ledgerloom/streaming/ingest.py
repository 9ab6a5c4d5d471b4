"""Ingestion of files as a batch job, and its Structured Streaming forms: an extension, since the reference only polls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.chunking import chunk_documents
from ledgerloom.operators.ledger import append_log, swap, upsert_latest
from ledgerloom.operators.retrieval import embed
from ledgerloom.session import stored
from ledgerloom.sources.objects import PARSERS, extract_typed, folder_exists, load_points


def stream(spark: SparkSession, schema, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once; state is dropped behind the watermark."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(rows: DataFrame, time: str, by: str, window: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Rows per window and group; windows close behind the watermark. late=None keeps the watermark that `rows` has."""
    if late is not None:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def upserts(rows: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str, version: list[str], checkpoint: str) -> StreamingQuery:
    """Folds each micro-batch into a table by key, last version wins; replaying a batch changes nothing."""

    def fold(batch: DataFrame, _: int) -> None:
        old = read()
        write(upsert_latest(batch.limit(0) if old is None else old, batch, key, version))

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, root: str, store: str, force: bool = False, embedder=embed, parsers=None) -> DataFrame:
    """Files under root (document type/company/year_title) into chunks, points, the ledger of documents and the log; returns what the run did.

    Files the ledger has as ingested are left out unless `force`. A file that can't be read, or gives no
    chunk, fails for itself: its status is 2 and the log has its message. The store holds points,
    documents and log as tables; each is replaced or appended as a whole, so a run can be repeated.
    """
    at = F.current_timestamp()
    blocks = stored(extract_typed(spark, root, parsers=parsers or PARSERS))
    key = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)
    parsed = blocks.withColumn("minio_key", key).withColumn("doc_id", F.xxhash64("minio_key"))
    if not force and folder_exists(spark, f"{store}/documents"):
        done = spark.read.parquet(f"{store}/documents").where("ingested = 1").select("minio_key")
        parsed = parsed.join(done, "minio_key", "left_anti")
    path = F.split("minio_key", "/")
    about = parsed.groupBy("doc_id", "minio_key", "doc_type").agg(F.max("error").alias("error")).select(
        "doc_id", "minio_key", "doc_type", "error", F.upper(path[1]).alias("symbol"), F.regexp_replace(path[2], r"\.[^.]*$", "").alias("title"), F.regexp_extract(path[2], r"^(\d{4})", 1).try_cast("int").alias("year")
    )
    good = parsed.where("error is null").withColumns({"page_num": F.lit(1), "section": F.lit(None).cast("string"), "speaker": F.lit(None).cast("string"), "speaker_role": F.lit(None).cast("string")})
    rows = F.when(F.col("block_type") == "table", F.transform(F.split("text", "\n"), lambda line: F.split(line, r" \| ")))
    chunks = stored(chunk_documents(good.withColumn("table_data", rows), about.select("doc_id", "symbol", "year")).join(about.select("doc_id", "minio_key", "doc_type", "symbol", "year", "title"), "doc_id").withColumn("loaded_at", at))
    load_points(chunks, f"{store}/points", embedder)
    counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
    outcome = stored(about.join(counts, "doc_id", "left").withColumn("ok", F.col("chunks").isNotNull()).withColumn("message", F.when(~F.col("ok"), F.coalesce("error", F.lit("no chunks")))).withColumn("duration_sec", F.lit(None).cast("double")))
    new = outcome.select("minio_key", "symbol", "doc_type", "year", "title", F.when(F.col("ok"), 1).otherwise(2).cast("tinyint").alias("ingested"), F.coalesce("chunks", F.lit(0)).alias("total_chunks"), "message").withColumn("at", at)
    old = spark.read.parquet(f"{store}/documents") if folder_exists(spark, f"{store}/documents") else new.limit(0)
    swap(upsert_latest(old, new, "minio_key", ["at"]), f"{store}/documents")
    append_log(outcome, at, f"{store}/log")
    return outcome.select("minio_key", "ok", "chunks", "message")
