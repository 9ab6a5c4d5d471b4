"""Problem 7: lines that one source repeats across its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.whitespace import squeeze
from ledgerloom.session import stored

SALTS = 16


def _lines(chunks: DataFrame) -> DataFrame:
    """Every line that can count: chunk_id, source, line_no (from 1), h1 and h2 (independent 64-bit hashes of the normalised line)."""
    source = F.lower(squeeze("symbol"))
    lines = chunks.select("chunk_id", source.alias("source"), "text").where(F.col("source").isNotNull() & F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).select(
        "chunk_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    norm = F.lower(squeeze("line"))
    return (
        lines.where(~((F.col("pos") == 0) & F.ltrim("line").startswith("[")))
        .select("chunk_id", "source", (F.col("pos") + 1).alias("line_no"), norm.alias("norm")).where(F.col("norm") != "")
        .select("chunk_id", "source", "line_no", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"))
    )


def frequent_lines(lines: DataFrame, min_chunks: int = 6, min_share: float = 0.0) -> DataFrame:
    """Lines in at least `min_chunks` distinct chunk_ids of a source and at least `min_share` of all its chunk_ids."""
    seen = lines.select("source", "h1", "h2", F.xxhash64("chunk_id").alias("c1"), F.xxhash64(F.lit(7), "chunk_id").alias("c2")).distinct()
    counted = seen.groupBy("source", "h1", "h2").agg(F.count("*").alias("chunks")).where(F.col("chunks") >= min_chunks)
    if min_share > 0:
        totals = seen.select("source", "c1", "c2").distinct().groupBy("source").agg(F.count("*").alias("total"))
        counted = counted.join(totals, "source").where(F.col("chunks") >= min_share * F.col("total")).drop("total")
    return counted


def repeated_lines(chunks: DataFrame, min_chunks: int = 6, min_share: float = 0.0) -> DataFrame:
    """Each occurrence of a repeated line: chunk_id, line_no.

    Lines are compared without case, outer white space and runs of it; sources without case and outer
    white space. NULL sources, ids and texts, blank lines and a first line that starts with "[" don't
    count; repeated rows count once; a line several times in one chunk counts once towards the
    threshold and gives one row per occurrence. Empty tables give no rows; extra columns are ignored.

    Texts are split and normalised once; the hashes of the lines, 128 bits each, are written to the
    shared folder and read for the counts and for the way back. Only hashes are shuffled. A hot line has
    as many rows as documents, so counts are aggregated before the shuffle, and for the way back the
    list of frequent lines (at most lines / min_chunks) is repeated SALTS times and the occurrences are
    spread over the salts by their chunk.
    """
    lines = stored(_lines(chunks))
    salted = frequent_lines(lines, min_chunks, min_share).select("source", "h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = lines.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["source", "h1", "h2", "salt"], "left_semi").select("chunk_id", "line_no").distinct()


def without_lines(chunks: DataFrame, repeated: DataFrame) -> DataFrame:
    """chunk_id, text and removed (number of lines) of every chunk, rebuilt without its repeated lines.

    A NULL text stays NULL. Rows of one chunk_id with different texts each lose the lines of their number.
    """
    gone = repeated.groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i + 1))
    return (
        chunks.select("chunk_id", "text").distinct().join(gone, "chunk_id", "left")
        .select("chunk_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
    )
