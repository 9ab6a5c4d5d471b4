"""Queries of the corpus problems (2 to 5 and 7 to 10) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.whitespace import RE2
from ledgerloom.llm import boilerplate, mixing, nearcopies, scans, splitting, tokens, truncation, turns
from ledgerloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Where each person's turns start, and who a chunk's speaker names."""
    return turns.named_people(table(spark, d, "page_blocks"), table(spark, d, "chunks"), table(spark, d, "call_participants"))


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with its person and clean text."""
    return turns.clean_turns(table(spark, d, "page_blocks"), table(spark, d, "call_participants"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over their limit."""
    return splitting.oversized(table(spark, d, "chunks"), table(spark, d, "split_limits"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of chunks over their limit."""
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "split_limits"), splitting.page_words(table(spark, d, "page_blocks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Noise of scanned pages by block and kind."""
    return scans.noise_found(table(spark, d, "page_blocks"))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Readable paragraphs by document and page."""
    return scans.paragraphs(table(spark, d, "page_blocks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks with nearly the same text."""
    return nearcopies.pairs(nearcopies.near_copies(table(spark, d, "chunks")))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's class of equal shingles and its number of near classes."""
    return nearcopies.classes(nearcopies.near_copies(table(spark, d, "chunks")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of lines repeated within a symbol."""
    return boilerplate.repeated_lines(table(spark, d, "chunks"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's text without repeated lines."""
    chunks = table(spark, d, "chunks")
    return boilerplate.without_lines(chunks, boilerplate.repeated_lines(chunks))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts drawn and how often."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Natural and tempered shares of all sources."""
    return mixing.tempered_shares(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that end before their author's end."""
    return truncation.truncated(truncation.truncation_scores(table(spark, d, "documents")))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts texts off."""
    return truncation.truncation_rates(truncation.truncation_scores(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p2_found, p2_turns, p3_found, p3_pieces, p4_found, p4_paragraphs, p5_found, p5_classes, p7_found, p7_clean, p8_ids, p9_mix, p9_shares, p9_tempered, p10_found, p10_rates)}

_LINES = f"""
WITH c AS (SELECT DISTINCT chunk_id, lower(trim(regexp_replace(symbol, '[{RE2}]+', ' ', 'g'))) AS source, text FROM chunks WHERE symbol IS NOT NULL AND text IS NOT NULL AND chunk_id IS NOT NULL),
l AS (SELECT chunk_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM c),
n AS (SELECT chunk_id, source, line_no, lower(trim(regexp_replace(line, '[{RE2}]+', ' ', 'g'))) AS norm FROM l WHERE NOT (line_no = 1 AND ltrim(line) LIKE '[%')),
f AS (SELECT source, norm FROM n WHERE norm <> '' GROUP BY ALL HAVING count(DISTINCT chunk_id) >= 6)
"""

ORACLE = {
    "p3_found": rf"""SELECT DISTINCT chunk_id FROM chunks c JOIN split_limits s USING (doc_type, chunk_type)
      WHERE len(regexp_extract_all(text, '[^{RE2}]+')) > max_words""",
    "p7_found": _LINES + "SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN f USING (source, norm)",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
