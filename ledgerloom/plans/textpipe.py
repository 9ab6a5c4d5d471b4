"""Queries of the text pipeline (F01-F09, P14, W08-W12, X01-X08, X14, S07) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as t
from ledgerloom.functions.whitespace import RE2
from ledgerloom.operators import chunking as c
from ledgerloom.sources.tables import table


def clean_ascii(spark: SparkSession, d: str) -> DataFrame:
    """Aggressively cleaned documents."""
    return table(spark, d, "documents").select("doc_id", t.clean(F.col("text"), aggressive=True, normal_form=False).alias("clean"))


def clean_normal_form(spark: SparkSession, d: str) -> DataFrame:
    """Documents cleaned gently, in compatibility normal form."""
    return table(spark, d, "documents").select("doc_id", t.clean(F.col("text")).alias("clean"))


def garbage_filter(spark: SparkSession, d: str) -> DataFrame:
    """Words and tokens of documents, and whether they are garbage."""
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.size(t.words(F.col("text"))).alias("words"), t.approx_tokens(F.col("text")).alias("tokens"), t.is_garbage(F.col("text")).alias("garbage"))


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of words."""
    return c.windows(table(spark, d, "documents").select("doc_id", "text"), size=60, overlap=10).select("doc_id", "window_no", "window_text")


def table_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tables in groups of eight rows under their header."""
    blocks = c.one_per_place(table(spark, d, "page_blocks").where("table_data is not null"))
    return c.row_groups(blocks.select("doc_id", "block_index", "table_data")).select("doc_id", "block_index", "group_no", c.table_text("group_rows").alias("text"))


def tag_importance(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval tags and importance of chunks."""
    x = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return x.select("chunk_id", F.array_join(c.tags(), ",").alias("tags"), c.importance().alias("importance"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of each chunk."""
    x = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).withColumn("retrieval_tags", c.tags())
    return x.select("chunk_id", F.md5(c.embedding_text()).alias("digest"))


def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Every annual report block under its section header."""
    return c.with_sections(_blocks(spark, d, "annual_report")).select("doc_id", "block_index", "carried_section")


def speaker_roles(spark: SparkSession, d: str) -> DataFrame:
    """Parts of speakers told by their labels."""
    return table(spark, d, "call_participants").distinct().select("participant_id", c.speaker_role(F.concat_ws(" ", "full_name", "designation", "firm")).alias("role"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of each page in block order."""
    b = c.one_per_place(table(spark, d, "page_blocks").where("page_num > 0").select("doc_id", "page_num", "block_index", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), "\n")
    return b.groupBy("doc_id", "page_num").agg(F.md5(joined).alias("digest"), F.count("*").alias("blocks"))


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each document."""
    return table(spark, d, "page_blocks").groupBy("doc_id").agg(F.max("page_num").alias("pages"))


def speaker_turn_split(spark: SparkSession, d: str) -> DataFrame:
    """Turns split from call pages by labels at line starts."""
    return _blocks(spark, d, "concall").select("doc_id", "block_index", F.posexplode(c.speaker_turns("text")).alias("part", "turn")).select("doc_id", "block_index", "part", "turn.speaker", "turn.speech")


def _blocks(spark: SparkSession, d: str, doc_type: str) -> DataFrame:
    return c.one_per_place(table(spark, d, "page_blocks").where(F.col("doc_type") == doc_type))


def report_packs(spark: SparkSession, d: str) -> DataFrame:
    """Which prose of reports is chunked together."""
    return c.report_packs(_blocks(spark, d, "annual_report"))


def call_packs(spark: SparkSession, d: str) -> DataFrame:
    """Which turns of calls are chunked together."""
    return c.call_packs(_blocks(spark, d, "concall").where("block_type <> 'section_header'"))


def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, tagged."""
    about = table(spark, d, "rag_documents").select(F.col("id").alias("doc_id"), "symbol", F.col("year").cast("int").alias("year"))
    x = c.chunk_documents(table(spark, d, "page_blocks"), about)
    return x.select("chunk_id", "doc_id", "chunk_index", "chunk_type", "section", "speaker", "page_start", "page_end", "word_count", "text", c.importance().alias("importance_score"))


_DEFS = (clean_ascii, clean_normal_form, garbage_filter, word_windows, table_row_groups, tag_importance, embedding_text, section_carry_forward, speaker_roles, page_text, page_counts, speaker_turn_split, report_packs, call_packs, chunked_documents)
QUERIES = {f.__name__: f for f in _DEFS}


def _nested(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


_CHARS = "replace(replace(replace(replace(replace(text, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
_SINGLE = f"translate({_CHARS}, '{t.SINGLE_FROM}', '{t.SINGLE_TO.replace(chr(39), chr(39) * 2)}')"
_NOISE = [(p.replace("\\u0900-\\u097F", "\\x{0900}-\\x{097F}").replace("\\x00-\\x7F", "\\x{00}-\\x{7F}"), n) for p, n in t.NOISE]
_UNITS = [(rf"(?i)\b{a}\.?\b", b) for a, b in t.UNIT_WORDS]
_TIDY = [(r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"(?m)[ \t]+$", ""), (r"^\s+|\s+$", "")]
_WORDS = f"len(regexp_extract_all(text, '[^{RE2}]+'))"


def _any(terms: tuple[str, ...], column: str = "lower(coalesce(text, ''))") -> str:
    return "(" + " OR ".join(f"contains({column}, '{x}')" for x in terms) + ")"


_TAGS = [f"CASE WHEN {_any(terms)} THEN '{tag}' END" for tag, terms in c.TAG_WORDS] + [f"CASE WHEN chunk_type = 'speaker_turn' AND speaker_role = '{r}' THEN '{tag}' END" for r, tag in (("analyst", "analyst_question"), ("management", "management_commentary"))]
_SCORE = "CASE WHEN chunk_type = 'speaker_turn' THEN 0.85::DOUBLE WHEN chunk_type = 'prose' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END"
for _terms, _more in ((c.OUTLOOK, 0.2), (c.RISK, 0.1), (c.OPPORTUNITY, 0.15)):
    _SCORE = f"least(1.0::DOUBLE, round({_SCORE} + CASE WHEN {_any(_terms)} THEN {_more}::DOUBLE ELSE 0.0::DOUBLE END, 2))"
_TAG_LIST = f"concat_ws(',', {', '.join(_TAGS)})"
_LABEL = "lower(concat_ws(' ', full_name, designation, firm))"



def _packs(kept: str, size: str, starts: str, held: str, over: str) -> str:
    """The fold block by block: starts says whether a block begins a pack, held and over what is held after it."""
    return rf"""WITH RECURSIVE b AS (SELECT DISTINCT ON (doc_id, block_index) doc_id, block_index, block_type, speaker_role, text, coalesce({_WORDS}, 0) AS n FROM page_blocks WHERE {kept}),
      k AS (SELECT *, {size} AS size, block_type IN ('section_header', 'table') AS edge, speaker_role = 'analyst' AND regexp_matches(lower(substring(text, 1, 100)), '\?|question|could you|can you|what is|how do') AS asks FROM b),
      o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS rn FROM k WHERE edge OR size > 0),
      f AS (SELECT doc_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS INTEGER) AS block_index, CAST(NULL AS INTEGER) AS pack, CAST(0 AS BIGINT) AS held FROM o WHERE rn = 1
        UNION ALL SELECT o.doc_id, o.rn, o.block_index, CASE WHEN o.edge THEN NULL WHEN {starts} THEN o.block_index ELSE f.pack END, CASE WHEN o.edge THEN 0 WHEN {over} THEN 0 ELSE {held} END FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1)
      SELECT doc_id, block_index, pack FROM f WHERE pack IS NOT NULL"""


_NEW = "(f.held = 0 OR f.held + o.size > 1024 OR o.asks)"

ORACLE = {
    "report_packs": _packs("doc_type = 'annual_report'", "CASE WHEN block_type = 'prose' THEN n ELSE 0 END", "f.held = 0", "f.held + o.size", "floor((f.held + o.size) * 1.3::DOUBLE) > 1024"),
    "call_packs": _packs("doc_type = 'concall' AND block_type <> 'section_header'", "CAST(floor(n * 1.3::DOUBLE) AS BIGINT)", _NEW, f"CASE WHEN {_NEW} THEN o.size ELSE f.held + o.size END", "false").replace("block_type IN ('section_header', 'table') AS edge", "false AS edge"),
    "clean_ascii": f"SELECT doc_id, {_nested(_SINGLE, [*_NOISE, *_UNITS, *_TIDY])} AS clean FROM documents",
    "garbage_filter": f"""SELECT doc_id, CAST({_WORDS} AS INTEGER) AS words, CAST(floor({_WORDS} * 1.3) AS INTEGER) AS tokens,
      {_WORDS} < 20 OR coalesce(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / nullif(length(text), 0), 0) < 0.4 AS garbage FROM documents WHERE text IS NOT NULL""",
    "word_windows": f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^{RE2}]+') AS ws FROM documents), n AS (SELECT doc_id, ws, len(ws) AS n FROM w WHERE len(ws) > 0),
      s AS (SELECT doc_id, ws, unnest(CASE WHEN n <= 60 THEN [0] ELSE range(0, CAST(ceil((n - 60) / 50.0) AS BIGINT) * 50 + 1, 50) END) AS at FROM n)
      SELECT doc_id, CAST(s.at // 50 AS INTEGER) AS window_no, array_to_string(ws[s.at + 1 : s.at + 60], ' ') AS window_text FROM s""".replace(" AS at FROM n", " AS pos FROM n").replace("s.at", "s.pos"),
    "table_row_groups": """WITH b AS (SELECT DISTINCT ON (doc_id, block_index) doc_id, block_index, table_data AS r FROM page_blocks WHERE table_data IS NOT NULL), g AS (SELECT *, unnest(range(0, len(r), 8)) AS pos FROM b WHERE len(r) > 0)
      SELECT doc_id, block_index, CAST(pos // 8 AS INTEGER) AS group_no, array_to_string(list_transform(CASE WHEN pos = 0 THEN r[1:8] ELSE list_concat(r[1:1], r[pos + 1 : pos + 8]) END, lambda x: array_to_string(list_transform(x, lambda y: coalesce(y, '')), ' | ')), chr(10)) AS text FROM g""",
    "tag_importance": f"SELECT DISTINCT chunk_id, {_TAG_LIST} AS tags, {_SCORE} AS importance FROM chunks",
    "embedding_text": f"""SELECT DISTINCT chunk_id, md5(concat_ws(chr(10), concat_ws(' | ', symbol, doc_type, CAST(year AS VARCHAR), section, nullif(replace({_TAG_LIST}, ',', ', '), '')), text)) AS digest FROM chunks""",
    "section_carry_forward": """WITH b AS (SELECT DISTINCT ON (doc_id, block_index) doc_id, block_index, block_type, text FROM page_blocks WHERE doc_type = 'annual_report')
      SELECT doc_id, block_index, coalesce(last_value(CASE WHEN block_type = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General') AS carried_section FROM b""",
    "speaker_roles": f"""SELECT DISTINCT participant_id, CASE WHEN {_any(c.MODERATOR_WORDS, _LABEL)} THEN 'moderator' WHEN {_any(c.MANAGEMENT_WORDS, _LABEL)} THEN 'management' WHEN {_any(c.ANALYST_WORDS, _LABEL)} THEN 'analyst' ELSE 'unknown' END AS role FROM call_participants""",
    "page_text": """WITH b AS (SELECT DISTINCT ON (doc_id, block_index) doc_id, page_num, block_index, text FROM page_blocks WHERE page_num > 0) SELECT doc_id, page_num, md5(string_agg(text, chr(10) ORDER BY block_index)) AS digest, count(*) AS blocks FROM b GROUP BY ALL""",
    "page_counts": "SELECT doc_id, max(page_num) AS pages FROM page_blocks GROUP BY doc_id",
}
