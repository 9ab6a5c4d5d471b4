"""Queries of the bridge and the ledger (P01-P11, J09, J16, W03, W13, S02, S12-S19, A04, A05, U01-U06, F50-F57) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.fiscal import fiscal_year_of_text, year_of_title
from ledgerloom.operators import bridge as b
from ledgerloom.operators import ledger as l
from ledgerloom.sources import adapters as a
from ledgerloom.sources.tables import table


def _annual(spark: SparkSession, d: str) -> DataFrame:
    pl = a.profit_loss(spark, d)
    return pl.select(F.upper("symbol").alias("symbol"), "fiscal_year", F.make_date("fiscal_year", F.lit(3), F.lit(31)).alias("period_end"), F.round("revenue", 2).alias("sales"))


def bridge_fy_between(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of all companies between two fiscal years, newest first."""
    return b.build(b.Atom("revenue", years=(1998, 1996)), _annual(spark, d))


def bridge_newest(spark: SparkSession, d: str) -> DataFrame:
    """Without years: the newest rows, ten as the need isn't a current one."""
    return b.build(b.Atom("revenue", time_horizon="historical"), _annual(spark, d))


def bridge_period_type(spark: SparkSession, d: str) -> DataFrame:
    """Operating cash flow of the quarters of two fiscal years."""
    year, quarter = a.profit_loss(spark, d), a.profit_loss(spark, d, quarterly=True)
    end = F.make_date("fiscal_year", F.lit(3), F.lit(31))
    both = year.select("symbol", end.alias("period_end"), F.lit("annual").alias("period_type"), "ebitda").unionByName(quarter.select("symbol", F.last_day(F.add_months(end, (F.col("quarter") - 4) * 3)).alias("period_end"), F.lit("quarterly").alias("period_type"), "ebitda"))
    return b.build(b.Atom("ocf", years=(1996, 1997), period_type="quarterly"), both.select(F.upper("symbol").alias("symbol"), "period_end", "period_type", F.round("ebitda", 2).alias("cfo")))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Dividend", "Buyback", "Bonus", "Split"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("action_date"), kind.alias("action_type"), F.col("o_totalprice").alias("value"), F.concat(F.lit("order "), "o_orderkey").alias("notes"))


def bridge_actions(spark: SparkSession, d: str) -> DataFrame:
    """Dividends of two fiscal years among all corporate actions."""
    return b.build(b.Atom("dividend", years=(1996, 1997)), _actions(spark, d))


def bridge_macro(spark: SparkSession, d: str) -> DataFrame:
    """Indicators whose name contains the question's short text."""
    e = table(spark, d, "events").select(F.initcap("event_type").alias("indicator_name"), F.col("ts").cast("date").alias("snapshot_date"), "value", F.lit("index").alias("unit"))
    return b.build(b.Atom("macro", years=(2023, 2024), raw_text="Sign"), e)


def channel_routing(spark: SparkSession, d: str) -> DataFrame:
    """Where each kind of claim is sought for each type of need."""
    kinds = table(spark, d, "concall_claims").select("sub_type").unionByName(table(spark, d, "metric_units").select("sub_type")).where("sub_type is not null").distinct()
    needs = kinds.select("sub_type", F.explode(F.array(*map(F.lit, ("quantitative", "qualitative", "forward_looking", "comparative")))).alias("need_type"))
    return needs.select("sub_type", "need_type", b.channel_of("sub_type", "need_type").alias("channel"))


def retrieval_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one company in several years, by the retrieval filter."""
    c = table(spark, d, "chunks").withColumn("symbol", l.symbol_text())
    return c.where(b.payload_filter(b.year_filter("felurev", [2020, 2022]))).select("chunk_id", "year").distinct()


def period_years(spark: SparkSession, d: str) -> DataFrame:
    """Fiscal years of the period ends of all rows."""
    return table(spark, d, "metric_rows").select("row_id", fiscal_year_of_text("period").alias("fiscal_year")).distinct()


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    """A need for every company: alone, or beside the next one, in one or two years."""
    s = table(spark, d, "supplier").select("s_suppkey", F.upper("s_name").alias("own"))
    n = F.col("s_suppkey")
    after = s.select((n - 1).alias("s_suppkey"), F.col("own").alias("other"))
    both = F.when(n % 3 == 0, F.array_compact(F.array("own", "other"))).otherwise(F.array().cast("array<string>"))
    years = F.when(n % 2 == 0, F.array(F.lit(1996), F.lit(1998))).otherwise(F.array((n % 5 + 1993).cast("int")))
    return s.join(after, "s_suppkey", "left").select(
        n.cast("int").alias("atom_id"), F.lit("revenue").alias("sub_type"), F.when(n % 3 == 0, "comparative").otherwise("quantitative").alias("need_type"), F.when(n % 3 != 0, F.col("own")).alias("symbol"), both.alias("symbols"), years.alias("years"),
        F.when(n % 4 == 1, "historical").otherwise("current").alias("time_horizon"),
    )


def comparative_explode(spark: SparkSession, d: str) -> DataFrame:
    """Needs of all companies, comparisons as one row per company."""
    return b.expand_frame(_atoms(spark, d)).select("atom_id", "symbol", "need_type")


def atoms_range_join(spark: SparkSession, d: str) -> DataFrame:
    """The facts of all needs in one join."""
    return b.rows_of_atoms(b.expand_frame(_atoms(spark, d)), _annual(spark, d)).select("atom_id", "symbol", "fiscal_year", "sales")


def bridge_topn_per_atom(spark: SparkSession, d: str) -> DataFrame:
    """Each need's newest facts."""
    return b.newest_of_atoms(b.expand_frame(_atoms(spark, d)), _annual(spark, d)).select("atom_id", "symbol", "fiscal_year", "sales", "rn")


def payload_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by a filter expression over their payload."""
    where = {"doc_type": "concall", "chunk_type": ["speaker_turn", "prose"], "year": {"$gte": 2019, "$lte": 2022}}
    return table(spark, d, "chunks").where(b.payload_filter(where)).select("chunk_id", "year", "chunk_index").distinct()


def ledger_pending(spark: SparkSession, d: str) -> DataFrame:
    """Annual reports that are still to be ingested."""
    return l.pending(table(spark, d, "rag_documents"), doc_type="annual_report").select("id", l.symbol_text().alias("symbol"), "year").distinct()


def ledger_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Object keys already ingested."""
    return table(spark, d, "rag_documents").where("ingested = 1").select("minio_key").distinct()


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Companies named by documents that the company table lacks."""
    new = table(spark, d, "rag_documents").select(l.symbol_text().alias("symbol"), "id").where("symbol <> ''")
    old = table(spark, d, "rag_companies").select(l.symbol_text().alias("symbol"))
    return l.insert_if_absent(old, new, "symbol", ["id"])


def insert_ignore_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks whose point isn't in the ledger."""
    new = table(spark, d, "chunks").select(F.col("chunk_id").alias("qdrant_id"), "chunk_index", "doc_type")
    old = table(spark, d, "rag_chunks").select(F.lower(F.trim("qdrant_id")).alias("qdrant_id"))
    return l.insert_if_absent(old, new, "qdrant_id", ["chunk_index", "doc_type"])


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their last version by customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    return l.upsert_latest(o.where(early), o.where(~early), "o_custkey", ["o_orderdate", "o_orderkey"])


def mark_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the outcome of a run: those with chunks in the ledger succeed, others of that run fail."""
    docs = table(spark, d, "rag_documents").select("id", "ingested", "total_chunks", "total_pages").distinct()
    counted = table(spark, d, "rag_chunks").select("id", "doc_id", "page_end").distinct().groupBy("doc_id").agg(F.count("*").cast("int").alias("total_chunks"), F.max("page_end").alias("total_pages"))
    updates = docs.where("ingested = 0").select("id").join(counted, F.col("id") == F.col("doc_id"), "left").select("id", F.col("doc_id").isNotNull().alias("ok"), "total_chunks", "total_pages")
    return l.mark(docs, updates)


def delete_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    """How many points of one company go and how many stay."""
    return l.delete_where(table(spark, d, "chunks"), l.symbol_text() == "FELUREV")[1]


def stats_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Ingested documents per type."""
    return table(spark, d, "rag_documents").where("ingested = 1").groupBy("doc_type").agg(F.countDistinct("id").alias("documents"))


def ledger_stats(spark: SparkSession, d: str) -> DataFrame:
    return l.stats(table(spark, d, "rag_documents"), table(spark, d, "rag_chunks"), table(spark, d, "rag_companies"))


def distinct_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Companies that have points."""
    return table(spark, d, "chunks").select(l.symbol_text().alias("symbol")).where("symbol is not null").distinct().orderBy("symbol")


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    """Company, title and year parsed from object keys, and the class and year of titles."""
    docs = table(spark, d, "rag_documents").select("id", "minio_key", "title").distinct()
    return docs.select("id", *l.parse_key(), l.document_class(F.coalesce("title", F.lit(""))).alias("doc_class"), year_of_title(F.coalesce("title", F.lit(""))).alias("title_year"), l.safe_name("title").alias("file_name"))


def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each company, type and year."""
    docs = table(spark, d, "rag_documents").select("id", l.symbol_text().alias("symbol"), "doc_type", "year").distinct()
    w = Window.partitionBy("symbol", "doc_type", "year").orderBy("id")
    return docs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several kinds united under their tag, counted."""
    m, c = table(spark, d, "metric_rows").select(F.col("row_id").alias("id"), "sub_type"), table(spark, d, "concall_claims").select(F.col("claim_id").alias("id"), "sub_type")
    both = m.distinct().withColumn("_source", F.lit("sql")).unionByName(c.distinct().withColumn("_source", F.lit("vector")))
    return both.groupBy("_source", "sub_type").agg(F.count("*").alias("n"))


def array_year_ops(spark: SparkSession, d: str) -> DataFrame:
    """Years of each company: those with reports, with calls, in both, in only one, with gaps filled."""
    docs = table(spark, d, "rag_documents").select(l.symbol_text().alias("symbol"), "doc_type", F.col("year").cast("int").alias("year")).where("year is not null and symbol is not null")
    years = lambda kind: F.array_sort(F.collect_set(F.when(F.col("doc_type") == kind, F.col("year"))))
    per = docs.groupBy("symbol").agg(years("annual_report").alias("ar"), years("concall").alias("cc"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return per.select("symbol", text(F.array_intersect("ar", "cc")).alias("both"), text(F.array_union("ar", "cc")).alias("either"), text(F.array_except("ar", "cc")).alias("only_reports"), F.arrays_overlap("ar", "cc").alias("overlap"), text(F.array_except(F.sequence("y0", "y1"), F.array_union("ar", "cc"))).alias("gaps"))


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Event properties parsed from JSON, changed and written again."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct((F.col("p.k") + 1).alias("k"))).alias("next"))


def ingestion_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of a run over all documents: those with chunks in the ledger succeed."""
    docs = table(spark, d, "rag_documents").select("id", "symbol", "doc_type", "minio_key", "total_pages").distinct()
    made = table(spark, d, "rag_chunks").select("id", "doc_id").distinct().groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
    results = docs.join(made, F.col("id") == F.col("doc_id"), "left").withColumn("ok", F.col("chunks").isNotNull()).withColumn("message", F.lit(None).cast("string")).withColumn("duration_sec", F.col("total_pages") / 10)
    return l.log_entries(results, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """What such a run came to."""
    return l.run_totals(ingestion_log(spark, d))


def ledger_violations(spark: SparkSession, d: str) -> DataFrame:
    """Constraints that the stored ledger of chunks breaks."""
    return l.violations(table(spark, d, "rag_chunks"), "rag_chunks")


def chunks_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's chunks, numbered in order within their documents."""
    c = table(spark, d, "rag_chunks").where("doc_id is not null").select("doc_id", "chunk_index", "id").distinct()
    return c.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "id")))


def downloads(spark: SparkSession, d: str) -> DataFrame:
    """Files worth keeping among all that were fetched: documents stand for files, blanks for web pages."""
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "und", "text/html; charset=utf-8").when(F.col("lang").isNotNull(), "application/pdf").alias("content_type"), F.col("n_chars").alias("length"))
    return l.downloads(x, 200).select("doc_id")


def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """A row's raw fields and its own as one map, the later winning, and as a record in JSON."""
    own = F.create_map(F.lit("metric"), F.col("metric"), F.lit("source"), F.col("source"))
    rows = table(spark, d, "metric_rows").groupBy("row_id").agg(F.min(F.struct("metric", "source")).alias("m"), F.min(F.to_json("raw_row")).alias("raw")).select("row_id", "m.*", F.from_json("raw", "map<string,string>").alias("raw_row"))
    kept = F.map_filter("raw_row", lambda k, v: ~k.isin("metric", "source"))
    both = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), own)
    return rows.select("row_id", F.size(both).alias("fields"), both["metric"].alias("metric"), F.md5(F.to_json(F.struct("row_id", "source"))).alias("record"))


def size_totals(spark: SparkSession, d: str) -> DataFrame:
    """Characters and estimated tokens of the texts of each source."""
    x = table(spark, d, "documents").where("text is not null")
    return x.groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 3.5))).cast("bigint").alias("tokens"))


_DEFS = (
    ingestion_log, run_totals, ledger_violations, chunks_in_order, downloads, merged_maps, size_totals, bridge_fy_between, bridge_newest, bridge_period_type, bridge_actions, bridge_macro, channel_routing, retrieval_filter, period_years, comparative_explode, atoms_range_join, bridge_topn_per_atom, payload_filter, ledger_pending, ledger_ingested, insert_if_absent, insert_ignore_chunks, upsert_latest, mark_ingested, delete_by_symbol,
    stats_by_type, ledger_stats, distinct_symbols, object_keys, keep_first_dedup, union_tagged, array_year_ops, json_roundtrip,
)
QUERIES = {f.__name__: f for f in _DEFS}

_ATOMS_SQL = """s AS (SELECT s_suppkey, upper(s_name) AS own FROM supplier), n AS (SELECT s.*, o.own AS other FROM s LEFT JOIN s o ON o.s_suppkey = s.s_suppkey + 1),
  a0 AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN list_filter([own, other], lambda x: x IS NOT NULL) ELSE [own] END AS names, CASE WHEN s_suppkey % 2 = 0 THEN 1996 ELSE s_suppkey % 5 + 1993 END AS y0,
    CASE WHEN s_suppkey % 2 = 0 THEN 1998 ELSE s_suppkey % 5 + 1993 END AS y1, CASE WHEN s_suppkey % 4 = 1 THEN 'historical' ELSE 'current' END AS time_horizon FROM n),
  atoms AS (SELECT CAST(s_suppkey AS INTEGER) AS atom_id, unnest(names) AS symbol, y0, y1, time_horizon, 'quantitative' AS need_type FROM a0)"""
_ANNUAL = f"WITH {a.SALES_SQL}, {a.PL_SQL}, annual AS (SELECT upper(symbol) AS symbol, fiscal_year, make_date(fiscal_year, 3, 31) AS period_end, round(revenue, 2) AS sales FROM pl), {_ATOMS_SQL}"
_SYM = "upper(trim(symbol))"

_LOG = """WITH dd AS (SELECT DISTINCT id, symbol, doc_type, minio_key, total_pages FROM rag_documents), mm AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM (SELECT DISTINCT id, doc_id FROM rag_chunks) GROUP BY doc_id),
  lg AS (SELECT symbol, doc_type, minio_key, CASE WHEN n IS NULL THEN 'failed' ELSE 'success' END AS status, CASE WHEN n IS NULL THEN 'unknown error' END AS message, coalesce(n, 0) AS chunks_created, total_pages / 10::DOUBLE AS duration_sec, TIMESTAMP '2026-01-01 00:00:00' AS created_at FROM dd LEFT JOIN mm ON dd.id = mm.doc_id)"""

ORACLE = {
    "ingestion_log": f"{_LOG} SELECT * FROM lg",
    "run_totals": f"{_LOG} SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(coalesce(sum(chunks_created), 0) AS BIGINT) AS chunks FROM lg",
    "ledger_violations": """SELECT * FROM (SELECT 'id is null' AS "constraint", count(*) FILTER (WHERE id IS NULL) AS "rows" FROM rag_chunks UNION ALL SELECT 'doc_id is null', count(*) FILTER (WHERE doc_id IS NULL) FROM rag_chunks UNION ALL SELECT 'qdrant_id is null', count(*) FILTER (WHERE qdrant_id IS NULL) FROM rag_chunks
      UNION ALL SELECT 'collection is null', count(*) FILTER (WHERE collection IS NULL) FROM rag_chunks UNION ALL SELECT 'id is not unique', count(*) FROM (SELECT id FROM rag_chunks WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
      UNION ALL SELECT 'qdrant_id is not unique', count(*) FROM (SELECT qdrant_id FROM rag_chunks WHERE qdrant_id IS NOT NULL GROUP BY qdrant_id HAVING count(*) > 1)) WHERE "rows" > 0""",
    "chunks_in_order": "SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index NULLS FIRST, id NULLS FIRST) AS INTEGER) AS place FROM (SELECT DISTINCT doc_id, chunk_index, id FROM rag_chunks WHERE doc_id IS NOT NULL)",
    "downloads": "SELECT doc_id FROM documents WHERE coalesce(lang, '') <> 'und' AND coalesce(n_chars, 0) >= 200",
    "merged_maps": """WITH r AS (SELECT DISTINCT ON (row_id) row_id, metric, source, raw_row FROM metric_rows) SELECT row_id, CAST(len(list_filter(coalesce(map_keys(raw_row), []), lambda k: k NOT IN ('metric', 'source'))) + 2 AS INTEGER) AS fields, metric,
      md5('{"row_id":' || row_id || CASE WHEN source IS NULL THEN '' ELSE ',"source":"' || source || '"' END || '}') AS record FROM r""",
    "size_totals": "SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(greatest(1, floor(length(text) / 3.5::DOUBLE))) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source",
    "bridge_fy_between": f"{_ANNUAL} SELECT symbol, period_end, sales FROM annual WHERE period_end BETWEEN DATE '1995-04-01' AND DATE '1998-03-31'",
    "bridge_newest": f"{_ANNUAL} SELECT symbol, period_end, sales FROM annual ORDER BY period_end DESC, symbol LIMIT 10",
    "bridge_period_type": f"""WITH {a.SALES_SQL}, {a.PLQ_SQL} SELECT upper(symbol) AS symbol, last_day(make_date(fiscal_year, 3, 31) + to_months(CAST((quarter - 4) * 3 AS INTEGER))) AS period_end, 'quarterly' AS period_type, round(ebitda, 2) AS cfo FROM plq WHERE fiscal_year IN (1996, 1997)""",
    "bridge_actions": """SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS action_date, o_totalprice AS value FROM orders WHERE o_orderkey % 4 = 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-04-01' AND DATE '1997-03-31'""",
    "bridge_macro": "SELECT CAST(ts AS DATE) AS snapshot_date, value, 'index' AS unit FROM events WHERE contains(event_type, 'sign') AND CAST(ts AS DATE) BETWEEN DATE '2022-04-01' AND DATE '2024-03-31'",
    "channel_routing": """WITH k AS (SELECT sub_type FROM concall_claims UNION SELECT sub_type FROM metric_units), n AS (SELECT sub_type, unnest(['quantitative', 'qualitative', 'forward_looking', 'comparative']) AS need_type FROM k WHERE sub_type IS NOT NULL)
      SELECT sub_type, need_type, CASE WHEN need_type = 'qualitative' THEN 'vector' WHEN need_type = 'forward_looking' THEN CASE WHEN sub_type IN ('debtor_days', 'inventory_days') THEN 'vector' ELSE 'both' END ELSE 'sql' END AS channel FROM n""",
    "retrieval_filter": f"SELECT DISTINCT chunk_id, year FROM chunks WHERE {_SYM} = 'FELUREV' AND year IN (2020, 2022)",
    "period_years": "SELECT DISTINCT row_id, CAST(year(CAST(try_strptime(period, '%Y-%m-%d') AS DATE) + INTERVAL 9 MONTH) AS INTEGER) AS fiscal_year FROM metric_rows",
    "comparative_explode": f"WITH {_ATOMS_SQL} SELECT atom_id, symbol, need_type FROM atoms",
    "atoms_range_join": f"{_ANNUAL} SELECT atom_id, symbol, fiscal_year, sales FROM atoms JOIN annual USING (symbol) WHERE fiscal_year BETWEEN y0 AND y1",
    "bridge_topn_per_atom": f"""{_ANNUAL} SELECT atom_id, symbol, fiscal_year, sales, CAST(rn AS INTEGER) AS rn FROM (SELECT atom_id, symbol, fiscal_year, sales, time_horizon, row_number() OVER (PARTITION BY atom_id ORDER BY fiscal_year DESC, symbol) AS rn
      FROM atoms JOIN annual USING (symbol)) WHERE rn <= CASE time_horizon WHEN 'current' THEN 5 ELSE 10 END""",
    "payload_filter": "SELECT DISTINCT chunk_id, year, chunk_index FROM chunks WHERE doc_type = 'concall' AND chunk_type IN ('speaker_turn', 'prose') AND year BETWEEN 2019 AND 2022",
    "ledger_pending": f"SELECT DISTINCT id, {_SYM} AS symbol, year FROM rag_documents WHERE ingested = 0 AND doc_type = 'annual_report'",
    "ledger_ingested": "SELECT DISTINCT minio_key FROM rag_documents WHERE ingested = 1",
    "insert_if_absent": f"SELECT {_SYM} AS symbol, min(id) AS id FROM rag_documents WHERE {_SYM} <> '' AND {_SYM} NOT IN (SELECT {_SYM} FROM rag_companies WHERE symbol IS NOT NULL) GROUP BY 1",
    "insert_ignore_chunks": "SELECT chunk_id AS qdrant_id, min(chunk_index) AS chunk_index, min(doc_type) AS doc_type FROM chunks WHERE chunk_id NOT IN (SELECT lower(trim(qdrant_id)) FROM rag_chunks WHERE qdrant_id IS NOT NULL) GROUP BY chunk_id",
    "upsert_latest": """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "mark_ingested": """WITH d AS (SELECT DISTINCT id, ingested, total_chunks, total_pages FROM rag_documents), c AS (SELECT doc_id, count(*) AS n, max(page_end) AS p FROM (SELECT DISTINCT id, doc_id, page_end FROM rag_chunks) GROUP BY doc_id)
      SELECT id, CAST(CASE WHEN ingested <> 0 THEN ingested WHEN c.doc_id IS NULL THEN 2 ELSE 1 END AS TINYINT) AS ingested, CAST(CASE WHEN ingested = 0 AND c.doc_id IS NOT NULL THEN c.n ELSE total_chunks END AS INTEGER) AS total_chunks,
        CASE WHEN ingested = 0 AND c.doc_id IS NOT NULL THEN c.p ELSE total_pages END AS total_pages FROM d LEFT JOIN c ON d.id = c.doc_id""",
    "delete_by_symbol": f"SELECT count(*) FILTER (WHERE {_SYM} = 'FELUREV') AS deleted, count(*) FILTER (WHERE {_SYM} IS DISTINCT FROM 'FELUREV') AS remaining FROM chunks",
    "stats_by_type": "SELECT doc_type, count(DISTINCT id) AS documents FROM rag_documents WHERE ingested = 1 GROUP BY 1",
    "ledger_stats": "SELECT (SELECT count(DISTINCT id) FROM rag_companies) AS companies, (SELECT count(DISTINCT id) FROM rag_documents WHERE ingested = 1) AS documents, (SELECT count(DISTINCT id) FROM rag_chunks) AS chunks",
    "distinct_symbols": f"SELECT DISTINCT {_SYM} AS symbol FROM chunks WHERE symbol IS NOT NULL",
    "object_keys": r"""WITH d AS (SELECT DISTINCT id, minio_key, coalesce(title, '') AS t, title FROM rag_documents), p AS (SELECT *, string_split(minio_key, '/') AS k FROM d)
      SELECT id, upper(k[-2]) AS key_symbol, regexp_replace(k[-1], '(?i)\.pdf$', '') AS key_title, TRY_CAST(nullif(regexp_extract(k[-1], '^(\d{4})', 1), '') AS INTEGER) AS key_year,
        CASE WHEN regexp_matches(lower(t), 'annual report|annual-report|annualreport|integrated report') AND NOT contains(lower(t), 'transcript') THEN 'annual_report'
             WHEN regexp_matches(lower(t), 'transcript|concall|con-call|conference call|earnings call') AND NOT contains(lower(t), 'board meeting') THEN 'concall' ELSE 'other' END AS doc_class,
        coalesce(CASE WHEN regexp_matches(lower(t), 'q[1-4][\s-]*fy[\s-]*\d{2}') THEN (TRY_CAST(regexp_extract(lower(t), 'q[1-4][\s-]*fy[\s-]*(\d{4}|\d{2})', 1) AS INTEGER) % 100) + 2000 END,
          CASE WHEN regexp_matches(lower(t), '\bfy[\s-]*\d{2}') THEN (TRY_CAST(regexp_extract(lower(t), '\bfy[\s-]*(\d{4}|\d{2})', 1) AS INTEGER) % 100) + 2000 END,
          TRY_CAST(nullif(regexp_extract(t, '(20\d{2})[–/-]\d{2,4}', 1), '') AS INTEGER) + 1, TRY_CAST(nullif(regexp_extract(t, '(20\d{2})', 1), '') AS INTEGER)) AS title_year, substring(regexp_replace(title, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 100) AS file_name FROM p""",
    "keep_first_dedup": f"SELECT id, symbol, doc_type, year FROM (SELECT *, row_number() OVER (PARTITION BY symbol, doc_type, year ORDER BY id) AS rn FROM (SELECT DISTINCT id, {_SYM} AS symbol, doc_type, year FROM rag_documents)) WHERE rn = 1",
    "union_tagged": """SELECT _source, sub_type, count(*) AS n FROM (SELECT DISTINCT 'sql' AS _source, row_id AS id, sub_type FROM metric_rows UNION ALL SELECT DISTINCT 'vector', claim_id, sub_type FROM concall_claims) GROUP BY ALL""",
    "array_year_ops": f"""WITH d AS (SELECT DISTINCT {_SYM} AS symbol, doc_type, CAST(year AS INTEGER) AS year FROM rag_documents WHERE year IS NOT NULL AND symbol IS NOT NULL),
      p AS (SELECT symbol, coalesce(list(DISTINCT year) FILTER (WHERE doc_type = 'annual_report'), []) AS ar, coalesce(list(DISTINCT year) FILTER (WHERE doc_type = 'concall'), []) AS cc, min(year) AS y0, max(year) AS y1 FROM d GROUP BY symbol)
      SELECT symbol, array_to_string(list_sort(list_intersect(ar, cc)), ',') AS "both", array_to_string(list_sort(list_distinct(list_concat(ar, cc))), ',') AS either, array_to_string(list_sort(list_filter(ar, lambda x: NOT list_contains(cc, x))), ',') AS only_reports,
        list_has_any(ar, cc) AS overlap, array_to_string(list_sort(list_filter(range(y0, y1 + 1), lambda x: NOT list_contains(ar, x) AND NOT list_contains(cc, x))), ',') AS gaps FROM p""",
    "json_roundtrip": """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"k":' || (CAST(json_extract(props, '$.k') AS INTEGER) + 1) || '}' AS next FROM events""",
}
