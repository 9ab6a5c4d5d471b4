"""Queries of retrieval, fusion, evaluation and cache (V01-V13, X09-X12, A06-A14, W04-W07, O03-O08, E01-E09, C01-C05) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import shown
from ledgerloom.operators import bridge as br
from ledgerloom.operators import cache as ca
from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import fusion as fu
from ledgerloom.operators import retrieval as r
from ledgerloom.sources import adapters as a
from ledgerloom.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return v.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), v


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id divides by 20."""
    return r.cosine_topk(*_vectors(spark, d), k=10)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A fixed question per kind of figure."""
    u = table(spark, d, "metric_units").select(F.regexp_replace("sub_type", "_", " ").alias("query")).distinct()
    return u.select(F.col("query").alias("query_id"), F.concat("query", F.lit(" growth guidance")).alias("query"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents of every question by BM25 over all documents."""
    return r.bm25(table(spark, d, "documents").select("doc_id", "text"), _questions(spark, d), k=10)


def idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and weight of every term."""
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(r.tokens(F.col("text"))).alias("tk"))
    n = docs.agg(F.count("*").alias("n"))
    return docs.select(F.explode("tk").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", F.round(r._idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The thirty nearest documents by vector of every vector whose id divides by 20, and the question asked of each."""
    near = r.cosine_topk(*_vectors(spark, d), k=r.TOP_ANNUAL).select("query_id", F.col("item_id").alias("doc_id"), F.col("score").alias("vector_score"))
    docs = table(spark, d, "documents").select("doc_id", "text", "doc_type", F.year("published_at").alias("year"))
    q = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("revenue growth and margin guidance").alias("query"))
    return near.join(docs, "doc_id"), q


def hybrid_minmax_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Nearest documents with BM25 over each question's own candidates, both scores fused."""
    c, q = _candidates(spark, d)
    return r.fused(r.bm25_of_candidates(c, q)).select("query_id", "doc_id", "vector_score", "bm25", "score")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c, q = _candidates(spark, d)
    return r.fused(r.bm25_of_candidates(c, q))


def recency_role_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Importance of chunks adjusted by year of reports and by speakers of calls."""
    c = table(spark, d, "chunks").select("chunk_id", "doc_type", "speaker_role", "year", F.col("importance_score").alias("score")).distinct()
    return c.select(F.col("chunk_id").alias("doc_id"), r.adjusted().alias("adjusted"))


def year_widening(spark: SparkSession, d: str) -> DataFrame:
    """Ten best candidates within two years, or of all years where those are too few."""
    x = _scored(spark, d).withColumn("in_years", F.coalesce(F.col("year").isin(2021, 2022), F.lit(False)))
    return r.widened(x, 10).select("query_id", "doc_id", "widened", "rank")


def merged_channels(spark: SparkSession, d: str) -> DataFrame:
    """The best 12 of reports and 6 of calls per question, in order."""
    return r.merged_channels(_scored(spark, d), least=0.2).select("query_id", "doc_id", "rank", "place")


def retrieval_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Every claim's metric asked of its company's reports and calls, in the claim's year or what the question says."""
    c = table(spark, d, "concall_claims").select("claim_id", "metric", "symbol", "year", "is_forward").distinct().where("metric is not null")
    questions = c.select(F.col("claim_id").alias("query_id"), F.concat("metric", F.when(F.col("is_forward"), F.lit(" guidance")).otherwise(F.lit(" last two years"))).alias("query"), F.element_at(F.array(*map(F.lit, ("annual_report", "concall", "both"))), (F.col("claim_id") % 3 + 1).cast("int")).alias("doc_type"), "symbol", F.when(F.col("claim_id") % 2 == 0, F.col("year")).alias("year"))
    points = table(spark, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.min(F.struct("text", "doc_type", "symbol", "year", "speaker_role")).alias("p")).select(F.xxhash64("chunk_id").alias("item_id"), "p.*").withColumn("vector", r.embed("text", 128))
    found = r.retrieve(questions, points, lambda text: r.embed(text, 128))
    return found.select("query_id", "doc_type", "item_id", "vector_score", "bm25", "score", "rank", "widened")


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Every question expanded by intents."""
    return _questions(spark, d).select("query_id", r.expanded("query").alias("expanded"))


def rerank(spark: SparkSession, d: str) -> DataFrame:
    """Twelve best candidates per question by the default reranker."""
    c, q = _candidates(spark, d)
    x = c.where("text is not null").join(q, "query_id").withColumn("score", r.overlap_logit(F.col("query"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("query_id", "doc_id", "score", "rank")


def text_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of documents."""
    return table(spark, d, "documents").select("doc_id", r.embed("text").alias("embedding")).where("embedding is not null")


def context_sort(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each question newest first, reports before calls."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("year"), F.when(F.col("doc_type") == "annual_report", 0).otherwise(1), F.desc("score"), "doc_id")
    return _scored(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 15").select("query_id", "doc_id", "place")


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Leading candidates of each question that fit a budget."""
    x = _scored(spark, d).where("text is not null")
    return ca.within_budget(x, 4000, "query_id", [F.desc("score"), F.col("doc_id")]).select("query_id", "doc_id", "used", "place")


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Leading candidates of each question that fit a budget of tokens."""
    x = _scored(spark, d).where("text is not null")
    return ca.within_tokens(x, 900, "query_id", [F.desc("score"), F.col("doc_id")]).select("query_id", "doc_id", "used", "place")


def numeric_claims(spark: SparkSession, d: str) -> DataFrame:
    """Numbers claimed in call chunks."""
    c = table(spark, d, "chunks").where("doc_type = 'concall'").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    return fu.claims_of_text(c).select("chunk_id", "sentence_no", "figure_no", "sub_type", "value_low", "value_high", "unit", "is_forward", F.md5("source_text").alias("digest"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concall_claims").dropDuplicates(["claim_id"])


def claim_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One claim per kind and beginning of text."""
    return fu.deduplicated(_claims(spark, d).select("claim_id", "sub_type", "source_text", "chunk_score"), ["claim_id"]).select("claim_id")


def best_claim(spark: SparkSession, d: str) -> DataFrame:
    """The best claim of each kind and company."""
    x = _claims(spark, d).where("symbol is not null").select("sub_type", "symbol", "claim_id", "speaker_role", "chunk_score")
    return fu.best_claims(x, ["sub_type", "symbol"], "claim_id").select("sub_type", "symbol", "claim_id")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metric_rows").dropDuplicates(["row_id"]).select("row_id", "sub_type", "symbol", "year", "value")


def _in_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fu.in_common_units(table(spark, d, "metric_rows"), table(spark, d, "concall_claims"), table(spark, d, "metric_units"), table(spark, d, "fx_rates"))


def cross_reference(spark: SparkSession, d: str) -> DataFrame:
    """Reported figures against the best claim of their kind, both in its common unit."""
    return fu.cross_reference(*_in_units(spark, d))


def cross_reference_strict(spark: SparkSession, d: str) -> DataFrame:
    """The same by kind, company and year."""
    return fu.cross_reference(*_in_units(spark, d), strict=True)


_KINDS_FUSED = ("revenue", "operating_profit", "net_profit", "opm", "pbt")


def _fetched(spark: SparkSession, d: str) -> list[br.Fetched]:
    """Figures of the annual results of all companies, fetched through the bridge."""
    pl = a.profit_loss(spark, d)
    annual = pl.select(
        F.upper("symbol").alias("symbol"), F.make_date("fiscal_year", F.lit(3), F.lit(31)).alias("period_end"), F.round("revenue", 2).alias("sales"), F.round("ebitda", 2).alias("operating_profit"), F.round(F.col("ebitda") / F.col("revenue") * 100, 1).alias("opm_pct"), F.round("pat", 2).alias("net_profit"),
        F.round("eps", 2).alias("eps"), F.round("pbt", 2).cast("string").alias("profit_before_tax"),
    )
    return br.fetch([br.Atom(k, years=(1996, 1998), time_horizon="historical") for k in _KINDS_FUSED] + [br.Atom("ebitda")], {"annual_results": annual})


def _one_chunk(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min(F.struct("text", "doc_type", "importance_score", "symbol", "year", "section", "speaker", "speaker_role")).alias("c"))
    return c.select("chunk_id", "c.*").withColumnRenamed("importance_score", "score")


def channel_split(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of reports and of calls, counted."""
    reports, calls = fu.by_channel(_one_chunk(spark, d))
    return reports.agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score")).withColumn("channel", F.lit("annual")).unionByName(calls.agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score")).withColumn("channel", F.lit("concall")))


def source_projection(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's place and score as an answer shows them."""
    return _one_chunk(spark, d).select("chunk_id", *fu.source_line())


def reranked_union(spark: SparkSession, d: str) -> DataFrame:
    """Report chunks with those of calls that score best, counted by where they are from."""
    reports, calls = fu.by_channel(_one_chunk(spark, d))
    return fu.with_reranked(reports, calls.where("score >= 0.8").unionByName(reports.where("score >= 0.8"))).groupBy("from").agg(F.count("*").alias("n"))


def shown_values(spark: SparkSession, d: str) -> DataFrame:
    """Figures as they are shown, by the common unit of their kind."""
    u = table(spark, d, "metric_units").select("sub_type", "common_unit")
    return _rows(spark, d).join(u, "sub_type").select("row_id", shown(F.round("value", 1), F.col("common_unit")).alias("shown"))


def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Value column and unit of the kinds of all claims, with nothing for unknown ones."""
    kinds = table(spark, d, "concall_claims").select("sub_type").where("sub_type is not null").distinct()
    return br.with_schema(kinds).select("sub_type", "value_col", "unit", F.size("columns").alias("n_columns"))


def union_distinct_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Kinds found by the claims' rules, then those of the rows, each company's kind once."""
    c = _claims(spark, d).where("symbol is not null").select(F.col("symbol").alias("query_id"), "sub_type", F.col("claim_id").alias("ord"), F.lit("rule").alias("source"))
    m = table(spark, d, "metric_rows").where("symbol is not null").select(F.col("symbol").alias("query_id"), "sub_type", F.col("row_id").alias("ord"), F.lit("model").alias("source")).distinct()
    return br.distinct_atoms(c, m)


def graded_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The grade of each nearest vector by a map of grades, 0 without one."""
    near = cosine_topk(spark, d).select("query_id", "item_id")
    grades = table(spark, d, "embeddings").where("label < 3").groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("vec_id", (F.col("vec_id") % 3 + 1).alias("g"))))).alias("grades"))
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label").join(grades, "label", "left")
    return near.join(q, "query_id").select("query_id", "item_id", F.coalesce(F.try_element_at("grades", F.col("item_id")), F.lit(0)).cast("int").alias("grade"))


def metric_row_builder(spark: SparkSession, d: str) -> DataFrame:
    """Fetched rows of several kinds as metric rows."""
    return fu.metric_rows_of(_fetched(spark, d)).drop("raw_row", "metric")


def fused_insights(spark: SparkSession, d: str) -> DataFrame:
    """Figures of annual results against what calls claim, kind by kind."""
    c = table(spark, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.min(F.struct("text", "doc_type", "importance_score", "symbol", "year", "speaker", "speaker_role")).alias("c"))
    chunks = c.select("chunk_id", "c.*").withColumnRenamed("importance_score", "score")
    found = fu.fuse(_fetched(spark, d), chunks)
    return found.insights.groupBy("sub_type", "insight").agg(F.count("*").alias("n"), F.round(F.sum("divergence_pct"), 1).alias("divergence"))


def orphan_forward(spark: SparkSession, d: str) -> DataFrame:
    """Outlooks of companies' kinds of which nothing was reported in their year."""
    rows = _rows(spark, d).where("symbol is not null and year is not null").select(F.concat_ws("/", "sub_type", "symbol", F.col("year").cast("string")).alias("sub_type"))
    claims = _claims(spark, d).where("symbol is not null and year is not null").select("claim_id", "is_forward", F.concat_ws("/", "sub_type", "symbol", F.col("year").cast("string")).alias("sub_type"))
    return fu.orphan_outlooks(rows, claims).select("claim_id", "sub_type")


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    q, i = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label"), labels.select(F.col("vec_id").alias("item_id"), "label")
    relevant = q.join(i, "label").where("query_id <> item_id").select("query_id", "item_id", (1 + F.col("item_id") % 3).cast("int").alias("gain"))
    return cosine_topk(spark, d).select("query_id", "item_id", "rank"), relevant


def hit_mrr_precision(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the nearest vectors: an item is relevant if it has the query's label."""
    return ev.metrics_at(*_ranked(spark, d)).select("query_id", "k", "hit", "mrr", "precision", F.col("first_hit").cast("int").alias("first_hit"))


def ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Gain against the ideal order of what was retrieved."""
    return ev.metrics_at(*_ranked(spark, d)).select("query_id", "k", "ndcg")


def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality per depth with its band."""
    return ev.aggregated(ev.metrics_at(*_ranked(spark, d)))


def eval_timings(spark: SparkSession, d: str) -> DataFrame:
    """Mean times and errors of a run: events stand for its queries."""
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "signup", F.col("value")).otherwise(0.0).alias("retrieval_ms"), F.when(F.col("event_type") == "click", F.col("value") / 2).otherwise(0.0).alias("rerank_ms"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"))
    return ev.timings(e)


def report_ends(spark: SparkSession, d: str) -> DataFrame:
    """The first and last five queries of a report, the worst first."""
    m = hit_mrr_precision(spark, d).where("k = 10").select("query_id", "mrr")
    return ev.ends(m, ["mrr", "query_id"])


def unjudged_queries(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all queries, also of those without a relevant item."""
    ranked, relevant = _ranked(spark, d)
    q = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return ev.metrics_at(ranked, relevant.where("query_id % 40 = 0"), queries=q).select("query_id", "k", "hit", "mrr")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and symbol is not null").select("doc_id", "symbol", "doc_type", "text", "fetched_at", F.array((F.col("doc_id") % 6 + 2018).cast("int")).alias("years"))
    return docs.select(F.col("doc_id").alias("entry_id"), ca.exact_key("text").alias("key"), "symbol", "doc_type", "years", F.col("fetched_at").alias("stored_at"), F.md5("text").alias("response"))


_NOW = "2026-02-01 00:00:00"


def cache_exact(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions, looked up in the entries of the last two years."""
    e = _entries(spark, d)
    return ca.lookup(e.select(F.col("entry_id").alias("question_id"), "key"), e, F.lit(_NOW).cast("timestamp_ntz"), ttl=2 * 365 * 86400).select("question_id", "hit", "response")


def cache_semantic(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other vector of one label for every vector whose id divides by 20."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("symbol"), F.lit("both").alias("doc_type"), F.col("embedding").alias("vector"), F.array((F.col("vec_id") % 3 + 2020).cast("int")).alias("years"))
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "question_id")
    return ca.nearest(q, v.withColumnRenamed("vec_id", "entry_id"), least=0.2, but_self=True)


def cache_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """What stays after one company's reports were invalidated."""
    return ca.stats(ca.invalidated(_entries(spark, d), "FELUREV", "annual_report"))


_DEFS = (
    retrieval_dispatch, cosine_topk, bm25_topk, idf, hybrid_minmax_fusion, recency_role_adjust, year_widening, merged_channels, query_expansion, rerank, text_embeddings, context_sort, budget_prefix, token_budget, numeric_claims, claim_dedup, best_claim, cross_reference, cross_reference_strict, metric_row_builder, fused_insights, channel_split, source_projection, reranked_union, shown_values, catalog_lookup, union_distinct_atoms, graded_relevance,
    orphan_forward, hit_mrr_precision, ndcg, eval_aggregate, eval_timings, report_ends, unjudged_queries, cache_exact, cache_semantic, cache_invalidate,
)
QUERIES = {f.__name__: f for f in _DEFS}

_NEAR = """near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(i.embedding::DOUBLE[], i.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings q JOIN embeddings i ON q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id)) WHERE rank <= 10)"""
_TK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_RANKS = f"""{_NEAR}, rel AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, 1 + i.vec_id % 3 AS gain FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id),
  got AS (SELECT n.query_id, n.item_id, n.rank, coalesce(gain, 0) AS gain FROM near n LEFT JOIN rel USING (query_id, item_id)), qs AS (SELECT DISTINCT query_id FROM rel), ks AS (SELECT unnest([5, 10]) AS k),
  ideal AS (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS rank FROM got),
  m AS (SELECT query_id, k, min(rank) FILTER (WHERE gain > 0) AS first_hit, count(*) FILTER (WHERE gain > 0 AND rank <= k) AS n, sum(gain / log2(rank + 1)) FILTER (WHERE rank <= k) AS d FROM got CROSS JOIN ks GROUP BY ALL),
  i AS (SELECT query_id, k, sum(gain / log2(rank + 1)) FILTER (WHERE rank <= k) AS i FROM ideal CROSS JOIN ks GROUP BY ALL),
  mm AS (SELECT query_id, k, CAST(coalesce(first_hit <= k, false) AS INTEGER) AS hit, CASE WHEN first_hit <= k THEN round(1.0::DOUBLE / first_hit, 6) ELSE 0.0::DOUBLE END AS mrr, round(coalesce(n, 0) / k::DOUBLE, 6) AS precision,
    round(coalesce(d / nullif(i, 0), 0), 6) AS ndcg, CAST(first_hit AS INTEGER) AS first_hit FROM qs CROSS JOIN ks LEFT JOIN m USING (query_id, k) LEFT JOIN i USING (query_id, k))"""
_BEST = "row_number() OVER (PARTITION BY {} ORDER BY CASE WHEN lower(trim(speaker_role)) IN ('management', 'ceo', 'cfo', 'md', 'cmd') THEN 1 ELSE 0 END DESC, coalesce(chunk_score, -1) DESC, claim_id) AS rn"


_SENT = r"""cc AS (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunks WHERE doc_type = 'concall' AND text IS NOT NULL), ss AS (SELECT chunk_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM cc),
  st AS (SELECT chunk_id, list_filter(parts, lambda x: x <> '') AS parts FROM ss), s AS (SELECT chunk_id, unnest(parts) AS sentence, unnest(range(0, len(parts))) AS sentence_no FROM st)"""
# The oracle's own literals: kinds of figures by their words, the form of a number with its unit, and words of an outlook.
_KINDS = """('revenue', 'revenue|sales|turnover', 'crore'), ('operating_profit', 'operating profit', 'crore'), ('net_profit', 'net profit|profit after tax', 'crore'), ('ebitda', 'ebitda', 'crore'), ('capex', 'capex|capital expenditure|invoice', 'crore'), ('borrowings', 'borrowing|debt', 'crore'),
  ('order_book', 'order book', 'crore'), ('opm', 'margin|pricing', '%'), ('growth', 'growth|guidance', '%'), ('pe', 'price to earnings', 'x')"""
_NUM = r"(?i)(?:Rs\.?\s*)?(\d[\d,]*(?:\.\d+)?)(?:\s*[-–]\s*(\d[\d,]*(?:\.\d+)?))?\s*(%|crore|cr\.?\b|lakh|billion|million|rs\.?\b|x\b)"
_OUTLOOK = r"(?i)\b(we expect|we anticipate|going forward|guidance|target|forecast|next year|next quarter|h1|h2|fy2[0-9]|by fy|by march|plan to|we are confident|we aim|we intend|projected|aspire)\b"

_PART = "qn * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))"
_GLOBAL = f"""WITH docs AS (SELECT doc_id, coalesce({_TK.format('text')}, []) AS tk FROM documents), st AS (SELECT count(*) AS n, avg(len(tk)) AS al FROM docs),
  qs AS (SELECT DISTINCT replace(sub_type, '_', ' ') AS query_id FROM metric_units), q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({_TK.format("query_id || ' growth guidance'")}) AS term FROM qs) GROUP BY ALL),
  tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(tk) AS len, unnest(tk) AS term FROM docs) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  sc AS (SELECT query_id, doc_id, round(sum({_PART}), 6) AS bm25 FROM tf JOIN dfs USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL)"""
_LOCAL = f"""WITH {_NEAR.replace("<= 10", "<= 30")}, cand AS (SELECT query_id, doc_id, score AS vs, text, doc_type, CAST(year(published_at) AS INTEGER) AS year FROM near JOIN documents ON doc_id = item_id),
  docs AS (SELECT query_id, doc_id, vs, coalesce({_TK.format('text')}, []) AS tk FROM cand), st AS (SELECT query_id, count(*) AS n, avg(len(tk)) AS al FROM docs GROUP BY query_id),
  q AS (SELECT term, count(*) AS qn FROM (SELECT unnest({_TK.format("'revenue growth and margin guidance'")}) AS term) GROUP BY term),
  tf AS (SELECT query_id, doc_id, len, term, qn, count(*) AS tf FROM (SELECT query_id, doc_id, len(tk) AS len, unnest(tk) AS term FROM docs) JOIN q USING (term) GROUP BY ALL), dfs AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
  b AS (SELECT query_id, doc_id, round(sum({_PART}), 6) AS bm25 FROM tf JOIN dfs USING (query_id, term) JOIN st USING (query_id) GROUP BY ALL), c AS (SELECT docs.query_id, docs.doc_id, vs, coalesce(bm25, 0) AS bm25 FROM docs LEFT JOIN b USING (query_id, doc_id)),
  w AS (SELECT *, min(vs) OVER p AS v0, max(vs) OVER p AS v1, min(bm25) OVER p AS b0, max(bm25) OVER p AS b1 FROM c WINDOW p AS (PARTITION BY query_id)),
  fz AS (SELECT query_id, doc_id, vs AS vector_score, bm25, round((0.0::DOUBLE + (CASE WHEN v1 = v0 THEN 1 ELSE (vs - v0) / (v1 - v0) END) + (CASE WHEN b1 = b0 THEN 1 ELSE (bm25 - b0) / (b1 - b0) END)) / 2, 6) AS score FROM w),
  sc AS (SELECT fz.*, text, doc_type, year FROM fz JOIN cand USING (query_id, doc_id))"""
# What questions made of these kinds' names come to, by the first four phrases of each intent they name.
_PHRASES = {
    "outlook": "we expect. we anticipate. our outlook. going forward", "guidance": "FY guidance. target. projected. forecast", "risk": "risk factors. headwinds. challenges. macro risk", "capex": "capital expenditure. capex plan. investment. expansion", "margin": "EBITDA margin. operating margin. margin guidance. margin improvement",
    "revenue": "revenue from operations. total income. net revenue. revenue growth", "ebitda": "EBITDA. earnings before interest tax depreciation. operating profit. EBIT", "profit": "profit after tax. PAT. net profit. profit before tax", "depreciation": "depreciation and amortisation. D&A. amortisation. depreciation on property plant",
    "assets": "total assets. fixed assets. current assets. non-current assets", "equity": "shareholders equity. net worth. book value. retained earnings", "debt": "net debt. total debt. borrowings. long term debt", "working_capital": "current liabilities. trade payables. trade receivables. inventories", "ocf": "operating cash flow. cash from operations. net cash flow from operating activities. cash generated from operations",
    "eps": "earnings per share. diluted EPS. basic EPS. EPS growth", "roe_roce": "return on equity. ROE. return on capital employed. ROCE", "pe_pb": "price to earnings. P/E ratio. price to book. P/B ratio", "outlooks": "outlook. expect. anticipate. guidance. target",
}
_USED = (
    ("outlook", "outlook"), ("guidance", "guidance|target|projected|fy guidance"), ("risk", "risk|headwinds|challenges"), ("capex", "capex|capital expenditure|investment"), ("margin", "margin"), ("revenue", "revenue|total income"), ("ebitda", "ebitda|operating profit"), ("profit", "profit|pat"),
    ("depreciation", "depreciation|d&a|amortisation"), ("assets", "assets"), ("equity", "equity|net worth|book value"), ("debt", "debt|borrowings"), ("working_capital", "working_capital|current liabilities|trade payables|trade receivables"), ("ocf", "ocf|operating cash flow|cash from operations"),
    ("eps", "eps|earnings per share"), ("roe_roce", "roe_roce|return on equity|roe|return on capital employed"), ("pe_pb", "pe_pb|price to earnings"), ("outlooks", "outlook|h1|h2|next|expect|guidance|going forward"),
)
_INTENT = ", ".join(f"CASE WHEN regexp_matches(lower(q), '{pattern}') THEN string_split('{_PHRASES[name]}', '. ') ELSE [] END" for name, pattern in _USED)
_GOALS = " ".join(f"WHEN metric = '{m}' AND k = {k} THEN {g}" for (m, k), g in ev.GOALS.items())

_METRIC_ROWS = f"""WITH {a.SALES_SQL}, {a.PL_SQL}, w AS (SELECT upper(symbol) AS symbol, fiscal_year AS year, CAST(make_date(fiscal_year, 3, 31) AS VARCHAR) AS period, round(revenue, 2) AS sales, round(ebitda, 2) AS operating_profit, round(ebitda / revenue * 100, 1) AS opm_pct, round(pat, 2) AS net_profit,
    round(pbt, 2) AS profit_before_tax FROM pl WHERE fiscal_year BETWEEN 1996 AND 1998),
  mr AS (SELECT symbol, 'revenue' AS sub_type, year, period, sales AS value, 'sales' AS value_col, 'crore' AS unit FROM w UNION ALL SELECT symbol, 'operating_profit', year, period, operating_profit, 'operating_profit', 'crore' FROM w
    UNION ALL SELECT symbol, 'net_profit', year, period, net_profit, 'net_profit', 'crore' FROM w UNION ALL SELECT symbol, 'opm', year, period, opm_pct, 'opm_pct', '%' FROM w UNION ALL SELECT symbol, 'pbt', year, period, profit_before_tax, 'profit_before_tax', 'crore' FROM w)"""

ORACLE = {
    "bm25_topk": f"{_GLOBAL} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 10",
    "hybrid_minmax_fusion": f"{_LOCAL} SELECT * FROM fz",
    "recency_role_adjust": """SELECT chunk_id AS doc_id, round(CASE WHEN doc_type = 'annual_report' THEN score + greatest(0.0, (coalesce(year, 0) - 2000) * 0.01::DOUBLE)
      ELSE greatest(0.0, score - CASE WHEN speaker_role = 'moderator' THEN 0.08::DOUBLE WHEN coalesce(speaker_role, 'unknown') = 'unknown' THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END) END, 6) AS adjusted FROM (SELECT DISTINCT chunk_id, doc_type, speaker_role, year, importance_score AS score FROM chunks)""",
    "year_widening": f"""{_LOCAL}, y AS (SELECT *, coalesce(year IN (2021, 2022), false) AS iny FROM sc), n AS (SELECT *, least(10, sum(CAST(iny AS INTEGER)) OVER (PARTITION BY query_id)) < 8 AS widened FROM y)
      SELECT query_id, doc_id, widened, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM n WHERE widened OR iny) WHERE rank <= 10""",
    "merged_channels": f"""{_LOCAL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score >= 0.2)
      SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_type = 'annual_report' THEN 0 ELSE 1 END, rank) AS INTEGER) AS place FROM r WHERE rank <= CASE WHEN doc_type = 'annual_report' THEN 12 ELSE 6 END""",
    "context_sort": f"""{_LOCAL} SELECT query_id, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY year DESC NULLS LAST, CASE WHEN doc_type = 'annual_report' THEN 0 ELSE 1 END, score DESC, doc_id) AS place FROM sc) WHERE place <= 15""",
    "budget_prefix": f"""{_LOCAL}, u AS (SELECT query_id, doc_id, CAST(sum(length(text) + 250) OVER w AS BIGINT) AS used, CAST(row_number() OVER w AS INTEGER) AS place FROM sc WHERE text IS NOT NULL WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
      SELECT * FROM u WHERE used <= 4000 OR place = 1""",
    "token_budget": f"""{_LOCAL}, u AS (SELECT query_id, doc_id, CAST(sum(greatest(1, floor(length(text) / 3.5::DOUBLE)) + 60) OVER w AS BIGINT) AS used, CAST(row_number() OVER w AS INTEGER) AS place FROM sc WHERE text IS NOT NULL WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
      SELECT * FROM u WHERE used <= 900 OR place = 1""",
    "query_expansion": f"""WITH qs AS (SELECT DISTINCT replace(sub_type, '_', ' ') AS query_id, replace(sub_type, '_', ' ') || ' growth guidance' AS q FROM metric_units), e AS (SELECT query_id, q, flatten([{_INTENT}]) AS l FROM qs),
      n AS (SELECT query_id, q, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM e) SELECT query_id, array_to_string(list_concat([q], u[1:12]), '. ') AS expanded FROM n""",
    "eval_aggregate": f"""WITH {_RANKS}, a AS (SELECT k, count(*) AS queries, round(avg(hit), 4) AS hit, round(avg(mrr), 4) AS mrr, round(avg(precision), 4) AS "precision", round(avg(ndcg), 4) AS ndcg FROM mm GROUP BY k), l AS (UNPIVOT a ON hit, mrr, "precision", ndcg INTO NAME metric VALUE value)
      SELECT k, queries, metric, value, CASE WHEN value >= CASE {_GOALS} END THEN 'pass' WHEN value >= 0.8 * CASE {_GOALS} END THEN 'warn' ELSE 'fail' END AS band FROM l""",
    "cosine_topk": f"WITH {_NEAR} SELECT * FROM near",
    "idf": f"""WITH d AS (SELECT doc_id, list_distinct({_TK.format('text')}) AS tk FROM documents), t AS (SELECT unnest(tk) AS term FROM d) SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM d) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM t GROUP BY term""",
    "claim_dedup": "SELECT claim_id FROM (SELECT *, row_number() OVER (PARTITION BY sub_type, substring(source_text, 1, 80) ORDER BY chunk_score DESC NULLS LAST, claim_id) AS rn FROM (SELECT DISTINCT ON (claim_id) * FROM concall_claims)) WHERE rn = 1",
    "best_claim": f"SELECT sub_type, symbol, claim_id FROM (SELECT *, {_BEST.format('sub_type, symbol')} FROM (SELECT DISTINCT ON (claim_id) * FROM concall_claims) WHERE symbol IS NOT NULL) WHERE rn = 1",
    "channel_split": """WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks) SELECT CASE WHEN doc_type = 'concall' THEN 'concall' ELSE 'annual' END AS channel, count(*) AS n, round(sum(importance_score), 2) AS score FROM c GROUP BY 1""",
    "source_projection": "SELECT DISTINCT chunk_id, substring(coalesce(nullif(section, ''), nullif(speaker, ''), ''), 1, 50) AS place, round(importance_score, 4) AS score FROM chunks",
    "reranked_union": """WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks) SELECT CASE WHEN doc_type = 'concall' THEN 'reranker_top' ELSE 'bridge' END AS "from", count(*) AS n FROM c WHERE doc_type <> 'concall' OR importance_score >= 0.8 GROUP BY 1""",
    "shown_values": """WITH r AS (SELECT DISTINCT row_id, round(value, 1) AS v, common_unit AS u FROM metric_rows JOIN metric_units USING (sub_type)), n AS (SELECT *, abs(v) AS a FROM r)
      SELECT row_id, CASE WHEN v IS NULL THEN 'n/a' WHEN u = '%' THEN printf('%s%,.2f%%', CASE WHEN v < 0 THEN '-' ELSE '' END, a) WHEN u = 'x' THEN printf('%s%,.2fx', CASE WHEN v < 0 THEN '-' ELSE '' END, a) WHEN u = 'days' THEN printf('%s%,.0f days', CASE WHEN v < 0 THEN '-' ELSE '' END, a)
        WHEN u = 'rs' THEN printf('₹%s%,.2f', CASE WHEN v < 0 THEN '-' ELSE '' END, a) WHEN u = 'crore' THEN printf('₹%s%,.1f cr', CASE WHEN v < 0 THEN '-' ELSE '' END, a) END AS shown FROM n""",
    "catalog_lookup": """WITH k AS (SELECT DISTINCT sub_type FROM concall_claims WHERE sub_type IS NOT NULL), c AS (SELECT * FROM (VALUES ('revenue', 'sales', 'crore', 1), ('operating_profit', 'operating_profit', 'crore', 2), ('net_profit', 'net_profit', 'crore', 2), ('ebitda', 'ebitda', 'crore', 2), ('borrowings', 'borrowings', 'crore', 3), ('capex', 'capex', 'crore', 1),
        ('fcf', 'free_cash_flow', 'crore', 1), ('market_cap', 'market_cap', 'crore', 1), ('eps', 'eps_annual', 'rs', 2), ('book_value', 'book_value', 'rs', 1), ('price', 'close', 'rs', 2), ('dividend', 'value', 'rs', 1), ('opm', 'opm_pct', '%', 1), ('roe', 'roe_pct', '%', 1), ('roce', 'roce_pct', '%', 1), ('ebitda_margin', 'ebitda_margin_pct', '%', 1),
        ('promoter', 'promoter_pct', '%', 1), ('pe', 'pe_ratio', 'x', 3), ('pb', 'pb_ratio', 'x', 1), ('debt_equity', 'debt_to_equity', 'x', 1), ('interest_coverage', 'interest_coverage', 'x', 1), ('dividend_yield', 'dividend_yield_pct', '%', 1), ('dso', 'dso_days', 'days', 1), ('dio', 'dio_days', 'days', 1), ('dpo', 'dpo_days', 'days', 1), ('ev_ebitda', 'ev_ebitda', 'x', 1), ('current_ratio', 'current_ratio', 'x', 1),
        ('net_debt', 'net_debt', 'crore', 1), ('cash', 'cash_equivalents', 'crore', 1), ('ocf', 'cfo', 'crore', 1), ('total_assets', 'total_assets', 'crore', 1), ('trade_receivables', 'trade_receivables', 'crore', 1), ('inventories', 'inventories', 'crore', 1), ('working_capital', 'working_capital_days', 'days', 1), ('ccc', 'cash_conversion_cycle', 'days', 1), ('dividend_payout', 'dividend_payout_pct', '%', 1),
        ('gross_margin', 'gross_margin_pct', '%', 1), ('net_margin', 'net_profit_margin_pct', '%', 1), ('tax', 'tax_pct', '%', 1), ('pbt', 'profit_before_tax', 'crore', 1), ('interest', 'interest', 'crore', 1), ('depreciation', 'depreciation', 'crore', 1)) t(sub_type, value_col, unit, n_columns))
      SELECT sub_type, coalesce(value_col, '') AS value_col, coalesce(unit, '') AS unit, CAST(coalesce(n_columns, 0) AS INTEGER) AS n_columns FROM k LEFT JOIN c USING (sub_type)""",
    "union_distinct_atoms": """WITH b AS (SELECT symbol AS query_id, sub_type, claim_id AS ord, 'rule' AS source, 0 AS f FROM concall_claims WHERE symbol IS NOT NULL UNION SELECT symbol, sub_type, row_id, 'model', 1 FROM metric_rows WHERE symbol IS NOT NULL)
      SELECT query_id, sub_type, ord, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sub_type ORDER BY f, ord) AS rn FROM b) WHERE rn = 1""",
    "graded_relevance": f"WITH {_NEAR} SELECT query_id, item_id, CAST(CASE WHEN q.label = i.label AND q.label < 3 THEN i.vec_id % 3 + 1 ELSE 0 END AS INTEGER) AS grade FROM near JOIN embeddings q ON q.vec_id = query_id JOIN embeddings i ON i.vec_id = item_id",
    "metric_row_builder": f"{_METRIC_ROWS} SELECT * FROM mr",
    "fused_insights": f"""{_METRIC_ROWS}, {_SENT.replace("chunk_id, text FROM chunks", "chunk_id, text, importance_score, speaker_role FROM chunks").replace("SELECT chunk_id, string_split", "SELECT chunk_id, importance_score, speaker_role, string_split").replace("SELECT chunk_id, list_filter", "SELECT chunk_id, importance_score, speaker_role, list_filter").replace("SELECT chunk_id, unnest(parts)", "SELECT chunk_id, importance_score, speaker_role, unnest(parts)")},
      k AS (SELECT * FROM (VALUES ('revenue', 'revenue|sales|turnover', 'crore'), ('operating_profit', 'operating profit', 'crore'), ('net_profit', 'net profit|profit after tax', 'crore'), ('opm', 'margin|pricing', '%')) t(sub_type, words, hint)),
      f AS (SELECT s.*, sub_type, hint, regexp_extract_all(sentence, '{_NUM}', 1) AS g1, regexp_extract_all(sentence, '{_NUM}', 2) AS g2, regexp_extract_all(sentence, '{_NUM}', 3) AS g3 FROM s JOIN k ON regexp_matches(lower(sentence), words)),
      u AS (SELECT chunk_id, importance_score, speaker_role, sentence_no, sentence, sub_type, hint, unnest(g1) AS a, unnest(g2) AS b, unnest(g3) AS c, unnest(range(0, len(g1))) AS figure_no FROM f),
      v AS (SELECT *, CASE WHEN regexp_replace(lower(c), '\\.$', '') = 'cr' THEN 'crore' ELSE regexp_replace(lower(c), '\\.$', '') END AS unit, CAST(replace(a, ',', '') AS DOUBLE) AS lo, TRY_CAST(nullif(replace(b, ',', ''), '') AS DOUBLE) AS hi FROM u),
      ok AS (SELECT *, regexp_matches(sentence, '{_OUTLOOK}') AS fwd FROM v WHERE CASE hint WHEN '%' THEN unit = '%' ELSE unit IN ('crore', 'lakh', 'billion') END),
      dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub_type, substring(sentence, 1, 80) ORDER BY importance_score DESC NULLS LAST, chunk_id, sentence_no, figure_no) AS rn FROM ok) WHERE rn = 1),
      top AS (SELECT *, row_number() OVER (PARTITION BY sub_type ORDER BY CASE WHEN lower(trim(speaker_role)) IN ('management', 'ceo', 'cfo', 'md', 'cmd') THEN 1 ELSE 0 END DESC, coalesce(importance_score, -1) DESC, CAST('0x' || substr(md5(concat_ws('|', chunk_id, sentence_no, figure_no, sub_type)), 1, 15) AS BIGINT)) AS rk FROM dd),
      one AS (SELECT sub_type, fwd, (CASE WHEN coalesce(hi, 0) <> 0 THEN (lo + hi) / 2 ELSE lo END) / CASE WHEN unit = 'lakh' THEN 100 ELSE 1 END AS v FROM top WHERE rk = 1),
      x AS (SELECT mr.sub_type, value, v, fwd, one.sub_type IS NULL AS alone, CASE WHEN value = 0 THEN 0 ELSE abs((v - value) / value) END AS div FROM mr LEFT JOIN one USING (sub_type) WHERE value IS NOT NULL),
      y AS (SELECT sub_type, CASE WHEN alone THEN 'UNMATCHED' WHEN fwd THEN 'FORWARD' WHEN div >= 0.15 THEN 'CONTRADICT' ELSE 'CONFIRM' END AS insight, CASE WHEN NOT alone AND NOT fwd THEN round(div * 100, 2) END AS pct FROM x)
      SELECT sub_type, insight, count(*) AS n, round(sum(pct), 1) AS divergence FROM y GROUP BY ALL""",
    "orphan_forward": """WITH r AS (SELECT DISTINCT concat_ws('/', sub_type, symbol, CAST(year AS VARCHAR)) AS k FROM metric_rows WHERE symbol IS NOT NULL AND year IS NOT NULL)
      SELECT DISTINCT claim_id, concat_ws('/', sub_type, symbol, CAST(year AS VARCHAR)) AS sub_type FROM concall_claims WHERE is_forward AND symbol IS NOT NULL AND year IS NOT NULL AND concat_ws('/', sub_type, symbol, CAST(year AS VARCHAR)) NOT IN (SELECT k FROM r)""",
    "eval_timings": """WITH e AS (SELECT CASE WHEN event_type <> 'signup' THEN value ELSE 0 END AS a, CASE WHEN event_type = 'click' THEN value / 2 ELSE 0 END AS b, event_type = 'error' AS bad FROM events)
      SELECT count(*) AS queries, round(coalesce(avg(a) FILTER (WHERE a > 0), 0), 3) AS mean_retrieval_ms, round(coalesce(avg(b) FILTER (WHERE b > 0), 0), 3) AS mean_rerank_ms, round(avg(a + b), 3) AS mean_total_ms, count(*) FILTER (WHERE bad) AS errors FROM e""",
    "report_ends": f"""WITH {_RANKS}, t AS (SELECT query_id, mrr FROM mm WHERE k = 10) SELECT query_id, mrr, 'first' AS "end" FROM (SELECT * FROM t ORDER BY mrr, query_id LIMIT 5) UNION ALL SELECT query_id, mrr, 'last' FROM (SELECT * FROM t ORDER BY mrr DESC, query_id DESC LIMIT 5)""",
    "unjudged_queries": f"WITH {_RANKS} SELECT query_id, k, CASE WHEN query_id % 40 = 0 THEN hit END AS hit, CASE WHEN query_id % 40 = 0 THEN mrr END AS mrr FROM mm",
    "hit_mrr_precision": f"WITH {_RANKS} SELECT query_id, k, hit, mrr, precision, first_hit FROM mm", "ndcg": f"WITH {_RANKS} SELECT query_id, k, ndcg FROM mm",
    "numeric_claims": rf"""WITH {_SENT}, k AS (SELECT * FROM (VALUES {_KINDS}) t(sub_type, words, hint)), f AS (SELECT chunk_id, sentence_no, sentence, sub_type, hint, regexp_extract_all(sentence, '{_NUM}', 1) AS g1, regexp_extract_all(sentence, '{_NUM}', 2) AS g2, regexp_extract_all(sentence, '{_NUM}', 3) AS g3
        FROM s JOIN k ON regexp_matches(lower(sentence), words)),
      u AS (SELECT chunk_id, sentence_no, sentence, sub_type, hint, unnest(g1) AS a, unnest(g2) AS b, unnest(g3) AS c, unnest(range(0, len(g1))) AS figure_no FROM f),
      v AS (SELECT *, CASE WHEN regexp_replace(lower(c), '\.$', '') = 'cr' THEN 'crore' ELSE regexp_replace(lower(c), '\.$', '') END AS unit FROM u)
      SELECT chunk_id, CAST(sentence_no AS INTEGER) AS sentence_no, CAST(figure_no AS INTEGER) AS figure_no, sub_type, CAST(replace(a, ',', '') AS DOUBLE) AS value_low, TRY_CAST(nullif(replace(b, ',', ''), '') AS DOUBLE) AS value_high, unit,
        regexp_matches(sentence, '{_OUTLOOK}') AS is_forward, md5(substring(sentence, 1, 300)) AS digest FROM v WHERE CASE hint WHEN '%' THEN unit = '%' WHEN 'crore' THEN unit IN ('crore', 'lakh', 'billion') ELSE true END""",
    "cache_semantic": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id % 3 AS y FROM embeddings), p AS (SELECT q.vec_id AS question_id, c.vec_id AS entry_id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS similarity, q.y = c.y AS meet
        FROM v q JOIN v c ON q.label = c.label AND q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
      SELECT question_id, entry_id, similarity, meet AND similarity >= 0.2 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, entry_id) AS rn FROM p) WHERE rn = 1""",
    "cache_exact": """WITH e AS (SELECT doc_id, sha256(concat_ws('|', trim(text), upper(trim(symbol)), coalesce(doc_type, ''), CAST(doc_id % 6 + 2018 AS VARCHAR))) AS key, fetched_at, md5(text) AS response FROM documents WHERE text IS NOT NULL AND symbol IS NOT NULL),
      live AS (SELECT key, response FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC NULLS LAST, doc_id DESC) AS rn FROM e WHERE epoch(TIMESTAMP '2026-02-01 00:00:00') - epoch(date_trunc('second', fetched_at)) <= 63072000) WHERE rn = 1)
      SELECT doc_id AS question_id, live.response IS NOT NULL AS hit, live.response FROM e LEFT JOIN live USING (key)""",
    "cache_invalidate": """SELECT count(*) AS entries, CAST(sum(32) AS BIGINT) AS bytes, CAST(604800 AS INTEGER) AS ttl, 0.92::DOUBLE AS threshold FROM documents WHERE text IS NOT NULL AND symbol IS NOT NULL AND NOT coalesce(upper(symbol) = 'FELUREV' AND doc_type = 'annual_report', false)""",
}
