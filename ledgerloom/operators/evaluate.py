"""Quality of rankings: hits, reciprocal ranks, precision and gain at several depths."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored

# Goals by (metric, depth).
GOALS = {("hit", 10): 0.80, ("hit", 5): 0.70, ("mrr", 10): 0.60, ("mrr", 5): 0.50, ("precision", 10): 0.20, ("precision", 5): 0.30, ("ndcg", 10): 0.65, ("ndcg", 5): 0.55}


def metrics_at(ranked: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = (5, 10), full_ideal: bool = False, queries: DataFrame | None = None) -> DataFrame:
    """query_id, k, hit, mrr, precision, ndcg, first_hit of every query with something relevant.

    ranked: query_id, item_id, rank (from 1); relevant: query_id, item_id, gain. The ideal order is that
    of the retrieved items' gains, or of all relevant ones with full_ideal. Precision divides by k.
    Queries that retrieved nothing have zeros; of those without relevant items only the ones in `queries`
    (query_id) have rows, with NULL for every metric.
    """
    gain = relevant.groupBy("query_id", "item_id").agg(F.max("gain").alias("gain"))
    got = ranked.join(gain, ["query_id", "item_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    pool = (gain if full_ideal else got).select("query_id", "item_id", "gain")
    best = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item_id")))
    known = gain.select("query_id").distinct().withColumn("known", F.lit(True))
    if queries is not None:
        known = queries.select("query_id").distinct().join(known, "query_id", "full").withColumn("known", F.coalesce("known", F.lit(False)))
    per: list[DataFrame] = []
    at = lambda c, k: F.when(F.col("rank") <= k, c)
    dcg = F.col("gain") / F.log2(F.col("rank") + 1.0)
    rel = F.col("gain") > 0
    sums = got.groupBy("query_id").agg(
        F.min(F.when(rel, F.col("rank"))).alias("first_hit"), *(F.count_if(rel & (F.col("rank") <= k)).alias(f"n{k}") for k in depths), *(F.sum(at(dcg, k)).alias(f"d{k}") for k in depths)
    )
    ideal = best.groupBy("query_id").agg(*(F.sum(at(dcg, k)).alias(f"i{k}") for k in depths))
    x = known.join(sums, "query_id", "left").join(ideal, "query_id", "left")
    for k in depths:
        hit = F.coalesce(F.col("first_hit") <= k, F.lit(False))
        mrr = F.when(hit, F.round(F.try_divide(F.lit(1.0), F.col("first_hit")), 6)).otherwise(0.0)
        precision = F.round(F.coalesce(F.col(f"n{k}"), F.lit(0)) / F.lit(float(k)), 6)
        ndcg = F.round(F.coalesce(F.try_divide(F.col(f"d{k}"), F.nullif(F.col(f"i{k}"), F.lit(0.0))), F.lit(0.0)), 6)
        per.append(x.select("query_id", F.lit(k).alias("k"), *(F.when(F.col("known"), c).alias(name) for name, c in (("hit", hit.cast("int")), ("mrr", mrr), ("precision", precision), ("ndcg", ndcg))), "first_hit"))
    out = per[0]
    for p in per[1:]:
        out = out.unionByName(p)
    return out


def aggregated(metrics: DataFrame) -> DataFrame:
    """Means per depth, with each metric's band: pass at its goal, warn at four fifths of it, else fail."""
    names = ("hit", "mrr", "precision", "ndcg")
    means = metrics.groupBy("k").agg(F.count("*").alias("queries"), *(F.round(F.avg(m), 4).alias(m) for m in names))
    long = means.select("k", "queries", F.expr("stack(4, " + ", ".join(f"'{m}', {m}" for m in names) + ") as (metric, value)"))
    goal = F.coalesce(*(F.when((F.col("metric") == m) & (F.col("k") == k), F.lit(g)) for (m, k), g in GOALS.items()))
    return long.select("k", "queries", "metric", "value", F.when(goal.isNull(), None).when(F.col("value") >= goal, "pass").when(F.col("value") >= 0.8 * goal, "warn").otherwise("fail").alias("band"))


def timings(runs: DataFrame) -> DataFrame:
    """Means of a run: runs has retrieval_ms, rerank_ms and error per query. Retrieval and reranking count where they took any time, the total always."""
    took = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    total = F.coalesce("retrieval_ms", F.lit(0.0)) + F.coalesce("rerank_ms", F.lit(0.0))
    return runs.agg(
        F.count("*").alias("queries"), F.round(F.coalesce(took("retrieval_ms"), F.lit(0.0)), 3).alias("mean_retrieval_ms"), F.round(F.coalesce(took("rerank_ms"), F.lit(0.0)), 3).alias("mean_rerank_ms"), F.round(F.coalesce(F.avg(total), F.lit(0.0)), 3).alias("mean_total_ms"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def ends(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    """The first and the last n rows in an order, with their end: what a report shows of many queries. Two top-k lists, no sort of all rows."""
    backward = [F.desc(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*order).limit(n).withColumn("end", F.lit("first")).unionByName(df.orderBy(*backward).limit(n).withColumn("end", F.lit("last")))


class Golden(NamedTuple):
    """A question with what is relevant to it."""

    query: str
    relevant_ids: tuple[str, ...]
    symbol: str | None = None
    doc_type: str = "annual_report"
    years: tuple[int, ...] = ()
    graded_ids: dict[str, int] = {}
    notes: str = ""


GOLDEN = "query string, symbol string, doc_type string, years array<int>, relevant_ids array<string>, graded_ids map<string,int>, notes string"


class GoldenSet:
    """Collects golden questions by hand and turns them into a table."""

    def __init__(self) -> None:
        self.samples: list[Golden] = []

    def add(self, query: str, relevant_ids: list[str], **known) -> "GoldenSet":
        self.samples.append(Golden(query, tuple(relevant_ids), **{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}))
        return self

    def build(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g.query, g.symbol, g.doc_type, list(g.years), list(g.relevant_ids), dict(g.graded_ids), g.notes) for g in self.samples], GOLDEN)


def golden_of(golden: DataFrame, doc_type: str | None = None, symbol: str | None = None) -> DataFrame:
    """The golden questions of a document type and company."""
    out = golden.where(F.col("doc_type") == doc_type) if doc_type else golden
    return out.where(F.upper("symbol") == symbol.upper()) if symbol else out


def questions_and_relevance(golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions for a retriever, relevant items with their gain). One year is a year, several are the span from the first to the last."""
    g = golden.withColumn("query_id", F.xxhash64("query", "symbol", "doc_type"))
    n = F.coalesce(F.size("years"), F.lit(0))
    many = lambda at: F.when(n > 1, F.element_at("years", at))
    questions = g.select("query_id", "query", "symbol", "doc_type", F.when(n == 1, F.element_at("years", 1)).alias("year"), many(1).alias("year_from"), many(-1).alias("year_to"))
    relevant = g.select("query_id", "graded_ids", F.explode("relevant_ids").alias("item_id")).select("query_id", "item_id", F.coalesce(F.try_element_at("graded_ids", F.col("item_id")), F.lit(1)).alias("gain"))
    return questions, relevant


def run_eval(golden: DataFrame, retriever: Callable[[DataFrame], DataFrame], reranker: Callable[[DataFrame], DataFrame] | None = None, depths: tuple[int, ...] = (5, 10, 20), clock: Callable[[], float] = time.perf_counter) -> tuple[DataFrame, DataFrame]:
    """(metrics of every query and depth, one row of timings) of a whole golden set at once.

    retriever: questions to query_id, item_id (text) and score; reranker: the same to the same. Both
    channels of a question are one list by score. The steps are written to the shared folder, so that
    their times are theirs; the mean per query is what a batch took over its queries. A step that fails
    leaves its error and metrics of nothing retrieved.
    """
    questions, relevant = questions_and_relevance(golden)
    spark, error, took = golden.sparkSession, None, [0.0, 0.0]
    found = spark.createDataFrame([], "query_id bigint, item_id string, score double")
    try:
        for at, step in enumerate((retriever, reranker)):
            if step is not None:
                began = clock()
                found = stored((step(questions) if at == 0 else step(found)).select("query_id", F.col("item_id").cast("string").alias("item_id"), "score"))
                took[at] = (clock() - began) * 1000
    except Exception as problem:  # noqa: BLE001 - belongs to the run
        error = str(problem)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    n = max(1, questions.count())
    runs = questions.select("query_id", F.lit(took[0] / n).alias("retrieval_ms"), F.lit(took[1] / n).alias("rerank_ms"), F.lit(error).cast("string").alias("error"))
    return metrics_at(found.withColumn("rank", F.row_number().over(w)), relevant, depths, queries=questions), timings(runs)
