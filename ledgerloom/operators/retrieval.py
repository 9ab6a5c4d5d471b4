"""Lexical, vector and hybrid retrieval for many queries at once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.exprs import scaled, sigmoid
from ledgerloom.functions.text import any_of, tokens
from ledgerloom.operators.understand import year_intents
from ledgerloom.session import stored

K1, B, MIN_RESULTS, TOP_ANNUAL, TOP_CALL = 1.5, 0.75, 8, 30, 25
# Intents of a question with the phrases that documents have for them, and words of outlook. A question is expanded by the first four phrases of its intents.
INTENTS = (
    ("outlook", ("we expect", "we anticipate", "our outlook", "going forward")),
    ("demand", ("demand environment", "volume growth", "market demand", "cargo volume")),
    ("guidance", ("FY guidance", "target", "projected", "forecast")),
    ("risk", ("risk factors", "headwinds", "challenges", "macro risk")),
    ("capex", ("capital expenditure", "capex plan", "investment", "expansion")),
    ("margin", ("EBITDA margin", "operating margin", "margin guidance", "margin improvement")),
    ("management", ("management commentary", "CEO said", "CFO mentioned", "management discussion")),
    ("revenue", ("revenue from operations", "total income", "net revenue", "revenue growth")),
    ("ebitda", ("EBITDA", "earnings before interest tax depreciation", "operating profit", "EBIT")),
    ("profit", ("profit after tax", "PAT", "net profit", "profit before tax")),
    ("depreciation", ("depreciation and amortisation", "D&A", "amortisation", "depreciation on property plant")),
    ("assets", ("total assets", "fixed assets", "current assets", "non-current assets")),
    ("equity", ("shareholders equity", "net worth", "book value", "retained earnings")),
    ("debt", ("net debt", "total debt", "borrowings", "long term debt")),
    ("working_capital", ("current liabilities", "trade payables", "trade receivables", "inventories")),
    ("cashflow", ("cash flow from operations", "operating cash flow", "cash flow from investing", "cash flow from financing")),
    ("ocf", ("operating cash flow", "cash from operations", "net cash flow from operating activities", "cash generated from operations")),
    ("eps", ("earnings per share", "diluted EPS", "basic EPS", "EPS growth")),
    ("roe_roce", ("return on equity", "ROE", "return on capital employed", "ROCE")),
    ("book_value", ("book value per share", "net asset value per share", "NAV per share", "tangible book value")),
    ("pe_pb", ("price to earnings", "P/E ratio", "price to book", "P/B ratio")),
    ("dividends", ("dividend per share", "DPS", "dividend payout", "dividend yield")),
    ("segments", ("segment revenue", "segment EBITDA", "segment profit", "business segment")),
    ("geography", ("India revenue", "outside India", "geographical segment", "domestic revenue")),
)
FORWARD_HINTS = ("outlook", "h1", "h2", "next", "expect", "guidance", "demand environment", "going forward")
FORWARD_PHRASES = ("outlook", "expect", "anticipate", "guidance", "target")


def _rows_of(lists: pa.Array) -> np.ndarray:
    """The row of each value of an array of lists."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


def embed(text: str | Column, size: int = 768) -> Column:
    """A deterministic stand-in for a text encoder: hashed term frequencies of unit length. NULL for texts without tokens."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def hashed(found: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(found.slice(at, 1000)) for at in range(0, max(1, len(found)), 1000)])

    def some(found: pa.Array) -> pa.Array:
        words, row = found.flatten().dictionary_encode(), _rows_of(found)
        h = np.fromiter((zlib.crc32(w.encode()) for w in words.dictionary.to_pylist()), np.uint32, len(words.dictionary))[words.indices.to_numpy(zero_copy_only=False)]
        v = np.bincount(row * size + h % np.uint32(size), np.where(h & np.uint32(0x80000000), 1.0, -1.0), len(found) * size).astype(np.float32).reshape(-1, size)
        n = np.sqrt((v * v).sum(axis=1))
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, size, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((v[n > 0] / n[n > 0, None]).ravel(), pa.float32()), mask=pa.array(n == 0))

    return hashed(tokens(F.col(text) if isinstance(text, str) else text))


def cosine_topk(
    queries: DataFrame, items: DataFrame, k: int, item_block: int = 4096, query_block: int = 1024, keys: tuple[str, ...] = (), but_self: bool = True, allow: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None
) -> DataFrame:
    """Exact k nearest items of every query by cosine: keys, query_id, item_id, score (6 places), rank.

    queries: query_id, vector; items: item_id, vector; both with the columns of `keys`, which must be
    equal for a query to meet an item. The queries of a key meet its items in tiles of fixed size, so
    that no key, however hot, is one task: a tile is one matrix product and keeps its k best per query,
    and what is shuffled back is k rows per query and item block. `allow` gets the queries and items of a
    tile with all their other columns, and returns which may meet. Equal scores rank by item_id; with
    but_self an item never meets the query of its id; rows without a vector or key have no part.
    """
    by = list(keys) or ["_all"]
    queries, items = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (queries, items))  # both may come from one table
    if not keys:
        queries, items = (df.withColumn("_all", F.lit(0)) for df in (queries, items))
    ready = lambda df, own: df.where(F.col(own).isNotNull() & F.col("vector").isNotNull()).withColumn(own, F.col(own).cast("bigint"))
    queries, items = ready(queries, "query_id"), ready(items, "item_id")
    blocks = items.groupBy(*by).agg(F.ceil(F.count("*") / item_block).alias("_ni")).join(queries.groupBy(*by).agg(F.ceil(F.count("*") / query_block).alias("_nq")), by)
    if not keys:
        blocks = F.broadcast(blocks)  # one row
    place = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    left = items.join(blocks, by).withColumn("_ib", place("item_id", "_ni")).withColumn("_qb", spread("_nq")).drop("_ni", "_nq")
    right = queries.join(blocks, by).withColumn("_qb", place("query_id", "_nq")).withColumn("_ib", spread("_ni")).drop("_ni", "_nq")

    def tile(key: tuple, q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(i) or not len(q):
            return pd.DataFrame({**{c: pd.Series([], dtype=object) for c in by}, "query_id": pd.Series([], dtype="int64"), "item_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        unit = lambda rows: (m := np.array(rows.tolist(), np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, own = i["item_id"].to_numpy(), q["query_id"].to_numpy()
        scores = np.round(unit(q["vector"]) @ unit(i["vector"]).T, 6)
        if but_self:
            scores[own[:, None] == ids[None, :]] = -np.inf
        if allow is not None:
            scores[~allow(q, i)] = -np.inf
        order = np.argsort(ids, kind="stable")
        best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
        at = np.repeat(np.arange(len(own)), best.shape[1])
        score = scores[at, best.ravel()]
        met = np.isfinite(score)
        same = {c: pd.Series([v] * int(met.sum()), dtype=object) for c, v in zip(by, key)}
        return pd.DataFrame({**same, "query_id": own[at][met], "item_id": ids[best.ravel()][met], "score": score[met]})

    types = {c: items.schema[c].dataType.simpleString() for c in by}
    tiles = [*by, "_ib", "_qb"]
    near = right.groupBy(*tiles).cogroup(left.groupBy(*tiles)).applyInPandas(tile, ", ".join(f"{c} {t}" for c, t in types.items()) + ", query_id bigint, item_id bigint, score double")
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "item_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_all")


def _idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def bm25(corpus: DataFrame, queries: DataFrame, k: int | None = None, compat: bool = False) -> DataFrame:
    """BM25 of every query over a whole corpus: query_id, doc_id, bm25 (6 places) (, rank if k is given).

    corpus: doc_id, text; queries: query_id, query. Only terms that some query has are counted, so the
    postings shrink to the queries' vocabulary before they are shuffled; lengths are one number per
    document. A query's repeated tokens count as often as they occur.
    """
    docs = corpus.where("doc_id is not null").select("doc_id", F.coalesce(tokens(F.col("text"), compat), F.array().cast("array<string>")).alias("tk"))
    q = queries.select("query_id", F.explode(tokens(F.col("query"), compat)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    size = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tk")).alias("avg_len"))
    post = docs.select("doc_id", F.size("tk").alias("len"), F.explode("tk").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    part = F.col("qn") * _idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / norm
    scored = post.join(df, "term").join(q, "term").join(F.broadcast(size)).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("bm25"))
    if k is None:
        return scored
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_of_candidates(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """candidates with bm25 over each query's own candidates: lengths, frequencies and their averages per query_id.

    candidates: query_id, doc_id, text and more. Candidates that share no token with the query get 0.
    """
    tk = candidates.select("query_id", "doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tk"))
    sizes = tk.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.avg(F.size("tk")).alias("avg_len"))
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    post = tk.select("query_id", "doc_id", F.size("tk").alias("len"), F.explode("tk").alias("term")).join(q, ["query_id", "term"]).groupBy("query_id", "doc_id", "len", "term", "qn").agg(F.count("*").alias("tf"))
    df = post.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    part = F.col("qn") * _idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = post.join(df, ["query_id", "term"]).join(sizes, "query_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("bm25"))
    return candidates.join(scored, ["query_id", "doc_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def fused(candidates: DataFrame) -> DataFrame:
    """Adds score: the mean of vector_score and bm25, each scaled from 0 to 1 within its query (1 where all are equal).

    The ranges are aggregates that combine before the shuffle, so no query's candidates are one window.
    """
    names = ("vector_score", "bm25")
    ranges = candidates.groupBy("query_id").agg(*(f(c).alias(f"_{end}_{c}") for c in names for end, f in (("low", F.min), ("high", F.max))))
    score = sum((scaled(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}")) for c in names), F.lit(0.0)) / 2
    return candidates.join(ranges, "query_id").withColumn("score", F.round(score, 6)).select(*candidates.columns, "score")


def recency_boost(year: str = "year") -> Column:
    return F.greatest(F.lit(0.0), (F.coalesce(F.col(year), F.lit(0)) - 2000) * F.lit(0.01))


def adjusted(score: str = "score", doc_type: str = "doc_type", role: str = "speaker_role", year: str = "year") -> Column:
    """Annual reports gain by recency; of calls, moderators lose 0.08 and unknown speakers 0.03, not below 0."""
    penalty = F.when(F.col(role) == "moderator", 0.08).when(F.coalesce(F.col(role), F.lit("unknown")) == "unknown", 0.03).otherwise(0.0)
    return F.round(F.when(F.col(doc_type) == "annual_report", F.col(score) + recency_boost(year)).otherwise(F.greatest(F.lit(0.0), F.col(score) - penalty)), 6)


def widened(candidates: DataFrame, k: int, in_years: str = "in_years", least: int = MIN_RESULTS) -> DataFrame:
    """Each query's k best rows within its years; queries with fewer than `least` of those get their k best of all years instead."""
    counts = candidates.groupBy("query_id").agg((F.least(F.lit(k), F.count_if(F.col(in_years))) < least).alias("widened"))
    chosen = candidates.join(counts, "query_id").where(F.col("widened") | F.col(in_years))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return chosen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged_channels(candidates: DataFrame, annual_k: int = 12, call_k: int = 6, least: float = 0.0) -> DataFrame:
    """The best of each channel over a threshold, annual reports before calls: adds rank within the channel and place."""
    w = Window.partitionBy("query_id", "doc_type").orderBy(F.desc("score"), "doc_id")
    best = candidates.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.when(F.col("doc_type") == "annual_report", annual_k).otherwise(call_k))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("doc_type") == "annual_report", 0).otherwise(1), "rank")))


def overlap_logit(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's tokens that the text has, as a probability. A model takes its place by the same signature."""
    q = F.array_distinct(tokens(query))
    return F.round(sigmoid(8.0 * F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(q)) - 4.0), 6)


def expanded(query: str | Column, most: int = 12) -> Column:
    """The question and, without repeats, the phrases of every intent it names or already uses and of outlooks if it asks for one; the first `most` phrases, joined by ". "."""
    q = F.col(query) if isinstance(query, str) else query
    low = F.lower(q)
    none = F.array().cast("array<string>")
    hits = [F.when(any_of(low, (name, *(p.lower() for p in phrases[:3]))), F.array(*(F.lit(p) for p in phrases[:4]))).otherwise(none) for name, phrases in INTENTS]
    hits.append(F.when(any_of(low, FORWARD_HINTS), F.array(*map(F.lit, FORWARD_PHRASES))).otherwise(none))
    return F.array_join(F.concat(F.array(q), F.slice(F.array_distinct(F.concat(*hits)), 1, most)), ". ")


def resolved_years(questions: DataFrame) -> DataFrame:
    """questions with resolved and explicit years: a given year, else a given span, else what the question says. Columns year, year_from and year_to may be missing."""
    for c in ("year", "year_from", "year_to"):
        if c not in questions.columns:
            questions = questions.withColumn(c, F.lit(None).cast("int"))
    said = questions.withColumn("_said", year_intents("query"))
    given = F.when(F.col("year").isNotNull(), F.array(F.col("year").cast("int"))).when(F.col("year_from").isNotNull() & F.col("year_to").isNotNull(), F.sequence(F.least("year_from", "year_to").cast("int"), F.greatest("year_from", "year_to").cast("int")))
    return said.withColumn("resolved", F.coalesce(given, F.col("_said.resolved"))).withColumn("explicit", F.coalesce(given, F.col("_said.explicit"))).drop("_said", "year", "year_from", "year_to")


def _counted(vocabulary: list[str]) -> Callable[[Column], Column]:
    """Of an array of tokens its length, and those of a sorted vocabulary (by place) with how often they occur."""

    @F.arrow_udf(T.StructType([T.StructField("len", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))]))
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = pa.array(vocabulary, pa.string())
        for found in batches:
            at = pc.index_in(found.flatten(), value_set=words)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            key, tf = np.unique(_rows_of(found)[known] * max(1, len(words)) + at.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            row, term = np.divmod(key, max(1, len(words)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(found) + 1)), pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf))
            yield pa.StructArray.from_arrays([pc.list_value_length(found).fill_null(0), *lists], names=["len", "terms", "tf"])

    return counts


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _bm25_of_lists(qn: pa.Array, lengths: pa.Array, tfs: pa.Array) -> pa.Array:
    """BM25 of a question's candidates: how often the question has each of its terms, the candidates' lengths, and how often each has those terms."""

    def some(qn: pa.Array, lengths: pa.Array, tfs: pa.Array) -> pa.Array:
        n_terms, n_docs = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (qn, lengths))
        ask, per_doc = _rows_of(lengths), tfs.flatten()
        doc, tf = _rows_of(per_doc), per_doc.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.cumsum(n_terms) - n_terms  # of each ask's terms
        own = n_terms[ask]
        term = np.arange(len(tf)) - (np.cumsum(own) - own)[doc] + first[ask[doc]]
        df = np.bincount(term, tf > 0, int(n_terms.sum()))
        n = np.repeat(n_docs, n_terms)
        weight = qn.flatten().to_numpy(zero_copy_only=False) * np.log((n - df + 0.5) / (df + 0.5) + 1)
        length = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        mean = np.bincount(ask, length, len(n_docs)) / np.maximum(n_docs, 1)
        norm = K1 * (1 - B + B * length / np.maximum(mean, 1e-300)[ask])
        has = tf > 0
        d, t = doc[has], tf[has]
        score = np.bincount(d, weight[term[has]] * t * (K1 + 1) / (t + norm[d]), len(length))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_docs)]), pa.int32()), pa.array(score, pa.float64()))

    return pa.concat_arrays([some(*(x.slice(at, 500) for x in (qn, lengths, tfs))) for at in range(0, max(1, len(qn)), 500)])


_NEAR = "ask bigint, free boolean, k int, item_id bigint, vector_score double, year int, speaker_role string, len int, tf array<int>"


def _near(asks: DataFrame, points: DataFrame, keys: tuple[str, ...], k_annual: int, k_call: int, least: int, item_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """The nearest points of every ask in tiles of fixed size, those that meet its years and role and, where a tile has few of these, also those that don't (free).

    A tile keeps the best of both per ask, so that no key, however hot, is one task. Asks of one text have
    one product and one order. With its score a point brings how often it has each term of the ask.
    """
    many = points.groupBy(*keys).agg(F.ceil(F.count("*") / item_block).alias("_ni")).join(asks.groupBy(*keys).agg(F.ceil(F.count("*") / query_block).alias("_nq")), [*keys])
    many = stored(many)  # of known size, so that vectors need no shuffle to meet it where it is small
    place = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    items = points.join(many, [*keys]).withColumn("_ib", place("item_id", "_ni")).withColumn("_qb", spread("_nq")).drop("_ni", "_nq")
    asked = asks.where("vector is not null").join(many, [*keys]).withColumn("_qb", place("ask", "_nq")).withColumn("_ib", spread("_ni")).withColumn("whole", F.col("_ni") == 1).drop("_ni", "_nq")
    asked = asked.select(*keys, *(["channel"] if "channel" not in keys else []), "_ib", "_qb", "ask", "whole", "expanded", "resolved", "role", "vector", "terms")

    def tile(q: pa.Table, i: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if q.num_rows and i.num_rows:
            i = i.sort_by("item_id").combine_chunks()
            column = lambda t, name: t[name].combine_chunks()
            unit = lambda rows: (m := rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            vectors, texts, terms = unit(column(i, "vector")), column(q, "expanded").dictionary_encode(), column(q, "terms")
            year, role = column(i, "year").cast(pa.float64()).to_numpy(zero_copy_only=False), np.array(i["speaker_role"].to_pylist(), object)
            item, term, tf = _rows_of(column(i, "terms")), column(i, "terms").flatten().to_numpy(zero_copy_only=False), column(i, "tf").flatten().to_numpy(zero_copy_only=False)
            ask, whole, call = q["ask"].to_numpy(), q["whole"].to_pylist(), [c == "concall" for c in q["channel"].to_pylist()]
            resolved, wanted = q["resolved"].to_pylist(), q["role"].to_pylist()
            meets: dict[tuple, np.ndarray] = {}
            code = texts.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                score = np.round(vectors @ unit(column(q, "vector").slice(group[0], 1))[0], 6)
                best = np.argsort(-score, kind="stable")
                own = np.array(terms[int(group[0])].as_py(), np.int64)
                at = np.full(1 + max(own.max(initial=0), term.max(initial=0)), -1)
                at[own] = np.arange(len(own))
                known = at[term] >= 0
                often = np.zeros((len(vectors), len(own)), np.int32)
                often[item[known], at[term[known]]] = tf[known]
                for a in group:
                    asks_for = (tuple(resolved[a] or ()), wanted[a])
                    if asks_for not in meets:
                        meets[asks_for] = (np.isin(year, asks_for[0]) if asks_for[0] else np.ones(len(year), bool)) & (role == asks_for[1] if asks_for[1] is not None else True)
                    k, enough = (k_call, 1) if call[a] else (k_annual, least)
                    met = best[meets[asks_for][best]][:k]
                    few = len(met) < enough
                    for free, chosen in ((False, met if not (few and whole[a]) else met[:0]), (True, best[:k] if few else met[:0])):
                        if len(chosen):
                            parts.append((np.full(len(chosen), ask[a]), np.full(len(chosen), free), np.full(len(chosen), k, np.int32), chosen, score[chosen], often[chosen].ravel(), np.full(len(chosen), len(own))))
        if not parts:
            return _EMPTY_NEAR
        asked, free, most, chosen, score, often, wide = (np.concatenate(x) for x in zip(*parts))
        rows = pa.array(chosen)
        columns = [pa.array(asked), pa.array(free), pa.array(most), column(i, "item_id").take(rows), pa.array(score), column(i, "year").take(rows), column(i, "speaker_role").take(rows), column(i, "len").take(rows)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(wide)]), pa.int32())
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(often, pa.int32()))], names=_EMPTY_NEAR.column_names)

    tiles = [*keys, "_ib", "_qb"]
    return asked.groupBy(*tiles).cogroup(items.groupBy(*tiles)).applyInArrow(tile, _NEAR)


_EMPTY_NEAR = pa.table({"ask": pa.array([], pa.int64()), "free": pa.array([], pa.bool_()), "k": pa.array([], pa.int32()), "item_id": pa.array([], pa.int64()), "vector_score": pa.array([], pa.float64()), "year": pa.array([], pa.int32()), "speaker_role": pa.array([], pa.string()), "len": pa.array([], pa.int32()), "tf": pa.array([], pa.list_(pa.int32()))})


def retrieve(questions: DataFrame, points: DataFrame, embedder: Callable[[Column], Column] = embed, k_annual: int = TOP_ANNUAL, k_call: int = TOP_CALL, least: int = MIN_RESULTS, **blocks: int) -> DataFrame:
    """The candidates of many questions, scored and ranked.

    questions: query_id, query, doc_type (annual_report, concall or anything else for both), symbol (NULL
    for all companies), and optionally year, year_from, year_to, speaker_role. points: item_id, text,
    vector, doc_type, symbol, year, speaker_role. Returns query_id, doc_type, item_id, vector_score, bm25,
    score, rank, widened, resolved and explicit years.

    A question is expanded, embedded and meets the points of its company in its years. A report channel
    with fewer than `least` of them is searched again in all years; a call channel without any is
    searched again by company alone, in all years and roles. BM25 runs over a question's own candidates,
    both scores are fused, reports gain by recency and calls lose by speaker. Questions and points
    without text, vector or id have no part; repeated questions count once.

    What questions ask (their text, channel, company, years and role) is answered once, however many ask
    it. Texts of points are read once, for their counts of the questions' words: those words come to the
    driver, and no text is shuffled here or joined with candidates.
    """
    for c, kind in (("speaker_role", "string"), ("year", "int"), ("year_from", "int"), ("year_to", "int")):
        if c not in questions.columns:
            questions = questions.withColumn(c, F.lit(None).cast(kind))
    channels = F.when(F.col("doc_type").isin("annual_report", "concall"), F.array("doc_type")).otherwise(F.array(F.lit("annual_report"), F.lit("concall")))
    raw = F.struct("query", channels.alias("channels"), F.upper(F.trim("symbol")).alias("symbol"), "speaker_role", "year", "year_from", "year_to")
    asking = stored(questions.where("query_id is not null").select(F.col("query_id").cast("bigint").alias("query_id"), raw.alias("raw")).distinct())
    q = resolved_years(asking.select("raw").distinct().select("raw", "raw.*")).withColumn("expanded", expanded("query")).withColumn("channel", F.explode("channels"))
    role = F.when(F.col("channel") == "concall", F.col("speaker_role")).alias("role")  # roles count in calls only
    q = stored(q.where("expanded is not null").select("raw", F.struct("channel", "symbol", role, "resolved", "explicit", "expanded").alias("what")))
    asks = stored(q.select("what").distinct().select(F.monotonically_increasing_id().alias("ask"), "what"))
    vocabulary = [r["w"] for r in asks.select(F.explode(tokens(F.col("what.expanded"))).alias("w")).distinct().orderBy("w").collect()]
    counted = _counted(vocabulary)
    full = asks.select("ask", "what.*", embedder(F.col("what.expanded")).alias("vector"), counted(tokens(F.col("what.expanded"))).alias("c")).select("*", "c.terms")
    p = points.where("item_id is not null and vector is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("doc_type").alias("channel"), F.upper(F.trim("symbol")).alias("symbol"), F.col("year").cast("int").alias("year"), "speaker_role", "vector", counted(tokens(F.col("text"))).alias("c"))
    p = stored(p.select("item_id", "channel", "symbol", "year", "speaker_role", "vector", "c.*"))  # as a vector store would hold them

    near = _near(full.where("symbol is not null"), p, ("channel", "symbol"), k_annual, k_call, least, **blocks)
    if not asks.where("what.symbol is null").isEmpty():
        near = near.unionByName(_near(full.where("symbol is null"), p.drop("symbol"), ("channel",), k_annual, k_call, least, **blocks))
    w = Window.partitionBy("ask", "free").orderBy(F.desc("vector_score"), "item_id")
    best = near.repartition("ask").withColumn("place", F.row_number().over(w)).where("place <= k")
    lists = best.groupBy("ask").agg(F.count_if(~F.col("free")).alias("n"), F.collect_list(F.struct("free", "item_id", "vector_score", "year", "speaker_role", "len", "tf")).alias("c"))
    met = asks.select("ask", "what", counted(tokens(F.col("what.expanded")))["tf"].alias("qn")).join(lists, "ask")
    met = met.withColumn("widened", F.col("n") < F.when(F.col("what.channel") == "concall", 1).otherwise(least))
    met = met.withColumn("c", F.when(F.col("widened"), F.filter("c", lambda x: x.free)).otherwise(F.filter("c", lambda x: ~x.free)))
    met = met.withColumn("bm25", _bm25_of_lists("qn", F.col("c.len"), F.col("c.tf")))
    names = ("vector_score", "bm25")
    lists = {"vector_score": F.col("c.vector_score"), "bm25": F.col("bm25")}
    ranges = (F.round(f(lists[c]), 6).alias(f"_{end}_{c}") for c in names for end, f in (("low", F.array_min), ("high", F.array_max)))
    rows = met.select("ask", "what", "widened", *ranges, F.explode(F.arrays_zip("c", "bm25")).alias("x"))
    rows = rows.select("ask", "what", "widened", *(c for c in rows.columns if c[0] == "_"), "x.c.*", F.round("x.bm25", 6).alias("bm25"))
    score = F.round(sum((scaled(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}")) for c in names), F.lit(0.0)) / 2, 6)
    rows = rows.withColumn("score", score).withColumn("score", adjusted(doc_type="what.channel"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("last"), "item_id", "vector_score", "bm25", "score")))
    answers = rows.groupBy("ask").agg(F.first("what").alias("what"), F.first("widened").alias("widened"), ranked.alias("c"))
    found = asking.join(q, "raw").select("query_id", "what").join(answers, "what").select("query_id", "what", "widened", F.posexplode("c").alias("at", "x"))
    return found.select("query_id", F.col("what.channel").alias("doc_type"), "x.item_id", "x.vector_score", "x.bm25", "x.score", (F.col("at") + 1).alias("rank"), "widened", "what.resolved", "what.explicit")


def questions_of_needs(needs: DataFrame, calls: tuple[str, ...]) -> DataFrame:
    """Questions for `retrieve` from needs sought in text: query_id, metric, raw_text, need_type, sub_type, symbol, years.

    The question is the metric's name and, unless it has it already, the original wording. Outlooks and
    the kinds in `calls` are sought in calls, all others in reports.
    """
    raw = F.coalesce("raw_text", F.lit(""))
    query = F.when((raw != "") & ~F.contains(F.lower("metric"), F.lower(raw)), F.concat("metric", F.lit(" "), raw)).otherwise(F.col("metric"))
    where = F.when((F.col("need_type") == "forward_looking") | F.col("sub_type").isin(*calls), "concall").otherwise("annual_report")
    return needs.select("query_id", query.alias("query"), where.alias("doc_type"), "symbol", F.array_min("years").alias("year_from"), F.array_max("years").alias("year_to"))
