"""A table as result cache: exact keys, nearest questions, expiry and invalidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.fiscal import fresh
from ledgerloom.operators.retrieval import cosine_topk

TTL, SIMILAR = 7 * 24 * 3600, 0.92


def exact_key(query: str = "query", symbol: str = "symbol", doc_type: str = "doc_type", years: str = "years") -> Column:
    """SHA-256 of the canonical question: trimmed text, upper-case company, type, sorted years."""
    return F.sha2(F.concat_ws("|", F.trim(query), F.coalesce(F.upper(F.trim(symbol)), F.lit("")), F.coalesce(doc_type, F.lit("")), F.coalesce(F.array_join(F.array_sort(F.transform(years, lambda y: y.cast("string"))), ","), F.lit(""))), 256)


def lookup(questions: DataFrame, cache: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Questions with the newest live entry of their key: hit and response."""
    live = cache.where(fresh("stored_at", now, ttl)).groupBy("key").agg(F.max_by("response", F.struct("stored_at", "entry_id")).alias("response"))
    return questions.join(live, "key", "left").withColumn("hit", F.col("response").isNotNull())


def nearest(questions: DataFrame, cache: DataFrame, least: float = SIMILAR, but_self: bool = False, **blocks: int) -> DataFrame:
    """Each question's nearest entry of its company and type: question_id, entry_id, similarity, hit.

    Vectors meet in tiles of one company and type (`cosine_topk`), so that a company with a large part of
    all entries isn't one task. Years are looked at on the nearest entry alone: where both name years,
    they must overlap. but_self: questions and entries share their ids, and an entry isn't looked up in
    itself.
    """
    keys = ("symbol", "doc_type")
    q, e = questions.select(F.col("question_id").alias("query_id"), *keys, "vector"), cache.select(F.col("entry_id").alias("item_id"), *keys, "vector")
    near = cosine_topk(q, e, 1, keys=keys, but_self=but_self, **blocks).select(F.col("query_id").alias("question_id"), F.col("item_id").alias("entry_id"), F.col("score").alias("similarity"))
    met = near.join(questions.select("question_id", F.col("years").alias("qy")), "question_id").join(cache.select("entry_id", F.col("years").alias("cy")), "entry_id")
    years_meet = (F.size("qy") == 0) | (F.size("cy") == 0) | F.arrays_overlap("qy", "cy")
    return met.select("question_id", "entry_id", "similarity", (years_meet & (F.col("similarity") >= least)).alias("hit"))


def stored(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries, the last of each key."""
    both = cache.unionByName(new)
    return both.groupBy("key").agg(F.max_by(F.struct(*both.columns), F.struct("stored_at", "entry_id")).alias("e")).select("e.*")


def invalidated(cache: DataFrame, symbol: str | None = None, doc_type: str | None = None) -> DataFrame:
    """What stays after dropping a company's and type's entries; without arguments nothing stays."""
    hit = F.lit(True)
    if symbol:
        hit = hit & (F.upper("symbol") == symbol.upper())
    if doc_type:
        hit = hit & (F.col("doc_type") == doc_type)
    return cache.where(~F.coalesce(hit, F.lit(False)))


def stats(cache: DataFrame, ttl: int = TTL, threshold: float = SIMILAR) -> DataFrame:
    """Entries, their size, and the settings they are looked up with."""
    return cache.agg(F.count("*").alias("entries"), F.sum(F.length("response")).alias("bytes"), F.lit(ttl).alias("ttl"), F.lit(threshold).alias("threshold"))


def within_budget(chunks: DataFrame, budget: int, key: str, order: list[Column | str], extra: int = 250) -> DataFrame:
    """Leading chunks of each key while the sum of their lengths plus `extra` stays in the budget; at least one, none for a budget of 0 or less."""
    w = Window.partitionBy(key).orderBy(*order)
    cost = F.sum(F.length("text") + extra).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = chunks.withColumn("used", cost).withColumn("place", F.row_number().over(w))
    return kept.where(((F.col("used") <= budget) | (F.col("place") == 1)) & F.lit(budget > 0))


def within_tokens(chunks: DataFrame, budget: int, key: str, order: list[Column | str], extra: int = 60, chars_a_token: float = 3.5) -> DataFrame:
    """Leading chunks of each key while their estimated tokens plus `extra` each stay in the budget; at least one, and the first three for a budget of 0 or less."""
    w = Window.partitionBy(key).orderBy(*order)
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / chars_a_token)) + extra
    kept = chunks.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return kept.where((F.col("used") <= budget) | (F.col("place") == 1) if budget > 0 else F.col("place") <= 3)
