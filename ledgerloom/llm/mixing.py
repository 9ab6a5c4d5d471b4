"""Problem 9: drawing texts by source to target shares of tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.tokens import TOKENIZERS, token_count
from ledgerloom.session import cut, stored


def temper(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised; sources without tokens get 0."""
    logs = {k: exponent * math.log(v) for k, v in shares.items() if v > 0}
    top = max(logs.values(), default=0.0)
    powers = {k: math.exp(v - top) for k, v in logs.items()}
    total = sum(powers.values()) or 1.0
    return {k: powers.get(k, 0.0) / total for k in shares}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def exponent_for_entropy(shares: dict[str, float], target: float, steps: int = 60) -> float:
    """The exponent in [0, 8] whose tempered shares have the target entropy, which falls as it grows."""
    low, high = 0.0, 8.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(temper(shares, mid)) > target else (low, mid)
    return (low + high) / 2


def weights(targets: dict[str, float], tokens: dict[str, int], max_repeats: dict[str, int], budget: float, steps: int = 80) -> dict[str, float]:
    """Weights of the mix: the targets, tempered by what each source can supply.

    A source's availability is the share of its target that its tokens cover when each text is used
    max_repeats times, at most 1. Target times availability to an exponent keeps the proportions of all
    sources that have enough; the least exponent at which no source exceeds its repetition limit is
    found by bisection. Absent sources get 0. Where even all sources together can't fill the budget,
    each is drawn to its limit.
    """
    capacity = {k: tokens.get(k, 0) * max(0, max_repeats.get(k, 0)) for k in targets}
    usable = {k: t for k, t in targets.items() if t > 0 and capacity[k] > 0}
    whole = sum(usable.values())
    if not usable or budget <= 0:
        return {k: 0.0 for k in targets}
    if sum(capacity[k] for k in usable) <= budget:
        return {k: capacity.get(k, 0) / budget if k in usable else 0.0 for k in targets}
    goal = {k: t / whole for k, t in usable.items()}
    held: dict[str, float] = {}
    while True:
        free = {k: t for k, t in goal.items() if k not in held}
        room = 1.0 - sum(held.values())
        norm = sum(free.values())
        reach = {k: min(1.0, capacity[k] / max(budget * room * t / norm, 1e-300)) for k, t in free.items()}

        def tempered(exponent: float) -> dict[str, float]:
            raw = {k: t * math.exp(exponent * math.log(max(reach[k], 1e-300))) for k, t in free.items()}
            return {k: room * v / (sum(raw.values()) or 1.0) for k, v in raw.items()}

        fits = lambda w: all(budget * w[k] <= capacity[k] * (1 + 1e-9) for k in w)
        if fits(plain := tempered(0.0)):
            return {k: (held | plain).get(k, 0.0) for k in targets}
        low, high = 0.0, 64.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(tempered(mid)) else (mid, high)
        # The source that still binds at the least exponent is held at its limit; the others are tempered again.
        w = tempered(high)
        short = [k for k in free if reach[k] < 1.0]
        binding = max(short, key=lambda k: (budget * w[k] / capacity[k], k))
        held[binding] = min(capacity[binding] / budget, room)
        if len(held) == len(goal):
            return {k: held.get(k, 0.0) for k in targets}


def default_budget(targets: dict[str, float], tokens: dict[str, int], max_repeats: dict[str, int], reach: float) -> float:
    """The most tokens at which sources with `reach` of the target mass that is present meet their targets."""
    capacity = {k: tokens.get(k, 0) * max(0, max_repeats.get(k, 0)) for k in targets}
    usable = {k: t for k, t in targets.items() if t > 0 and capacity[k] > 0}
    whole, met = sum(usable.values()), 0.0
    for k in sorted(usable, key=lambda k: (-capacity[k] / usable[k], k)):
        met += usable[k]
        if met >= reach * whole - 1e-12:
            return math.floor(capacity[k] * whole / usable[k])
    return 0.0


_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("budget", T.LongType()), T.StructField("max_repeats", T.IntegerType())])


def measured(documents: DataFrame, folder: str = TOKENIZERS, idle: Column | None = None) -> DataFrame:
    """Distinct texts with tokens: doc_id (the least of its copies, of those that aren't idle if there are any), source, tokens."""
    idle = F.lit(False) if idle is None else idle
    texts = documents.select("doc_id", F.trim("source").alias("source"), "text", idle.alias("idle")).where(F.col("source").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counted = texts.select("doc_id", "source", "idle", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), token_count(texts, "text", folder).alias("tokens"))
    one = counted.groupBy("h1", "h2").agg(F.min(F.struct("idle", "doc_id", "source", "tokens")).alias("d"))
    return one.select("d.doc_id", "d.source", "d.tokens").where(F.col("tokens") > 0)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, reach: float = 0.95, seed: int = 0, blocks: int = 1024, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). drawn: doc_id, source, tokens, times. report: one row per source of `targets`.

    `total_tokens` is the size of the mix; by default the largest at which sources with `reach` of the
    target mass that is present meet their targets, so that one tiny source can't shrink the mix. report has source, target_share, texts, tokens_available, tokens_drawn, max_times and
    actual_share (of the tokens drawn; NULL if nothing was drawn). The actual share misses the target
    where a source is absent or too small to reach it with max_repeats uses of each text.

    Exact copies of a text are one text, so none is used more than max_repeats times whatever its
    copies; NULL and empty texts and sources not named have no part; a NULL share counts as 0 and a NULL
    max_repeats as 1; repeated rows count once (of several rows of one source the largest share holds).

    Only one row per named source comes to the driver. A source of any size is laid out as `blocks`
    blocks of a hashed permutation: token sums per block give the block in which the budget ends, and
    only inside that block are single texts ordered, so no task holds a whole source.
    """
    spark = documents.sparkSession
    goals = targets.select(F.trim("source").alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats"))
    # Only copies within named sources are reduced, and one that asks for nothing comes last, so that a source without a target takes no text from one with.
    idle = (F.col("target_share") <= 0) | (F.col("max_repeats") <= 0)
    named = documents.select("doc_id", F.trim("source").alias("source"), "text").join(F.broadcast(goals.select("source", idle.alias("idle"))), "source")
    texts = measured(named, folder, F.col("idle")).join(goals.select("source", "max_repeats"), "source")
    place = F.xxhash64("doc_id", F.lit(seed))
    texts = cut(texts.select("doc_id", "source", "tokens", "max_repeats", place.alias("place"), F.pmod(place, F.lit(blocks)).cast("int").alias("block")))
    per_block = texts.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    rows = goals.join(per_block.groupBy("source").agg(F.sum("block_tokens").alias("tokens")), "source", "left").collect()  # one per named source
    have = {r.source: r.tokens or 0 for r in rows}
    shares, repeats = {r.source: float(r.target_share) for r in rows}, {r.source: r.max_repeats for r in rows}
    budget = float(total_tokens) if total_tokens is not None else default_budget(shares, have, repeats, reach)
    w = weights(shares, have, repeats, budget)
    plan = spark.createDataFrame([(r.source, w[r.source], int(round(w[r.source] * budget)), r.max_repeats) for r in rows], _PLAN)

    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_block.withColumn("before", F.coalesce(F.sum("block_tokens").over(ahead), F.lit(0)))
    totals = placed.groupBy("source").agg(F.sum("block_tokens").alias("source_tokens"))
    passes = plan.join(totals, "source").withColumn("full", F.least(F.expr("budget div source_tokens"), F.col("max_repeats").cast("bigint"))).withColumn(
        "rest", F.when(F.col("full") < F.col("max_repeats"), F.col("budget") - F.col("full") * F.col("source_tokens")).otherwise(0)
    )
    edges = placed.join(passes.select("source", "full", "rest"), "source").select(
        "source", "block", "full", "rest", "before", (F.col("before") + F.col("block_tokens") <= F.col("rest")).alias("whole"), (F.col("before") < F.col("rest")).alias("touched")
    )
    laid = texts.drop("max_repeats").join(edges, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    settled = laid.where(F.col("whole") | ~F.col("touched")).select("doc_id", "source", "tokens", (F.col("full") + F.when(F.col("whole"), 1).otherwise(0)).alias("times"))
    # In the block where the budget ends, a text is drawn if more than half of it still fits.
    at_edge = laid.where(~F.col("whole") & F.col("touched")).withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    split = at_edge.select("doc_id", "source", "tokens", (F.col("full") + F.when(F.col("start") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)).alias("times"))
    drawn = settled.unionByName(split).where(F.col("times") > 0).select("doc_id", "source", "tokens", F.col("times").cast("int").alias("times"))

    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens_drawn"), F.max("times").alias("max_times"), F.count("*").alias("texts"))
    whole = used.agg(F.sum("tokens_drawn").alias("all_drawn"))
    report = (
        goals.join(totals, "source", "left").join(used, "source", "left").join(F.broadcast(whole))
        .select(
            "source", "target_share", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("source_tokens", F.lit(0)).alias("tokens_available"), F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"),
            F.coalesce("max_times", F.lit(0)).alias("max_times"), F.when(F.col("all_drawn") > 0, F.coalesce("tokens_drawn", F.lit(0)) / F.col("all_drawn")).alias("actual_share"),
        )
    )
    return drawn, report


def _at_exponents(logs: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy of tempered shares, largest share by natural share) at each exponent, from one aggregate over the sources' log shares (column l, at most 0, relative to the largest source)."""
    at = logs.select("l", F.explode(F.array(*map(F.lit, exponents))).alias("x")).withColumn("v", F.exp(F.col("x") * F.col("l")))
    sums = at.groupBy("x").agg(F.sum("v").alias("z"), F.sum(F.col("v") * F.col("l")).alias("m"), F.max(F.exp((F.col("x") - 1) * F.col("l"))).alias("r")).collect()  # one row per exponent
    found = {r.x: (math.log(r.z) - r.x * r.m / r.z, r.r / r.z) for r in sums}
    return [found[x] for x in exponents]


def tempered_shares(documents: DataFrame, keep_entropy: float = 0.9, folder: str = TOKENIZERS, total_tokens: int | None = None, max_repeats: float | None = None, sections: int = 128, passes: int = 5) -> DataFrame:
    """Every source's natural token share and its share tempered to `keep_entropy` of the largest entropy.

    Columns: source, tokens, natural_share, tempered_share. With `total_tokens` (of the mix) and
    `max_repeats`, the exponent is raised, at most to the natural shares, until no source has to be used
    more often than that. The exponent is sought in [0, 8] by splitting its interval into `sections` in
    each of `passes` aggregates over the sources, so nothing that grows with the number of sources comes
    to the driver.
    """
    per = stored(measured(documents, folder).groupBy("source").agg(F.sum("tokens").alias("tokens")))
    whole = per.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.count("*").alias("n")).first()
    total, most = whole.total or 1, whole.most or 1
    logs = per.select(F.log(F.col("tokens") / F.lit(most)).alias("l"))

    def least(high: float, short) -> float:
        """The exponent up to `high` at which `short` of (entropy, largest ratio) ends to hold."""
        low = 0.0
        for _ in range(passes if whole.n > 1 else 0):
            edges = [low + (high - low) * k / sections for k in range(sections + 1)]
            below = [k for k, found in enumerate(_at_exponents(logs, edges)) if short(*found)]
            at = min(max(below, default=0), sections - 1)
            low, high = edges[at], edges[at + 1]
        return (low + high) / 2

    exponent = least(8.0, lambda entropy, _: entropy > keep_entropy * math.log(whole.n))  # entropy falls as the exponent grows
    if total_tokens and max_repeats:
        # A source's uses are its share of the mix by its tokens: total_tokens / total * tempered / natural share; the natural share of l is exp(l) * most / total.
        exponent = max(exponent, least(1.0, lambda _, ratio: total_tokens * ratio / most > max_repeats))
    power = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(most)))
    norm = per.agg(F.sum(power)).first()[0] or 1.0
    return per.select("source", F.col("tokens").cast("bigint").alias("tokens"), (F.col("tokens") / F.lit(total)).alias("natural_share"), (power / F.lit(norm)).alias("tempered_share"))
