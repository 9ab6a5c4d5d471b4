"""Numbers claimed in text against numbers reported: extraction, choice and comparison of claims."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import divergence
from ledgerloom.functions.fiscal import fiscal_year_of_text
from ledgerloom.functions.text import sentences
from ledgerloom.operators.bridge import Fetched
from ledgerloom.operators.catalog import KINDS
from ledgerloom.operators.units import named_units, to_common_units

CONFIRM, CONTRADICT = 0.10, 0.15
# Parts whose claims weigh more, words that make a claim an outlook, and the form of a number with its unit.
MANAGEMENT = ("management", "ceo", "cfo", "md", "cmd")
FORWARD = r"(?i)\b(we expect|we anticipate|going forward|guidance|target|forecast|next year|next quarter|h1|h2|fy2[0-9]|by fy|by march|plan to|we are confident|we aim|we intend|projected|aspire)\b"
NUMBER = r"(?i)(?:Rs\.?\s*)?(\d[\d,]*(?:\.\d+)?)(?:\s*[-–]\s*(\d[\d,]*(?:\.\d+)?))?\s*(%|crore|cr\.?\b|lakh|billion|million|rs\.?\b|x\b)"
#: Words by which a sentence speaks of a kind of figure, and the kind's unit. Our own list; replaceable by argument.
SIGNALS = (
    ("revenue", ("revenue", "sales", "turnover"), "crore"), ("operating_profit", ("operating profit",), "crore"), ("net_profit", ("net profit", "profit after tax"), "crore"), ("ebitda", ("ebitda",), "crore"), ("capex", ("capex", "capital expenditure", "invoice"), "crore"),
    ("borrowings", ("borrowing", "debt"), "crore"), ("order_book", ("order book",), "crore"), ("opm", ("margin", "pricing"), "%"), ("growth", ("growth", "guidance"), "%"), ("pe", ("price to earnings",), "x"),
)


def unit_of(raw: Column) -> Column:
    u = F.regexp_replace(F.lower(raw), r"\.$", "")
    return F.when(u == "cr", "crore").otherwise(u)


def number(raw: Column) -> Column:
    return F.nullif(F.replace(raw, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def claims_of_text(chunks: DataFrame, signals=SIGNALS) -> DataFrame:
    """Every number with a unit in a sentence that speaks of a kind of figure.

    chunks: chunk_id, text and whatever else is to be kept. Adds sentence_no, sub_type, value_low,
    value_high, unit, is_forward, source_text (300 characters). Figures in % or crore kinds must have a
    unit that fits; others take any. Sentences are prefiltered by one alternation of all words, then the
    few kinds are literals of the plan: there is no join.
    """
    some = "|".join("\\Q" + w + "\\E" for _, words, _ in signals for w in words)
    s = chunks.where(F.col("text").isNotNull()).select("*", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence")).where(F.lower("sentence").rlike(some))
    kinds = F.filter(
        F.array(*(F.when(F.lower("sentence").rlike("|".join("\\Q" + w + "\\E" for w in words)), F.struct(F.lit(kind).alias("sub_type"), F.lit(hint).alias("hint"))) for kind, words, hint in signals)), lambda x: x.isNotNull()
    )
    groups = [F.regexp_extract_all("sentence", F.lit(NUMBER), F.lit(i)) for i in (1, 2, 3)]
    figures = F.arrays_zip(groups[0].alias("low"), groups[1].alias("high"), groups[2].alias("raw_unit"))
    rows = s.withColumn("kind", F.explode(kinds)).select("*", F.posexplode(figures).alias("figure_no", "f"))
    out = rows.select(
        *(c for c in chunks.columns if c != "text"), "sentence_no", "figure_no", "kind.sub_type", F.col("kind.hint").alias("hint"), number(F.col("f.low")).alias("value_low"), number(F.col("f.high")).alias("value_high"), unit_of(F.col("f.raw_unit")).alias("unit"),
        F.col("sentence").rlike(FORWARD).alias("is_forward"), F.substring("sentence", 1, 300).alias("source_text"),
    )
    fits = F.when(F.col("hint") == "%", F.col("unit") == "%").when(F.col("hint") == "crore", F.col("unit").isin("crore", "lakh", "billion")).otherwise(True)
    return out.where(fits & F.col("value_low").isNotNull()).drop("hint")


def deduplicated(claims: DataFrame, order: list[str]) -> DataFrame:
    """Of claims with one kind and one beginning of text (80 characters), the one of the highest chunk_score; ties by `order`."""
    w = Window.partitionBy("sub_type", F.substring("source_text", 1, 80)).orderBy(F.desc_nulls_last("chunk_score"), *order)
    return claims.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def best_claims(claims: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's best claim: management first, then the highest score, then the least `order`. One aggregate, combined before the shuffle."""
    role = F.lower(F.trim("speaker_role")).isin(*MANAGEMENT).cast("int")
    rank = F.struct(F.coalesce(role, F.lit(0)).alias("r"), F.coalesce("chunk_score", F.lit(-1.0)).alias("s"), (-F.col(order)).alias("o"))
    rest = [c for c in claims.columns if c not in keys]
    return claims.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("best")).select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def cross_reference(rows: DataFrame, claims: DataFrame, strict: bool = False) -> DataFrame:
    """Every reported figure against the best claim of its kind: row_id, insight, divergence_pct, claim_id.

    UNMATCHED without a claim, FORWARD if the best one is an outlook, CONFIRM up to CONTRADICT, else
    CONTRADICT. A range counts as its middle; lakh become crore. strict also matches symbol and year;
    otherwise only the kind decides, as in the reference. NULL figures give no row. Both sides must be in
    the unit their rows name; `in_common_units` brings them there.
    """
    keys = ["sub_type", *(["symbol", "year"] if strict else [])]
    best = best_claims(claims.select(*keys, "claim_id", "value_low", "value_high", "unit", "is_forward", "speaker_role", "chunk_score"), keys, "claim_id").withColumnRenamed("unit", "claim_unit")
    middle = F.when(F.coalesce("value_high", F.lit(0.0)) != 0, (F.col("value_low") + F.col("value_high")) / 2).otherwise(F.col("value_low"))
    scaled = F.when((F.col("claim_unit") == "lakh") & (F.col("unit") == "crore"), middle / 100).otherwise(middle)
    div = divergence(F.col("value"), scaled)
    x = rows.where(F.col("value").isNotNull()).join(best, keys, "left")
    forward = F.coalesce("is_forward", F.lit(False))
    return x.select(
        "row_id", "sub_type", "claim_id", F.when(F.col("claim_id").isNull(), "UNMATCHED").when(forward, "FORWARD").when(div >= CONTRADICT, "CONTRADICT").otherwise("CONFIRM").alias("insight"),
        F.when(F.col("claim_id").isNotNull() & ~forward, F.round(div * 100, 2)).alias("divergence_pct"),
    )


def in_common_units(rows: DataFrame, claims: DataFrame, metric_units: DataFrame, fx_rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reported figures and claims in the common unit of their kind, as problem 1 converts them; both ends of a claimed range by one factor."""
    found = to_common_units(named_units(rows, claims, metric_units), fx_rates)
    of = lambda name, key: found.where(F.col("source_table") == name).select(F.col("record_id").alias(key), F.col("common_value").alias("_v"), F.col("common_unit").alias("_u"), F.try_divide("common_value", "value").alias("_f"))
    r = rows.dropDuplicates(["row_id"]).join(of("metric_rows", "row_id"), "row_id").withColumn("value", F.col("_v")).withColumn("unit", F.col("_u")).drop("_v", "_u", "_f")
    c = claims.dropDuplicates(["claim_id"]).join(of("concall_claims", "claim_id"), "claim_id").withColumn("value_low", F.col("_v")).withColumn("value_high", F.col("value_high") * F.col("_f")).withColumn("unit", F.col("_u")).drop("_v", "_u", "_f")
    return r, c


def orphan_outlooks(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Outlooks of kinds of which nothing was reported."""
    return claims.where("is_forward").join(rows.select("sub_type").distinct(), "sub_type", "left_anti")


# The columns in which warehouse tables have their date, in the order in which they are tried.
PERIOD_COLUMNS = ("period_end", "as_of_date", "annual_end", "date", "snapshot_date", "action_date", "effective_date")
_ROW = ("symbol", "sub_type", "metric", "year", "period", "value", "value_col", "unit", "raw_row")


def period_of(columns: list[str]) -> Column:
    """The first of a row's dates that isn't empty, as text; "" without any."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in PERIOD_COLUMNS if c in columns), F.lit(""))


def rows_of_kind(rows: DataFrame, sub_type: str, metric: str = "", symbol: str | None = None) -> DataFrame:
    """Fetched warehouse rows of one kind as metric rows: its figure as a number (NULL if it is none), its unit, period and fiscal year.

    A kind the catalogue doesn't know has the first column that is no key as its figure, and no unit.
    """
    keys = {"symbol", "period_type", *PERIOD_COLUMNS}
    kind = KINDS.get(sub_type)
    column = kind.value if kind else next((c for c in rows.columns if c not in keys), None)
    period = period_of(rows.columns)
    own = F.coalesce(F.col("symbol"), F.lit(symbol), F.lit("")) if "symbol" in rows.columns else F.lit(symbol or "")
    value = F.col(column).cast("string").try_cast("double") if column in rows.columns else F.lit(None).cast("double")
    return rows.select(
        own.alias("symbol"), F.lit(sub_type).alias("sub_type"), F.lit(metric or sub_type.replace("_", " ")).alias("metric"), fiscal_year_of_text(F.substring(period, 1, 10)).alias("year"), period.alias("period"), value.alias("value"), F.lit(column or "").alias("value_col"),
        F.lit(kind.unit if kind else "").alias("unit"), F.to_json(F.struct(*rows.columns)).alias("raw_row"),
    )


def metric_rows_of(fetched: list[Fetched]) -> DataFrame | None:
    """The rows of all needs that were fetched without an error, united; None if there are none."""
    good = [rows_of_kind(f.rows, f.atom.sub_type, f.atom.metric, f.atom.symbol) for f in fetched if f.error is None and f.rows is not None]
    return reduce(DataFrame.unionByName, good) if good else None


class Fused(NamedTuple):
    metric_rows: DataFrame
    claims: DataFrame
    insights: DataFrame
    annual_chunks: DataFrame
    concall_chunks: DataFrame
    errors: list[str]


def of_type(insights: DataFrame, insight: str) -> DataFrame:
    """The insights of one type: CONFIRM, CONTRADICT, FORWARD or UNMATCHED."""
    return insights.where(F.col("insight") == insight)


def by_channel(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks of reports and all others, chunks of calls)."""
    call = F.coalesce(F.col("doc_type") == "concall", F.lit(False))
    return chunks.where(~call), chunks.where(call)


def fused_rows(metric_rows: DataFrame, chunks: DataFrame, signals=SIGNALS, strict: bool = False, errors: list[str] | None = None) -> Fused:
    """Reported figures against what is claimed in calls.

    metric_rows: as of `metric_rows_of`; chunks: chunk_id, text, doc_type, score and what else is known
    of them (symbol, year, speaker, speaker_role). Claims are sought only for kinds that were reported or
    asked for (`signals`), deduplicated by kind and beginning, and the best of each kind is compared.
    Insights have sub_type, symbol, year, value, claim_id, insight, divergence_pct and note; outlooks of
    kinds without a figure are FORWARD insights of their own.
    """
    annual, calls = by_channel(chunks)
    rows = metric_rows.withColumn("row_id", F.xxhash64("symbol", "sub_type", "period", "value_col", "raw_row"))
    kept = [c for c in ("symbol", "year", "speaker", "speaker_role") if c in calls.columns]
    claims = claims_of_text(calls.select("chunk_id", "text", F.col("score").alias("chunk_score"), *kept), signals)
    for c, kind in (("symbol", "string"), ("year", "int"), ("speaker", "string"), ("speaker_role", "string")):
        if c not in kept:
            claims = claims.withColumn(c, F.lit(None).cast(kind))
    claims = deduplicated(claims, ["chunk_id", "sentence_no", "figure_no"]).withColumn("claim_id", F.conv(F.substring(F.md5(F.concat_ws("|", "chunk_id", "sentence_no", "figure_no", "sub_type")), 1, 15), 16, 10).cast("bigint"))
    compared = cross_reference(rows, claims, strict).drop("sub_type").join(rows, "row_id").join(claims.select("claim_id", F.col("source_text")), "claim_id", "left")
    note = F.concat_ws(" ", F.col("metric"), "period", F.coalesce(F.concat(F.lit("differs by "), F.col("divergence_pct").cast("string"), F.lit("%:")), F.lit("")), F.substring("source_text", 1, 100))
    first = compared.select("sub_type", "symbol", "year", "value", "claim_id", "insight", "divergence_pct", note.alias("note"))
    lone = orphan_outlooks(rows, claims).select("sub_type", "symbol", "year", F.lit(None).cast("double").alias("value"), "claim_id", F.lit("FORWARD").alias("insight"), F.lit(None).cast("double").alias("divergence_pct"), F.concat(F.lit("no reported figure: "), F.substring("source_text", 1, 100)).alias("note"))
    return Fused(metric_rows, claims, first.unionByName(lone), annual.orderBy(F.desc("score"), "chunk_id"), calls.orderBy(F.desc("score"), "chunk_id"), errors or [])


def fuse(fetched: list[Fetched], chunks: DataFrame, signals=SIGNALS, strict: bool = False) -> Fused:
    """`fused_rows` of what the bridge fetched: errors are carried, and only kinds that were fetched without one are sought in text."""
    active = {f.atom.sub_type for f in fetched if f.error is None}
    rows = metric_rows_of(fetched)
    if rows is None:
        rows = chunks.sparkSession.createDataFrame([], "symbol string, sub_type string, metric string, year int, period string, value double, value_col string, unit string, raw_row string")
    chosen = tuple(x for x in signals if x[0] in active)
    return fused_rows(rows, chunks, chosen or (("", ("\u0000",), ""),), strict, [f.error for f in fetched if f.error])


def context(found: Fused, most: int = 10) -> dict[str, DataFrame]:
    """What a prompt is made of: rounded figures, insights, and the first chunks of each channel with the beginning of their text."""
    shown = lambda df: df.select("chunk_id", F.substring("text", 1, 500).alias("text"), F.round("score", 4).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(most)
    return {
        "metric_rows": found.metric_rows.select("symbol", "metric", "period", F.round("value", 4).alias("value"), "unit"), "insights": found.insights.select("insight", "sub_type", "symbol", F.round("divergence_pct", 4).alias("divergence_pct"), "note"),
        "annual_chunks": shown(found.annual_chunks), "concall_chunks": shown(found.concall_chunks),
    }


def with_reranked(chunks: DataFrame, extra: DataFrame, tag: str = "reranker_top") -> DataFrame:
    """Chunks of the bridge and those the reranker put first, each once; the latter under their tag where the bridge doesn't have them. Column from tells which."""
    own = chunks.withColumn("from", F.lit("bridge"))
    return own.unionByName(extra.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns).withColumn("from", F.lit(tag)))


def source_line(section: str = "section", speaker: str = "speaker", score: str = "score") -> list[Column]:
    """Where a passage is from, in at most 50 characters, and its score to 4 places."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return [F.substring(F.coalesce(blank(section), blank(speaker), F.lit("")), 1, 50).alias("place"), F.round(score, 4).alias("score")]


def totals(fetched: list[Fetched], chunks: DataFrame) -> dict[str, int]:
    """Rows, chunks and errors of a fetch."""
    return {"rows": sum(f.rows.count() for f in fetched if f.rows is not None), "chunks": chunks.count(), "errors": sum(f.error is not None for f in fetched)}


def symbol_of(chunks: DataFrame, symbol: str | None = None) -> str | None:
    """The company asked for, else that of the best chunk that names one."""
    if symbol:
        return symbol
    first = chunks.where(F.coalesce("symbol", F.lit("")) != "").orderBy(F.desc("score"), "chunk_id").select("symbol").first()
    return first[0] if first else None
