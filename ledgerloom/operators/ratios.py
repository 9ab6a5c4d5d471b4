"""Company ratios for all symbols and years at once.

Facts are joined once per (symbol, year); latest rows are one aggregate per symbol (max_by, which
combines before the shuffle), not a window. A figure that can't be computed is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import cagr, nonzero, pct, safe_div, yoy


def latest_by(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row in the given order; end `order` with something unique."""
    pick = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return df.groupBy(key).agg(pick).select(key, *(F.col(f"v.{v}").alias(v) for v in values))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (as-of join).

    Both sides are laid on one time line and the last right row is carried forward, so no pairs arise;
    equal times count as before; a right time should occur once per key. `bucket` cuts the line (a month
    of a date, say) so that a key of any length is many windows: what a bucket ends with is carried into
    the later ones over one row per key and bucket.
    """
    cut = bucket or (lambda _: F.lit(0))
    held = F.struct(*values)
    kind = right.select(held.alias("v")).schema[0].dataType
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v")).withColumn("_b", cut(F.col("_t")))
    b = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), held.alias("_v")).withColumn("_b", cut(F.col("_t")))
    line = a.unionByName(b, allowMissingColumns=True)
    over = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = line.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_e")).select(key, "_b", F.last("_e", ignorenulls=True).over(over).alias("_in"))
    w = Window.partitionBy(key, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = line.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").join(ends, [key, "_b"], "left").withColumn("_v", F.coalesce("_v", "_in"))
    return carried.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def trailing_sum(quarters: DataFrame, value: str, n: int = 4) -> DataFrame:
    """Sum of each symbol's n newest quarters; fewer are allowed, NULLs are ignored."""
    w = Window.partitionBy("symbol").orderBy(F.desc("fiscal_year"), F.desc("quarter"))
    return quarters.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).groupBy("symbol").agg(F.round(F.sum(value), 2).alias(f"ttm_{value}"), F.count("*").alias("quarters"))


def _positive(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, c)


def _nz(c: str) -> Column:
    return nonzero(F.col(c))


def facts_of(pl: DataFrame, bs: DataFrame) -> DataFrame:
    """Profit and loss with the balance sheet of its symbol and year, if any."""
    return pl.join(bs, ["symbol", "fiscal_year"], "left")


def with_latest(facts: DataFrame, price: DataFrame, keys: DataFrame, ttm: DataFrame) -> DataFrame:
    """Facts with each symbol's latest price, key ratios and trailing earnings, one row per symbol each."""
    return facts.join(price, "symbol", "left").join(keys, "symbol", "left").join(ttm, "symbol", "left")


def valuation_columns() -> list[Column]:
    """pe, forward_pe, pb, ps, enterprise value and its multiples."""
    close, cap = _nz("close"), _nz("market_cap")
    ev = F.col("market_cap") + F.col("total_debt") - F.col("cash")
    return [
        F.round("close", 2).alias("price"), F.round("market_cap", 2).alias("market_cap_cr"), F.coalesce(safe_div(close, _positive("ttm_eps")), safe_div(close, _positive("eps"))).alias("pe"),
        safe_div(close, _positive("forward_eps")).alias("forward_pe"), safe_div(close, _positive("book_value")).alias("pb"), safe_div(cap, _positive("revenue")).alias("ps"), F.round(ev, 2).alias("enterprise_value_cr"),
        safe_div(ev, _positive("ebitda")).alias("ev_ebitda"), safe_div(ev, _positive("revenue")).alias("ev_sales"),
    ]


def profitability_columns(precise: bool = False) -> list[Column]:
    """Revenue, ebitda, pat, margins, return on equity and on capital, asset turnover."""
    revenue = _positive("revenue")
    return [
        F.round(_nz("revenue"), 2).alias("revenue_cr"), F.round(_nz("ebitda"), 2).alias("ebitda_cr"), F.round(_nz("pat"), 2).alias("pat_cr"), pct(_nz("ebitda"), revenue, precise).alias("ebitda_margin_pct"),
        pct(_nz("pat"), revenue, precise).alias("pat_margin_pct"), pct(_nz("pat"), _positive("equity"), precise).alias("roe_pct"), pct(_nz("ebit"), _positive(F.col("equity") + F.col("total_debt")), precise).alias("roce_pct"),
        safe_div(_nz("revenue"), _positive("total_assets")).alias("asset_turnover"),
    ]


def leverage_columns() -> list[Column]:
    """Debt to equity, net debt, net debt to ebitda, interest coverage."""
    net = F.col("total_debt") - F.col("cash")
    return [safe_div(_nz("total_debt"), _positive("equity")).alias("debt_equity"), F.round(net, 2).alias("net_debt_cr"), safe_div(net, _positive("ebitda")).alias("net_debt_ebitda"), safe_div(_nz("ebit"), _positive("interest")).alias("interest_coverage")]


def valuation(pl: DataFrame, bs: DataFrame, price: DataFrame, keys: DataFrame, ttm: DataFrame) -> DataFrame:
    return with_latest(facts_of(pl, bs), price, keys, ttm).select("symbol", "fiscal_year", *valuation_columns())


def profitability(pl: DataFrame, bs: DataFrame, precise: bool = False) -> DataFrame:
    return facts_of(pl, bs).select("symbol", "fiscal_year", *profitability_columns(precise))


def leverage(pl: DataFrame, bs: DataFrame) -> DataFrame:
    return facts_of(pl, bs).select("symbol", "fiscal_year", *leverage_columns())


def against_year_before(facts: DataFrame, metrics: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """Facts with the metrics of the fiscal year before, by a window ordered by year that checks the gap: one shuffle by symbol, no second scan."""
    w = Window.partitionBy("symbol").orderBy("fiscal_year")
    adjacent = F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1
    x = facts.select("*", *(F.when(adjacent, F.lag(m).over(w)).alias(f"{m}_before") for m in metrics))
    return x, [yoy(F.col(m), F.col(f"{m}_before")).alias(f"{m}_yoy_pct") for m in metrics]


_GROWING = ("revenue", "pat", "ebitda", "eps")


def growth(pl: DataFrame, metrics: tuple[str, ...] = _GROWING) -> DataFrame:
    """Year on year change of each metric against the fiscal year before; a missing year gives NULL. One row per (symbol, year) in `pl`."""
    x, changes = against_year_before(pl, metrics)
    return x.select("symbol", "fiscal_year", *changes)


def all_ratios(pl: DataFrame, bs: DataFrame, price: DataFrame, keys: DataFrame, ttm: DataFrame) -> DataFrame:
    """Every ratio of every symbol and year, one row each: the facts are joined once and all ratios are columns of that join."""
    x, changes = against_year_before(pl, _GROWING)
    return with_latest(facts_of(x, bs), price, keys, ttm).select("symbol", "fiscal_year", *valuation_columns(), *profitability_columns(), *leverage_columns(), *changes)


def default_year(pl: DataFrame, fallback: int = 2024) -> DataFrame:
    """Each symbol's latest fiscal year."""
    return pl.groupBy("symbol").agg(F.coalesce(F.max("fiscal_year"), F.lit(fallback)).alias("fiscal_year"))


def snapshot(pl: DataFrame, metric: str, years: int = 3, since: int = 2018) -> DataFrame:
    """Each symbol's latest year and the trend of a metric over up to `years` years, not before `since`."""
    latest = pl.groupBy("symbol").agg(F.max("fiscal_year").alias("latest"))
    trend = pl.join(latest, "symbol").where(F.col("fiscal_year").between(F.greatest(F.col("latest") - (years - 1), F.lit(since)), F.col("latest")))
    shown: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", F.round(metric, 0).cast("bigint").alias("m")))), lambda x: F.concat_ws(":", x["fiscal_year"], x["m"])), " ")
    return trend.groupBy("symbol", "latest").agg(shown.alias("trend"))


def of_years(ratios: DataFrame, years: tuple[int, ...] | list[int]) -> DataFrame:
    """The ratios of several fiscal years."""
    return ratios.where(F.col("fiscal_year").isin(*years))


def derived(facts: DataFrame, span: int = 3, metric: str = "revenue") -> DataFrame:
    """fcf (cash from operations less capex), ebitda_proxy (operating profit and depreciation) and the metric's compound growth over `span` years.

    facts: symbol, fiscal_year, cfo, capex, operating_profit, depreciation and the metric. A missing
    figure or first year gives NULL. One shuffle by symbol: the earlier year is sought among the rows of
    a window that can hold it.
    """
    w = Window.partitionBy("symbol").orderBy("fiscal_year").rangeBetween(-span, -span)
    before = F.first(metric).over(w)
    x = facts.withColumn("_before", before)
    return x.select("symbol", "fiscal_year", F.round(F.col("cfo") - F.col("capex"), 2).alias("fcf"), F.round(F.col("operating_profit") + F.col("depreciation"), 2).alias("ebitda_proxy"), cagr(F.col("_before"), F.col(metric), F.lit(span)).alias(f"{metric}_cagr_pct"))
