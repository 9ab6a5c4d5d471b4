"""Queries of the ratio engine (R01-R19, J01, J02, J15, W01, W02, A01-A03) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ratios as r
from ledgerloom.session import stored
from ledgerloom.sources import adapters as a


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """What all statements are rolled up from: small, and read several times."""
    return stored(a.sales_by_quarter(spark, d))


def _statements(q: DataFrame) -> tuple[DataFrame, ...]:
    """Profit and loss, balance sheet, latest price, latest key ratios, trailing earnings."""
    ttm = r.trailing_sum(a.profit_loss_of(q, quarterly=True), "eps").select("symbol", "ttm_eps")
    return a.profit_loss_of(q), a.balance_sheet_of(q), *a.latest_of(q), ttm


def fy_revenue_yoy(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of each company and fiscal year with its growth."""
    x, changes = r.against_year_before(a.profit_loss(spark, d), ("revenue",))
    return x.select("symbol", "fiscal_year", F.round("revenue", 2).alias("revenue"), *changes)


def latest_row_per_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Latest price of each company."""
    return r.latest_by(a.prices(spark, d), "symbol", ["date"], ["date", "close"])


def price_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier shipment with the last price at or before it."""
    ships = a.sales_lines(spark, d).select("symbol", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"))
    return r.as_of(ships, a.prices(spark, d), "symbol", "shipped", "date", ["close"], bucket=lambda t: F.trunc(t, "month"))


def ttm_last4_sum(spark: SparkSession, d: str) -> DataFrame:
    """Trailing sum of the last four quarters' earnings per share."""
    return r.trailing_sum(a.profit_loss(spark, d, quarterly=True), "eps")


def valuation_ratios(spark: SparkSession, d: str) -> DataFrame:
    return r.valuation(*_statements(_quarters(spark, d)))


def profitability_ratios(spark: SparkSession, d: str) -> DataFrame:
    return r.profitability(*_statements(_quarters(spark, d))[:2])


def leverage_ratios(spark: SparkSession, d: str) -> DataFrame:
    return r.leverage(*_statements(_quarters(spark, d))[:2])


def growth_ratios(spark: SparkSession, d: str) -> DataFrame:
    return r.growth(a.profit_loss(spark, d))


def all_ratios(spark: SparkSession, d: str) -> DataFrame:
    return r.all_ratios(*_statements(_quarters(spark, d)))


def default_year(spark: SparkSession, d: str) -> DataFrame:
    return r.default_year(a.profit_loss(spark, d))


def ratio_snapshot_trend(spark: SparkSession, d: str) -> DataFrame:
    return r.snapshot(a.profit_loss(spark, d), "revenue", since=1990)


def available_years(spark: SparkSession, d: str) -> DataFrame:
    """Distinct fiscal years, newest first, with their rank."""
    years = a.sales_lines(spark, d).select(a.fiscal_year("o_orderdate").alias("fiscal_year")).distinct()
    return years.orderBy(F.desc("fiscal_year"))


def ratios_of_years(spark: SparkSession, d: str) -> DataFrame:
    """Every company's margins in the years 1995 and 1997."""
    return r.of_years(profitability_ratios(spark, d), (1995, 1997)).select("symbol", "fiscal_year", "revenue_cr", "pat_margin_pct")


def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Free cash flow, the ebitda proxy and compound growth over two years."""
    return r.derived(a.profit_loss(spark, d).withColumn("cfo", F.col("ebitda")).withColumn("capex", F.col("interest")).withColumn("operating_profit", F.col("ebit")), span=2)


_DEFS = (ratios_of_years, derived_metrics, fy_revenue_yoy, latest_row_per_symbol, price_as_of, ttm_last4_sum, valuation_ratios, profitability_ratios, leverage_ratios, growth_ratios, all_ratios, default_year, ratio_snapshot_trend, available_years)
QUERIES = {f.__name__: f for f in _DEFS}

_LATEST_SQL = """lp AS (SELECT symbol, arg_max(close, date) AS close, arg_max(market_cap, date) AS market_cap FROM prices GROUP BY symbol),
lk AS (SELECT symbol, forward_eps FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY updated_at DESC, ordinal DESC) AS rn FROM key_ratios) WHERE rn = 1),
lt AS (SELECT symbol, round(sum(eps), 2) AS ttm_eps, count(*) AS quarters FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC, quarter DESC) AS rn FROM plq) WHERE rn <= 4 GROUP BY symbol)"""
_POS = lambda c: f"(CASE WHEN {c} > 0 THEN {c} END)"
_PCT = lambda n, q: f"round(round(nullif({n}, 0) / {q}, 2) * 100, 2)"
_EV = "(market_cap + total_debt - cash)"
_VALUATION = f"""val AS (SELECT pl.symbol, pl.fiscal_year, round(close, 2) AS price, round(market_cap, 2) AS market_cap_cr,
  coalesce(round(nullif(close, 0) / {_POS('ttm_eps')}, 2), round(nullif(close, 0) / {_POS('eps')}, 2)) AS pe, round(nullif(close, 0) / {_POS('forward_eps')}, 2) AS forward_pe, round(nullif(close, 0) / {_POS('book_value')}, 2) AS pb,
  round(nullif(market_cap, 0) / {_POS('revenue')}, 2) AS ps, round({_EV}, 2) AS enterprise_value_cr, round({_EV} / {_POS('ebitda')}, 2) AS ev_ebitda, round({_EV} / {_POS('revenue')}, 2) AS ev_sales
  FROM pl LEFT JOIN bs USING (symbol, fiscal_year) LEFT JOIN lp USING (symbol) LEFT JOIN lk USING (symbol) LEFT JOIN lt USING (symbol))"""
_PROFIT = f"""prof AS (SELECT symbol, fiscal_year, round(nullif(revenue, 0), 2) AS revenue_cr, round(nullif(ebitda, 0), 2) AS ebitda_cr, round(nullif(pat, 0), 2) AS pat_cr, {_PCT('ebitda', _POS('revenue'))} AS ebitda_margin_pct,
  {_PCT('pat', _POS('revenue'))} AS pat_margin_pct, {_PCT('pat', _POS('equity'))} AS roe_pct, {_PCT('ebit', _POS('(equity + total_debt)'))} AS roce_pct, round(nullif(revenue, 0) / {_POS('total_assets')}, 2) AS asset_turnover
  FROM pl LEFT JOIN bs USING (symbol, fiscal_year))"""
_LEVERAGE = f"""lev AS (SELECT symbol, fiscal_year, round(nullif(total_debt, 0) / {_POS('equity')}, 2) AS debt_equity, round(total_debt - cash, 2) AS net_debt_cr, round((total_debt - cash) / {_POS('ebitda')}, 2) AS net_debt_ebitda,
  round(nullif(ebit, 0) / {_POS('interest')}, 2) AS interest_coverage FROM pl LEFT JOIN bs USING (symbol, fiscal_year))"""
_YOY = lambda m: f"round((a.{m} - b.{m}) / abs(nullif(b.{m}, 0)) * 100, 2) AS {m}_yoy_pct"
_GROWTH = f"gr AS (SELECT a.symbol, a.fiscal_year, {', '.join(_YOY(m) for m in ('revenue', 'pat', 'ebitda', 'eps'))} FROM pl a LEFT JOIN pl b ON a.symbol = b.symbol AND a.fiscal_year = b.fiscal_year + 1)"
_BASE = f"WITH {a.SALES_SQL}, {a.PL_SQL}, {a.BS_SQL}"
_FULL = f"{_BASE}, {a.PLQ_SQL}, {a.PRICES_SQL}, {a.KEYS_SQL}, {_LATEST_SQL}, {_VALUATION}, {_PROFIT}, {_LEVERAGE}, {_GROWTH}"

ORACLE = {
    "ratios_of_years": f"{_BASE}, {_PROFIT} SELECT symbol, fiscal_year, revenue_cr, pat_margin_pct FROM prof WHERE fiscal_year IN (1995, 1997)",
    "derived_metrics": f"""{_BASE} SELECT p.symbol, p.fiscal_year, round(p.ebitda - p.interest, 2) AS fcf, round(p.ebit + p.depreciation, 2) AS ebitda_proxy,
      CASE WHEN b.revenue > 0 AND p.revenue > 0 THEN round((pow(p.revenue / b.revenue, 0.5::DOUBLE) - 1) * 100, 2) END AS revenue_cagr_pct FROM pl p LEFT JOIN pl b ON p.symbol = b.symbol AND b.fiscal_year = p.fiscal_year - 2""",
    "fy_revenue_yoy": f"{_BASE}, {_GROWTH} SELECT symbol, fiscal_year, round(pl.revenue, 2) AS revenue, revenue_yoy_pct FROM pl JOIN gr USING (symbol, fiscal_year)",
    "latest_row_per_symbol": f"WITH {a.SALES_SQL}, {a.PRICES_SQL} SELECT symbol, max(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY symbol",
    "price_as_of": f"""WITH {a.SALES_SQL}, {a.PRICES_SQL}, ships AS (SELECT symbol, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped FROM sales)
      SELECT s.symbol, l_orderkey, l_linenumber, shipped, p.close FROM ships s ASOF LEFT JOIN prices p ON s.symbol = p.symbol AND s.shipped >= p.date""",
    "ttm_last4_sum": f"WITH {a.SALES_SQL}, {a.PLQ_SQL} SELECT symbol, round(sum(eps), 2) AS ttm_eps, count(*) AS quarters FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC, quarter DESC) AS rn FROM plq) WHERE rn <= 4 GROUP BY symbol",
    "valuation_ratios": f"{_FULL} SELECT * FROM val", "profitability_ratios": f"{_BASE}, {_PROFIT} SELECT * FROM prof", "leverage_ratios": f"{_BASE}, {_LEVERAGE} SELECT * FROM lev", "growth_ratios": f"{_BASE}, {_GROWTH} SELECT * FROM gr",
    "all_ratios": f"{_FULL} SELECT * FROM val JOIN prof USING (symbol, fiscal_year) JOIN lev USING (symbol, fiscal_year) JOIN gr USING (symbol, fiscal_year)",
    "default_year": f"WITH {a.SALES_SQL} SELECT symbol, max(fiscal_year) AS fiscal_year FROM sales GROUP BY symbol",
    "ratio_snapshot_trend": f"""{_BASE}, l AS (SELECT symbol, max(fiscal_year) AS latest FROM pl GROUP BY symbol)
      SELECT symbol, latest, string_agg(fiscal_year || ':' || CAST(round(revenue, 0) AS BIGINT), ' ' ORDER BY fiscal_year) AS trend FROM pl JOIN l USING (symbol) WHERE fiscal_year BETWEEN greatest(latest - 2, 1990) AND latest GROUP BY symbol, latest""",
    "available_years": f"WITH {a.SALES_SQL} SELECT DISTINCT fiscal_year FROM sales",
}
