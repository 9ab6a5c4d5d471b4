from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs, fiscal
from ledgerloom.operators import ratios as r


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_fiscal_calendar(spark):
    d = lambda s: fiscal.fiscal_year_of_text(F.lit(s))
    assert one(spark, *(d(s) for s in ("2024-03-31", "2023-09-30", "2023-12-31", "2023-06-30", "2022-03-31", "", "x"))) == (2024, 2024, 2024, 2024, 2022, None, None)
    assert one(spark, fiscal.fiscal_start(F.lit(2024)), fiscal.fiscal_end(F.lit(2024))) == (date(2023, 4, 1), date(2024, 3, 31))
    assert one(spark, *(fiscal.year_of_title(F.lit(s)) for s in ("Q3 FY24 call", "Annual Report FY2023", "Report 2022-23", "Report 2021", "None"))) == (2024, 2023, 2023, 2021, None)


def test_arithmetic(spark):
    lit = F.lit
    assert one(spark, exprs.safe_div(lit(1.0), lit(0.0)), exprs.pct(lit(1.0), lit(3.0)), exprs.pct(lit(1.0), lit(3.0), True), exprs.yoy(lit(90.0), lit(-100.0)), exprs.divergence(lit(100.0), lit(110.0)), exprs.divergence(lit(0.0), lit(10.0))) == (None, 33.0, 33.33, 190.0, pytest.approx(0.1), 0.0)
    assert one(spark, exprs.shown(lit(23452.0), lit("crore")), exprs.shown(lit(54.7), lit("%")), exprs.shown(lit(None).cast("double"), lit("x"))) == ("₹23,452.0 cr", "54.70%", "n/a") and one(spark, exprs.cagr(lit(100.0), lit(121.0), lit(2)))[0] == 10.0


def test_growth_leaves_gaps_null(spark):
    pl = spark.createDataFrame([("A", 2020, 10.0), ("A", 2022, 20.0), ("A", 2023, 30.0), ("B", 2020, 0.0), ("B", 2021, 5.0)], "symbol string, fiscal_year int, revenue double")
    got = {(x.symbol, x.fiscal_year): x.revenue_yoy_pct for x in r.growth(pl, ("revenue",)).collect()}
    assert got == {("A", 2020): None, ("A", 2022): None, ("A", 2023): 50.0, ("B", 2020): None, ("B", 2021): None}


def test_trailing_and_as_of(spark):
    q = spark.createDataFrame([("A", 2023, k, float(k)) for k in (1, 2, 3, 4)] + [("A", 2022, 4, 100.0), ("B", 2023, 1, None)], "symbol string, fiscal_year int, quarter int, eps double")
    assert {tuple(x) for x in r.trailing_sum(q, "eps").collect()} == {("A", 10.0, 4), ("B", None, 1)}
    left = spark.createDataFrame([("A", 5), ("A", 1), ("B", 3), ("A", 9)], "k string, t int")
    right = spark.createDataFrame([("A", 2, 7.0), ("A", 5, 8.0), ("B", 4, 9.0)], "k string, u int, v double")
    for bucket in (None, lambda t: F.floor(t / 3)):
        assert {tuple(x) for x in r.as_of(left, right, "k", "t", "u", ["v"], bucket).collect()} == {("A", 5, 8.0), ("A", 1, None), ("B", 3, None), ("A", 9, 8.0)}


def test_ratio_guards(spark):
    pl = spark.createDataFrame([("A", 2024, 100.0, 0.0, 5.0, 10.0, 0.0, 4.0, -1.0)], "symbol string, fiscal_year int, revenue double, ebitda double, depreciation double, ebit double, interest double, pat double, eps double")
    bs = spark.createDataFrame([("A", 2024, 0.0, 5.0, -3.0, 50.0, 2.0)], "symbol string, fiscal_year int, total_debt double, cash double, equity double, total_assets double, book_value double")
    p, lv = r.profitability(pl, bs).first(), r.leverage(pl, bs).first()
    assert (p.ebitda_cr, p.roe_pct, p.roce_pct, p.asset_turnover, p.pat_margin_pct) == (None, None, None, 2.0, 4.0)
    assert (lv.debt_equity, lv.net_debt_cr, lv.net_debt_ebitda, lv.interest_coverage) == (None, -5.0, None, None)


def test_every_shipment_has_its_price(spark, small):
    """Against all pairs of a shipment and an earlier price."""
    import duckdb

    from ledgerloom.plans import finance
    from ledgerloom.sources import adapters as a

    c = duckdb.connect()
    for name in ("lineitem", "orders", "supplier"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    pairs = f"""WITH {a.SALES_SQL}, {a.PRICES_SQL}, ships AS (SELECT symbol, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped FROM sales)
      SELECT s.symbol, l_orderkey, l_linenumber, shipped, arg_max(p.close, p.date) AS close FROM ships s LEFT JOIN prices p ON s.symbol = p.symbol AND p.date <= s.shipped GROUP BY ALL"""
    expected = c.sql(pairs).fetchall()
    got = [tuple(x) for x in finance.price_as_of(spark, small).select("symbol", "l_orderkey", "l_linenumber", "shipped", "close").collect()]
    assert len(got) == c.sql("SELECT count(*) FROM lineitem").fetchall()[0][0] and sorted(got, key=repr) == sorted(expected, key=repr)
