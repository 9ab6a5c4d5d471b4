"""Stand-ins for the financial warehouse, derived from the driver's star schema.

They are semantic proxies: a supplier stands for a company, its shipped lines for business done.
Addends are cast to decimals before they are summed, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.fiscal import fiscal_quarter, fiscal_year
from ledgerloom.sources.tables import table

_D = "decimal(18,4)"


def _cents(total: Column) -> Column:
    """A sum of decimals cut to two places, as a double: no later rounding meets a tie."""
    return F.floor(total * 100).cast("double") / 100


def sales_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its order's date and its supplier's name. orders and lineitem share the order key; supplier is a dimension."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus", "o_totalprice")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("symbol"), "s_acctbal")
    return l.join(o, "l_orderkey").join(s, "l_suppkey")


def sales_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Sums of each company's fiscal quarter, its last price and its last line: one scan and one shuffle, from which all statements are rolled up.

    Sums are decimals, so they may be summed again. last_price packs the day and the highest price of it
    in hundredths into one number, last_line the day and the line, so that both are plain maxima.
    """
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    line = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    order = F.unix_date(F.col("l_shipdate").cast("date")) * F.lit(10**13) + line
    return sales_lines(spark, d).groupBy("symbol", fiscal_year("o_orderdate").alias("fiscal_year"), fiscal_quarter("o_orderdate").alias("quarter")).agg(
        F.sum(net.cast(_D)).alias("net"), F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast(_D)).alias("rebate"), F.sum((net * F.col("l_tax")).cast(_D)).alias("taxed"), F.sum(F.col("l_quantity").cast(_D)).alias("quantity"),
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0).cast(_D)).alias("open"), F.sum((F.col("l_quantity") * 10).cast(_D)).alias("tenfold"), F.sum(F.col("l_extendedprice").cast(_D)).alias("gross"), F.max("s_acctbal").alias("acctbal"),
        F.max(F.unix_date(F.col("o_orderdate").cast("date")) * F.lit(10**11) + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("last_price"), F.max(order).alias("last_line"), F.max_by(F.col("l_extendedprice") / 1000, order).alias("last_eps"),
    )


def profit_loss_of(quarters: DataFrame, quarterly: bool = False) -> DataFrame:
    """symbol, fiscal_year (, quarter) and a year's or quarter's revenue, ebitda, depreciation, ebit, interest, pbt, tax, pat, eps."""
    keys = ["symbol", "fiscal_year", *(["quarter"] if quarterly else [])]
    sums = quarters.groupBy(*keys).agg(_cents(F.sum("net")).alias("revenue"), _cents(F.sum("rebate")).alias("depreciation"), _cents(F.sum("taxed")).alias("tax"), _cents(F.sum("quantity")).alias("interest"))
    with_ebitda = sums.withColumn("ebitda", F.col("revenue") - F.col("interest") * 500).withColumn("ebit", F.col("ebitda") - F.col("depreciation")).withColumn("pbt", F.col("ebit") - F.col("interest")).withColumn("pat", F.col("pbt") - F.col("tax"))
    return with_ebitda.withColumn("eps", F.col("pat") / 10000)


def profit_loss(spark: SparkSession, d: str, quarterly: bool = False) -> DataFrame:
    return profit_loss_of(sales_by_quarter(spark, d), quarterly)


def balance_sheet_of(quarters: DataFrame) -> DataFrame:
    """symbol, fiscal_year, total_debt, cash, equity, total_assets, book_value."""
    sums = quarters.groupBy("symbol", "fiscal_year").agg(_cents(F.sum("open")).alias("total_debt"), _cents(F.sum("tenfold")).alias("cash"), F.max("acctbal").alias("acctbal"), _cents(F.sum("gross")).alias("gross"))
    return sums.withColumn("equity", F.col("acctbal") + F.col("gross") / 2).withColumn("total_assets", F.col("equity") + F.col("total_debt")).withColumn("book_value", F.col("equity") / 1000).select("symbol", "fiscal_year", "total_debt", "cash", "equity", "total_assets", "book_value")


def latest_of(quarters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, close, market_cap: the last price), (symbol, forward_eps: of the last line)."""
    price = quarters.groupBy("symbol").agg((F.pmod(F.max("last_price"), F.lit(10**11)) / 100 / 100).alias("close")).withColumn("market_cap", F.col("close") * 1000)
    return price, quarters.groupBy("symbol").agg(F.max_by("last_eps", "last_line").alias("forward_eps"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    """symbol, date, close, market_cap: the highest line price of a day."""
    return sales_lines(spark, d).groupBy("symbol", F.col("o_orderdate").cast("date").alias("date")).agg((F.max("l_extendedprice") / 100).alias("close")).withColumn("market_cap", F.col("close") * 1000)


# The same tables for the oracle.
SALES_SQL = """sales AS (SELECT l.*, o.o_orderdate, o.o_orderstatus, o.o_totalprice, s.s_name AS symbol, s.s_acctbal,
  CAST(year(o.o_orderdate + INTERVAL 9 MONTH) AS INTEGER) AS fiscal_year, CAST(quarter(o.o_orderdate + INTERVAL 9 MONTH) AS INTEGER) AS quarter
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


def _pl_sql(name: str, keys: str) -> str:
    return f"""{name} AS (SELECT *, pat / 10000 AS eps FROM (SELECT *, pbt - tax AS pat FROM (SELECT *, ebit - interest AS pbt FROM (SELECT *, ebitda - depreciation AS ebit FROM (SELECT *, revenue - interest * 500 AS ebitda FROM (
      SELECT {keys}, CAST(floor(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) * 100) AS DOUBLE) / 100 AS revenue, CAST(floor(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) * 100) AS DOUBLE) / 100 AS depreciation,
        CAST(floor(sum(CAST(l_extendedprice * (1 - l_discount) * l_tax AS DECIMAL(18,4))) * 100) AS DOUBLE) / 100 AS tax, CAST(floor(sum(CAST(l_quantity AS DECIMAL(18,4))) * 100) AS DOUBLE) / 100 AS interest FROM sales GROUP BY {keys}))))))"""


PL_SQL = _pl_sql("pl", "symbol, fiscal_year")
PLQ_SQL = _pl_sql("plq", "symbol, fiscal_year, quarter")
BS_SQL = """bs AS (SELECT symbol, fiscal_year, total_debt, cash, equity, equity + total_debt AS total_assets, equity / 1000 AS book_value FROM (SELECT *, acctbal + gross / 2 AS equity FROM (
  SELECT symbol, fiscal_year, CAST(floor(sum(CAST(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS DECIMAL(18,4))) * 100) AS DOUBLE) / 100 AS total_debt, CAST(floor(sum(CAST(l_quantity * 10 AS DECIMAL(18,4))) * 100) AS DOUBLE) / 100 AS cash,
    max(s_acctbal) AS acctbal, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,4))) * 100) AS DOUBLE) / 100 AS gross FROM sales GROUP BY symbol, fiscal_year)))"""
PRICES_SQL = "prices AS (SELECT symbol, CAST(o_orderdate AS DATE) AS date, max(l_extendedprice) / 100 AS close, max(l_extendedprice) / 100 * 1000 AS market_cap FROM sales GROUP BY ALL)"
KEYS_SQL = "key_ratios AS (SELECT symbol, l_extendedprice / 1000 AS forward_eps, l_shipdate AS updated_at, l_orderkey * 100 + l_linenumber AS ordinal FROM sales)"
