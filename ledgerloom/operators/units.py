"""Problem 1: one quantity in many units, brought to the common unit of its kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import unitgrammar as g

_OUT = T.StructType([T.StructField("factor", T.DoubleType()), T.StructField("currency", T.StringType())])


@F.pandas_udf(_OUT)
def _of_fields(unit: pd.Series, label: pd.Series, notes: pd.Series, common: pd.Series) -> pd.DataFrame:
    out = []
    for u, m, n, c in zip(unit, label, notes, common):
        if c not in g.COMMON:
            out.append((None, None))
            continue
        d = g.COMMON[c][0]
        out.append(g.factor([g.read_unit(u, d), g.read_label(m, d), *(g.read_unit(x, d) for x in (n if n is not None else ()))], c))
    return pd.DataFrame(out, columns=["factor", "currency"])


@F.pandas_udf(_OUT)
def _of_sentence(unit: pd.Series, label: pd.Series, sentence: pd.Series, figure: pd.Series, common: pd.Series) -> pd.DataFrame:
    out = []
    for u, m, s, v, c in zip(unit, label, sentence, figure, common):
        if c not in g.COMMON:
            out.append((None, None))
            continue
        d = g.COMMON[c][0]
        out.append(g.factor([g.read_unit(u, d), g.read_figure(s, v, d), g.read_label(m, d)], c))
    return pd.DataFrame(out, columns=["factor", "currency"])


def _kind(c: str | Column) -> Column:
    return F.lower(F.trim(c))


def _notes() -> Column:
    """The entries of raw_row that may name a unit: all but the figure itself and plain numbers."""
    entries = F.filter(
        F.map_entries("raw_row"),
        lambda e: e["value"].isNotNull() & ~e["key"].eqNullSafe(F.col("value_col")) & ~e["value"].rlike(r"^[\s\d.,+-]*$"),
    )
    return F.transform(F.array_sort(entries), lambda e: e["value"])


def named_units(metric_rows: DataFrame, claims: DataFrame, metric_units: DataFrame) -> DataFrame:
    """Every record with a figure and the unit it names.

    Columns: source_table, record_id, sub_type, year, value, common_unit, factor, currency. `factor`
    turns the value into the common unit before exchange rates and is NULL where the record names no
    unit anywhere or its sub_type has no common unit.

    Repeated rows (same id) count once; NULL figures, ids and unknown sub_types give no row, NULL or
    empty unit fields say nothing; extra columns are ignored; empty inputs give an empty result.
    Unit strings, labels, notes and sentences are read whole, however long they are.

    The tables are only scanned and joined with the unit table, which is small enough for Spark's own
    size check to broadcast; the segmentation runs in Arrow batches with a cache per worker, so the
    trie is walked once per distinct string and batch.
    """
    units = metric_units.select(_kind("sub_type").alias("sub_type"), _kind("common_unit").alias("common_unit")).where(
        F.col("sub_type").isNotNull()
    ).groupBy("sub_type").agg(F.min("common_unit").alias("common_unit"))
    rows = (
        metric_rows.select("row_id", _kind("sub_type").alias("sub_type"), "metric", "year", "period", F.col("value").cast("double").alias("value"), "value_col", "unit", "raw_row")
        .where(F.col("row_id").isNotNull() & F.col("value").isNotNull())
        .select("row_id", "sub_type", "metric", F.coalesce("year", F.year(F.add_months(F.try_to_timestamp("period").cast("date"), 9))).alias("year"), "value", "unit", _notes().alias("notes"))
        .dropDuplicates(["row_id"])
        .join(units, "sub_type")
        .withColumn("u", _of_fields("unit", "metric", "notes", "common_unit"))
    )
    said = (
        claims.select("claim_id", _kind("sub_type").alias("sub_type"), "metric", "year", F.col("value_low").cast("double").alias("value"), "unit", "source_text")
        .where(F.col("claim_id").isNotNull() & F.col("value").isNotNull())
        .dropDuplicates(["claim_id"])
        .withColumn("year", F.coalesce("year", (F.try_element_at(F.regexp_extract_all("source_text", F.lit(r"\bFY\s?(?:20)?(\d{2})\b"), 1), F.lit(-1)).try_cast("int") + 2000)))
        .join(units, "sub_type")
        .withColumn("u", _of_sentence("unit", "metric", "source_text", "value", "common_unit"))
    )
    shape = lambda df, name, key: df.select(
        F.lit(name).alias("source_table"), F.col(key).cast("bigint").alias("record_id"), "sub_type", "year", "value", "common_unit", "u.factor", "u.currency"
    )
    return shape(rows, "metric_rows", "row_id").unionByName(shape(said, "concall_claims", "claim_id"))


def in_other_units(named: DataFrame) -> DataFrame:
    """Of `named_units`, the records whose unit or scale isn't the common one."""
    other = (F.abs(F.col("factor") - 1) > 1e-12) | (F.col("currency") != "INR")
    return named.where(F.col("factor").isNotNull() & other).select("source_table", "record_id")


def to_common_units(named: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """Every figure in its common unit: named_units plus common_value and unit_known.

    A figure that names no unit is taken to be in the common one (unit_known false). A foreign
    currency without a rate for the year gives NULL.
    """
    fx = fx_rates.select(F.upper(F.trim("currency")).alias("fx_currency"), F.col("year").alias("fx_year"), "inr_per_unit").groupBy("fx_currency", "fx_year").agg(F.max("inr_per_unit").alias("rate"))
    value = F.when(F.col("factor").isNull(), F.col("value")).when(F.col("currency").isNull() | (F.col("currency") == "INR"), F.col("value") * F.col("factor")).otherwise(F.col("value") * F.col("factor") * F.col("rate"))
    return (
        named.join(fx, (F.col("currency") == F.col("fx_currency")) & (F.col("year") == F.col("fx_year")), "left")
        .select("source_table", "record_id", "sub_type", "year", "value", "common_unit", F.col("factor").isNotNull().alias("unit_known"), value.alias("common_value"))
    )
