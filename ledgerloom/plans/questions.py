"""Queries of question understanding (Q01, Q06, Q07) over a fixed set of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import understand as u
from ledgerloom.sources.tables import table


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per claim: its kind, company and year in words."""
    c = table(spark, d, "concall_claims").dropDuplicates(["claim_id"]).where("year is not null and symbol is not null")
    year = F.col("year").cast("string")
    return c.select(F.col("claim_id").alias("query_id"), F.concat(F.lit("What was the "), F.replace("sub_type", F.lit("_"), F.lit(" ")), F.lit(" of "), "symbol", F.lit(" in FY"), F.substring(year, 3, 2), F.lit(" to FY"), F.substring((F.col("year") + 2).cast("string"), 3, 2), F.lit("?")).alias("query"))


def year_intents(spark: SparkSession, d: str) -> DataFrame:
    """Fiscal years of every question."""
    return _questions(spark, d).select("query_id", F.array_join(F.transform(u.year_intents("query")["resolved"], lambda x: x.cast("string")), ",").alias("years"))


#: One form of naming years each, with what they come to for a year y (oracle's side of year_forms).
_FORMS = (
    ("last 4 years of growth", "2022,2023,2024,2025"), ("past 2 years", "2024,2025"), ("previous three years", "2023,2024,2025"), ("recent 1 years", "2025"), ("FY{yy} to FY{yy2}", "{y},{y1},{y2}"), ("FY-{yy}/{yy2}", "{y},{y1},{y2}"), ("fy {y} through {y2}", "{y},{y1},{y2}"),
    ("{y}-{y2} trend", "{y},{y1},{y2}"), ("{y2} to {y}", "{y},{y1},{y2}"), ("FY{yy} and FY{yy2}", "{y},{y2}"), ("margin in FY{yy}", "{y}"), ("financial year {y}", "{y}"), ("the year {y} and {y2}", "{y}"), ("between {y2} and {y}", "{y},{y2}"), ("how is it", "2023,2024,2025"),
)


def year_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form of naming years, for the year of every claim."""
    c = table(spark, d, "concall_claims").where("year between 2010 and 2022").select("year").distinct()
    year = F.col("year").cast("string")
    two = lambda x: F.substring(x.cast("string"), 3, 2)
    texts = F.array(*(F.struct(F.lit(i).alias("form"), F.lit(text).alias("query")) for i, (text, _) in enumerate(_FORMS)))
    x = c.select("year", F.explode(texts).alias("q")).select("year", "q.*")
    for name, value in (("{yy2}", two(F.col("year") + 2)), ("{yy}", two(F.col("year"))), ("{y2}", (F.col("year") + 2).cast("string")), ("{y}", year)):
        x = x.withColumn("query", F.replace("query", F.lit(name), value))
    found = u.year_intents("query")
    return x.select("year", "form", F.array_join(F.transform(found["resolved"], lambda v: v.cast("string")), ",").alias("years"), (F.size(found["explicit"]) > 0).alias("named"))


def need_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many needs of each type the questions have."""
    return u.need_histogram(_questions(spark, d))


def unfenced_json(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events as a model would fence them, without the fence."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("said"))
    return e.select("event_id", F.from_json(u.unfenced("said"), "k int")["k"].alias("k"))


def decomposed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Kinds every question asks for."""
    return u.decomposed(_questions(spark, d)).select("query_id", "sub_type")


_Q = """q AS (SELECT DISTINCT claim_id AS query_id, year, 'What was the ' || replace(sub_type, '_', ' ') || ' of ' || symbol || ' in FY' || substring(CAST(year AS VARCHAR), 3, 2) || ' to FY' || substring(CAST(year + 2 AS VARCHAR), 3, 2) || '?' AS query
  FROM concall_claims WHERE year IS NOT NULL AND symbol IS NOT NULL)"""
_RULES = ", ".join("('{}', '{}')".format(k, p.replace("'", "''")) for k, _, p in u.RULES if "(?!" not in p)
_LOOKAHEAD = [k for k, _, p in u.RULES if "(?!" in p]

_FORM_ROWS = ", ".join(f"({i}, '{want}', {'false' if i == len(_FORMS) - 1 else 'true'})" for i, (_, want) in enumerate(_FORMS))
_NEEDS = ", ".join(f"('{k}', '{need}')" for k, need, _ in u.RULES)

_DECOMPOSED = f"""WITH {_Q}, r AS (SELECT * FROM (VALUES {_RULES}) t(sub_type, pattern)) SELECT query_id, sub_type FROM q JOIN r ON regexp_matches(query, pattern, 'i')
      UNION ALL SELECT query_id, 'price' AS sub_type FROM q WHERE regexp_matches(query, 'share price|stock price', 'i') OR (regexp_matches(query, '\\bprice\\b', 'i') AND NOT regexp_matches(query, '\\bprice\\b to', 'i'))"""

QUERIES = {"year_intents": year_intents, "year_forms": year_forms, "need_histogram": need_histogram, "unfenced_json": unfenced_json, "decomposed_questions": decomposed_questions}
ORACLE = {
    "year_intents": f"WITH {_Q} SELECT query_id, year || ',' || (year + 1) || ',' || (year + 2) AS years FROM q",
    "year_forms": f"""WITH y AS (SELECT DISTINCT year FROM concall_claims WHERE year BETWEEN 2010 AND 2022), f AS (SELECT * FROM (VALUES {_FORM_ROWS}) t(form, want, named))
      SELECT year, form, replace(replace(replace(want, '{{y2}}', CAST(year + 2 AS VARCHAR)), '{{y1}}', CAST(year + 1 AS VARCHAR)), '{{y}}', CAST(year AS VARCHAR)) AS years, named FROM y CROSS JOIN f""",
    "unfenced_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "decomposed_questions": _DECOMPOSED,
    "need_histogram": f"WITH d AS ({_DECOMPOSED}), n AS (SELECT * FROM (VALUES {_NEEDS}) t(sub_type, need_type)) SELECT need_type, count(*) AS atoms, count(DISTINCT query_id) AS questions FROM d JOIN n USING (sub_type) GROUP BY ALL",
}
