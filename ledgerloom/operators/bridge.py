"""From typed needs ("atoms") to plans over warehouse tables, without SQL strings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.catalog import ACTIONS, KINDS, TABLES, TEXT_KINDS, kinds_frame


@dataclass(frozen=True)
class Atom:
    """One thing a question needs."""

    sub_type: str
    need_type: str = "quantitative"
    metric: str = ""
    symbol: str | None = None
    symbols: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    time_horizon: str = "current"
    period_type: str = "annual"
    raw_text: str = ""
    confidence: float = 1.0
    source: str = "rule"


@dataclass(frozen=True)
class Fetched:
    """An atom's rows, or why there are none."""

    atom: Atom
    rows: DataFrame | None = None
    error: str | None = None


def channel(atom: Atom) -> str:
    """'vector' for kinds that live in text and qualitative needs, 'both' for outlooks on figures, else 'sql'."""
    if atom.sub_type in TEXT_KINDS or atom.need_type == "qualitative":
        return "vector"
    if atom.need_type == "forward_looking":
        return "both" if atom.sub_type in KINDS else "vector"
    return "sql"


def channel_of(sub_type: str | Column, need_type: str | Column) -> Column:
    """`channel` of columns of kinds and need types."""
    kind, need = (F.col(c) if isinstance(c, str) else c for c in (sub_type, need_type))
    return F.when(kind.isin(*TEXT_KINDS) | (need == "qualitative"), "vector").when(need == "forward_looking", F.when(kind.isin(*KINDS), "both").otherwise("vector")).otherwise("sql")


def expand(atoms: list[Atom]) -> list[Atom]:
    """A comparison becomes one quantitative atom per company."""
    out: list[Atom] = []
    for a in atoms:
        if a.need_type == "comparative" and a.symbols:
            out += [replace(a, need_type="quantitative", symbol=s, symbols=()) for s in a.symbols]
        else:
            out.append(a)
    return out


def payload_filter(where: dict[str, Any] | None) -> Column:
    """A filter from {column: value | [values] | {"$in": [...]} | {"$gte": x, "$lte": y}}; keys are and-ed."""
    parts: list[Column] = [F.lit(True)]
    for name, want in (where or {}).items():
        c = F.col(name)
        if isinstance(want, dict):
            if "$in" in want:
                parts.append(c.isin(*want["$in"]))
            if "$gte" in want:
                parts.append(c >= want["$gte"])
            if "$lte" in want:
                parts.append(c <= want["$lte"])
        elif isinstance(want, (list, tuple, set)):
            parts.append(c.isin(*want))
        else:
            parts.append(c == want)
    return reduce(lambda a, b: a & b, parts)


def year_filter(symbol: str | None, years: list[int] | tuple[int, ...]) -> dict[str, Any]:
    """The retrieval filter of a company and years: one year by equality, several by list."""
    where: dict[str, Any] = {"symbol": symbol.upper()} if symbol else {}
    if years:
        where["year"] = years[0] if len(years) == 1 else list(years)
    return where


def build(atom: Atom, source: DataFrame) -> DataFrame:
    """An atom's plan over its table: whitelisted columns, company, period type, hull of the fiscal years, newest first.

    Without years the newest 5 rows are kept for current needs and 10 for others. Raises KeyError for
    kinds the warehouse doesn't hold. Filters are plain column predicates, so they reach the scan.
    """
    kind = KINDS[atom.sub_type]
    shape = TABLES[kind.table]
    columns = [*(["symbol"] if shape.symbol else []), shape.date, *(["period_type"] if shape.period_type else []), *dict.fromkeys(kind.columns)]
    df = source
    who = atom.symbol or (atom.symbols[0] if atom.symbols else None)
    if who and shape.symbol:
        df = df.where(F.col("symbol") == who.upper())
    if shape.period_type:
        df = df.where(F.col("period_type") == ("quarterly" if atom.period_type == "quarterly" else "annual"))
    if atom.years:
        df = df.where(F.col(shape.date).between(F.make_date(F.lit(min(atom.years) - 1), F.lit(4), F.lit(1)), F.make_date(F.lit(max(atom.years)), F.lit(3), F.lit(31))))
    if kind.table == "corporate_actions" and atom.sub_type in ACTIONS:
        df = df.where(F.col("action_type") == ACTIONS[atom.sub_type])
    if kind.table == "macro_indicators" and 0 < len(atom.raw_text) < 30:
        df = df.where(F.lower("indicator_name").contains(atom.raw_text.lower()))
    df = df.select(*columns).orderBy(F.desc(shape.date), *(["symbol"] if shape.symbol else []))
    return df if atom.years else df.limit(5 if atom.time_horizon == "current" else 10)


def fetch(atoms: list[Atom], tables: dict[str, DataFrame]) -> list[Fetched]:
    """The plan of every atom that reads the warehouse; errors become results and never stop the others."""
    out = []
    for a in expand(atoms):
        if channel(a) == "vector":
            continue
        try:
            out.append(Fetched(a, build(a, tables[KINDS[a.sub_type].table])))
        except Exception as problem:  # noqa: BLE001 - any failure belongs to its atom
            out.append(Fetched(a, error=str(problem)))
    return out


def atoms_frame(spark, atoms: list[Atom]) -> DataFrame:
    """Atoms as a table, for many questions at once."""
    rows = [(i, a.sub_type, a.need_type, a.symbol, list(a.symbols), list(a.years), a.time_horizon) for i, a in enumerate(atoms)]
    return spark.createDataFrame(rows, "atom_id int, sub_type string, need_type string, symbol string, symbols array<string>, years array<int>, time_horizon string")


def expand_frame(atoms: DataFrame) -> DataFrame:
    """Comparative atoms exploded to one row per company; others stay."""
    many = F.when((F.col("need_type") == "comparative") & (F.size("symbols") > 0), F.col("symbols")).otherwise(F.array("symbol"))
    return atoms.withColumn("symbol", F.explode(many)).withColumn("need_type", F.when(F.col("need_type") == "comparative", "quantitative").otherwise(F.col("need_type"))).drop("symbols")


def with_schema(atoms: DataFrame) -> DataFrame:
    """Atoms with their kind's table, columns, value column, unit and date column; "" for kinds the warehouse doesn't hold."""
    known = atoms.join(F.broadcast(kinds_frame(atoms.sparkSession)), "sub_type", "left")
    return known.withColumns({c: F.coalesce(c, F.lit("")) for c in ("table", "value_col", "unit", "date_col")}).withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))


def distinct_atoms(first: DataFrame, then: DataFrame, keys: tuple[str, ...] = ("query_id", "sub_type")) -> DataFrame:
    """Both united, each key once: an atom of the rules before one of the model, earlier ones before later ones. Columns: keys, ord and what else both have."""
    both = first.withColumn("_from", F.lit(0)).unionByName(then.withColumn("_from", F.lit(1)))
    rest = [c for c in first.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_from", "ord")).alias("a")).select(*keys, "a.*")


def rows_of_atoms(atoms: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of many atoms in one plan: each atom's hull of fiscal years is exploded, so the range join is an equi-join on company and year."""
    hull = atoms.withColumn("fiscal_year", F.explode(F.sequence(F.array_min("years"), F.array_max("years")))).select("atom_id", "symbol", "fiscal_year")
    return hull.join(facts, ["symbol", "fiscal_year"])


def newest_of_atoms(atoms: DataFrame, facts: DataFrame) -> DataFrame:
    """Each atom's newest facts: 5 for current needs, 10 for others."""
    w = Window.partitionBy("atom_id").orderBy(F.desc("fiscal_year"), "symbol")
    ranked = atoms.select("atom_id", "symbol", "time_horizon").join(facts, "symbol").withColumn("rn", F.row_number().over(w))
    return ranked.where(F.col("rn") <= 10).where((F.col("rn") <= 5) | (F.col("time_horizon") != "current"))


def fetch_symbol(symbol: str, sub_types: list[str], tables: dict[str, DataFrame], years: tuple[int, ...] = ()) -> list[Fetched]:
    """Several kinds of one company; kinds the warehouse doesn't hold are left out."""
    return fetch([Atom(k, symbol=symbol, years=tuple(years), metric=k.replace("_", " "), time_horizon="historical" if years else "current") for k in sub_types if k in KINDS], tables)
