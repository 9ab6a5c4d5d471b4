"""Questions into typed needs and fiscal years. One question is driver work; for tables of questions there are vectorised forms."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.bridge import Atom, channel
from ledgerloom.operators.catalog import KINDS, TEXT_KINDS

CURRENT, LOOKBACK, FIRST = 2025, 3, 2010
FORWARD = re.compile(r"\b(outlook|guidance|forecast|expect|expected|target|next year|next quarter|going forward|plans?|estimate)\b", re.I)
# Our own words for kinds whose names alone don't say how people ask for them.
ALIASES = {
    "revenue": "revenue|sales|turnover|top ?line", "revenue_q": "quarterly (?:revenue|sales)", "net_profit": "net profit|pat\\b|profit after tax|bottom line", "net_profit_q": "quarterly (?:net )?profit", "pbt": "pbt\\b|profit before tax", "opm": "operating margin|opm\\b",
    "eps": "eps\\b|earnings per share", "ebit": "ebit\\b", "ebitda": "ebitda\\b", "ebitda_margin": "ebitda margin", "net_margin": "net (?:profit )?margin", "gross_margin": "gross margin", "roe": "roe\\b|return on equity", "roce": "roce\\b|return on capital", "roa": "roa\\b|return on assets",
    "pe": "p/?e\\b|price to earnings", "pb": "p/?b\\b|price to book", "ev_ebitda": "ev ?/ ?ebitda", "market_cap": "market cap", "debt_equity": "debt to equity|debt[ -/]equity|gearing", "ocf": "operating cash flow|cash from operations|cfo\\b", "fcf": "free cash flow|fcf\\b", "cfi": "investing cash flow|cfi\\b",
    "cff": "financing cash flow|cff\\b", "capex": "capex|capital expenditure", "borrowings": "borrowings|total debt|\\bloans", "cash": "cash (?:balance|and)|cash equivalents", "trade_receivables": "receivables|debtors", "inventories": "inventor(?:y|ies)", "cwip": "cwip|capital work in progress",
    "revenue_cagr": "(?:revenue|sales) cagr", "profit_cagr": "profit cagr", "stock_cagr": "(?:stock|price) cagr", "dso": "dso\\b|debtor days", "dio": "dio\\b|inventory days", "dpo": "dpo\\b|payable days", "ccc": "cash conversion", "working_capital": "working capital", "52w_high": "52[ -]?week high",
    "price": "share price|stock price|\\bprice\\b(?! to)", "rsi": "\\brsi\\b", "macd": "\\bmacd\\b", "sma": "moving average|\\bsma\\b", "ema": "\\bema\\b", "atr": "\\batr\\b", "adx": "\\badx\\b", "obv": "\\bobv\\b", "vwap": "\\bvwap\\b", "repo_rate": "repo rate", "rbi_policy": "monetary policy|rbi policy", "forex": "exchange rate|forex|usd ?/? ?inr",
    "macro": "\\bgdp\\b|\\bcpi\\b|inflation|\\biip\\b", "market_index": "nifty|sensex", "promoter": "promoter", "fii": "\\bfiis?\\b|foreign institution", "dii": "\\bdiis?\\b|domestic institution", "eps_estimate": "eps estimate|consensus", "eps_surprise": "eps surprise|earnings surprise", "eps_revision": "revisions?",
    "mda": "md&a|management discussion", "risk_factors": "\\brisks?\\b", "business_overview": "business (?:overview|model)|what does .* do", "concall_outlook": "outlook|guidance", "concall_mgmt": "management (?:said|commentary|say)", "concall_capex": "capex (?:plan|guidance)", "concall_margin": "margin (?:guidance|outlook)",
}
#: Kinds that no question reaches directly.
_SILENT = {"ebitda_proxy", "depreciation", "interest", "eps_q", "tax", "net_worth", "net_cashflow", "ev_revenue", "ev", "fcf_cagr", "roe_avg", "price_intraday", "52w_low", "bb", "shareholders", "concall_guidance"}
_TECHNICAL, _MACRO, _OWNERS = ("technical_indicators", "price_daily"), ("rbi_rates", "forex_commodities", "macro_indicators", "market_indices"), ("ownership", "ownership_history")


def _need(kind: str) -> str:
    if kind in TEXT_KINDS:
        return "forward_looking" if kind.startswith("concall") else "qualitative"
    t = KINDS[kind].table
    return "technical" if t in _TECHNICAL or kind.startswith("52w") else "macro" if t in _MACRO else "ownership" if t in _OWNERS else "quantitative"


#: (kind, need, pattern): the aliases, or the words of the kind's name.
RULES = tuple((k, _need(k), ALIASES.get(k, r"\b" + k.replace("_", "[ _-]?") + r"\b")) for k in (*KINDS, *TEXT_KINDS) if k not in _SILENT)
_COMPILED = tuple((k, need, re.compile(p, re.I)) for k, need, p in RULES)


def full_year(text: str) -> int | None:
    n = int(text)
    n = n + 2000 if n < 100 else n
    return n if 2000 <= n <= 2099 else None


_COUNTS = {"two": 2, "three": 3, "four": 4, "five": 5, "ten": 10}
_LAST = re.compile(r"\b(?:last|past|previous|recent)\s+(\d+|two|three|four|five|ten)\s+(?:fiscal\s+|financial\s+)?years?\b", re.I)
_SPAN = re.compile(r"\bfy[\s-]*(\d{2,4})\s*(?:to|through|till|[-/–])\s*(?:fy[\s-]*)?(\d{2,4})\b", re.I)
_PLAIN_SPAN = re.compile(r"\b(20\d{2})\s*(?:to|through|till|-|–)\s*(20\d{2})\b", re.I)
_NAMED = re.compile(r"\bfy[\s-]*(\d{2,4})\b", re.I)
_WORDED = re.compile(r"\b(?:financial\s+)?year\s+(20\d{2})\b", re.I)
_BARE = re.compile(r"\b(20\d{2})\b")


def year_intent(query: str) -> tuple[list[int], list[int]]:
    """(years to search, years the question names). The first form that fits counts:

    the last N years; a span of fiscal years; a span of plain years; several fiscal years, exactly those;
    one; "financial year 2024" or "year 2024"; plain years up to the current one. Without any, the last
    three years are searched and none is named.
    """
    q = query or ""
    years = lambda a, b: list(range(min(a, b), max(a, b) + 1))
    if m := _LAST.search(q):
        n = _COUNTS.get(m.group(1).lower()) or int(m.group(1))
        found = years(CURRENT - n + 1, CURRENT)
    elif (m := _SPAN.search(q)) and (a := full_year(m.group(1))) and (b := full_year(m.group(2))):
        found = years(a, b)
    elif m := _PLAIN_SPAN.search(q):
        found = years(int(m.group(1)), int(m.group(2)))
    elif not (found := sorted({y for x in _NAMED.findall(q) if (y := full_year(x))})):
        found = [int(m.group(1))] if (m := _WORDED.search(q)) else sorted({int(x) for x in _BARE.findall(q) if FIRST <= int(x) <= CURRENT})
    return (found, found) if found else (years(CURRENT - LOOKBACK + 1, CURRENT), [])


def named_years(query: str, compat: bool = False) -> list[int]:
    """All years a question names, spans filled: the rules by which needs get their years.

    compat reads spans as the reference does: only with a dash or one of the letters t and o between, and
    "FY 2023-25" ends in the year after its first.
    """
    q, out = (query or "").upper(), set()
    years = lambda a, b: range(a, b + 1)
    for m in re.finditer(r"FY(\d{2,4})\s*[-–to]+\s*(?:FY)?(\d{2,4})" if compat else r"FY[\s-]*(\d{2,4})\s*(?:-|–|/|TO|THROUGH|TILL)\s*(?:FY[\s-]*)?(\d{2,4})", q):
        if (a := full_year(m.group(1))) and (b := full_year(m.group(2))):
            out.update(years(a, b))
    for m in re.finditer(r"(?:FINANCIAL\s+YEAR|FY)\s*(\d{4})\s*[-–]\s*(\d{2,4})", q):
        first, tail = int(m.group(1)), m.group(2)
        last = first + 1 if compat and len(tail) == 2 else int(tail) if len(tail) == 4 else full_year(tail) or first
        out.update(years(first, last))
    out.update(y for x in re.findall(r"FY[\s-]*(\d{2,4})" if not compat else r"FY\s*(\d{2,4})", q) if (y := full_year(x)))
    out.update(int(x) for x in _BARE.findall(q))
    return sorted(out)


def onward(query: str) -> str:
    """'since FY22' and 'from FY23 onward' written out as a list up to the current year; future years stay."""

    def listed(m: re.Match) -> str:
        y = full_year(m.group(1))
        return m.group() if y is None or y > CURRENT else ", ".join(f"FY{x}" for x in range(y, CURRENT + 1))

    return re.sub(r"\b(?:from\s+FY\s?(\d{4}|\d{2})\s+onwards?)\b", listed, re.sub(r"\bsince\s+FY\s?(\d{4}|\d{2})\b", listed, query, flags=re.I), flags=re.I)


def decompose(query: str, symbol: str | None = None, fallback: Callable[[str], list[Atom]] | None = None, min_rule_atoms: int = 1) -> list[Atom]:
    """One atom per kind the rules find; a fallback (a model behind a callable) adds kinds where they found too few."""
    _, named = year_intent(query)
    horizon = "forward_looking" if FORWARD.search(query) else "historical" if named else "current"
    atoms = []
    for kind, need, pattern in _COMPILED:
        if pattern.search(query):
            atoms.append(Atom(kind, need, kind.replace("_", " "), symbol, years=tuple(named), time_horizon="current" if need in ("technical", "macro") else horizon, raw_text=query))
    if len(named) > 1 and any(a.sub_type == "ebitda" for a in atoms):
        atoms.append(Atom("ebitda_proxy", "quantitative", "operating profit + depreciation", symbol, years=tuple(named), time_horizon="historical", raw_text=query))
    if fallback and len(atoms) < min_rule_atoms:
        have = {a.sub_type for a in atoms}
        atoms += [replace(a, symbol=a.symbol or symbol, source="model") for a in fallback(query) if a.sub_type not in have]
    return atoms


@F.pandas_udf(T.StructType([T.StructField("resolved", T.ArrayType(T.IntegerType())), T.StructField("explicit", T.ArrayType(T.IntegerType()))]))
def year_intents(query: pd.Series) -> pd.DataFrame:
    """year_intent of a column of questions."""
    found = [year_intent(q) for q in query]
    return pd.DataFrame({"resolved": [r for r, _ in found], "explicit": [e for _, e in found]})


def kinds_of(query: str | Column) -> Column:
    """The kinds a column of questions asks for: all rules as literals of one expression, no join."""
    q = F.col(query) if isinstance(query, str) else query
    return F.filter(F.array(*(F.when(q.rlike("(?i)" + p), F.lit(k)) for k, _, p in RULES)), lambda x: x.isNotNull())


def decomposed(questions: DataFrame) -> DataFrame:
    """query_id, sub_type, years of every question: the batch form of `decompose`."""
    return questions.select("query_id", F.explode(kinds_of("query")).alias("sub_type"), year_intents("query")["explicit"].alias("years"))


def summary(atoms: list[Atom]) -> dict:
    """What the needs of a question are about: counts by need, companies, years and channels."""
    everyone = {s for a in atoms for s in ((a.symbol,) if a.symbol else a.symbols)}
    return {"atoms": len(atoms), "needs": need_counts(atoms), "symbols": sorted(everyone), "years": sorted({y for a in atoms for y in a.years}), "channels": sorted({channel(a) for a in atoms})}


def need_counts(atoms: list[Atom]) -> dict[str, int]:
    out: dict[str, int] = {}
    for a in atoms:
        out[a.need_type] = out.get(a.need_type, 0) + 1
    return out


def need_histogram(questions: DataFrame) -> DataFrame:
    """Need types over all questions: need_type, atoms, questions."""
    needs = F.create_map(*(F.lit(x) for k, need, _ in RULES for x in (k, need)))
    return decomposed(questions).withColumn("need_type", needs[F.col("sub_type")]).groupBy("need_type").agg(F.count("*").alias("atoms"), F.countDistinct("query_id").alias("questions"))


def unfenced(text: str | Column) -> Column:
    """A model's JSON without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.trim(F.col(text) if isinstance(text, str) else text), r"^```(?:json)?\s*|\s*```$", ""))
