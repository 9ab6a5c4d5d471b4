"""Collected small results into prompt text, and the end-to-end answer. Driver side."""

from __future__ import annotations

import functools
import re
import textwrap
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ledgerloom.operators.understand import decompose, onward, year_intent

ORDER = ("CONTRADICT", "CONFIRM", "FORWARD", "UNMATCHED")
#: Characters of a prompt by the size of a model's context; a model's name counts by the size it contains.
BUDGETS = {"small": 12_000, "medium": 24_000, "large": 80_000}
CHARS_A_TOKEN, LARGE_CONTEXT = 3.5, 20_000


def budget_for(model: str, budgets: dict[str, int] = BUDGETS, default: str = "medium") -> int:
    """The budget of a model: its own entry, else that of the longest entry its name contains, else the default."""
    low = model.lower()
    fitting = [k for k in budgets if k in low]
    return budgets[max(fitting, key=len)] if fitting else budgets[default]


def tokens_of(text: str) -> int:
    """Estimated tokens, at least one."""
    return max(1, int(len(text) / CHARS_A_TOKEN))


def shown(value: float | None, unit: str) -> str:
    if value is None:
        return "n/a"
    return {"%": f"{value:,.2f}%", "x": f"{value:,.2f}x", "days": f"{value:,.0f} days", "rs": f"₹{value:,.2f}", "crore": f"₹{value:,.1f} cr"}.get(unit, f"{value:,.2f}")


def figures(rows: list[dict]) -> str:
    """Reported figures, numbered [SQL-1] and on."""
    if not rows:
        return "No reported figures."
    return "\n".join(f"[SQL-{i}] {r.get('symbol') or '-':<12} {r.get('metric', ''):<28} {r.get('period') or r.get('year') or '':<12} {shown(r.get('value'), r.get('unit') or '')}" for i, r in enumerate(rows, 1))


def insights(rows: list[dict]) -> str:
    """Comparisons, contradictions first."""
    ranked = sorted(rows, key=lambda r: ORDER.index(r["type"]) if r.get("type") in ORDER else len(ORDER))
    return "\n".join(f"{r.get('type')}: {r.get('note', '')}" for r in ranked)


def sources(chunks: list[dict], start: int = 1) -> str:
    """Text passages, numbered [SRC-n], wrapped."""
    out = []
    for i, c in enumerate(chunks, start):
        place = (c.get("section") or c.get("speaker") or "")[:50]
        out.append(f"[SRC-{i}] {c.get('symbol') or ''} {c.get('year') or ''} {c.get('doc_type') or ''} {place} (score {float(c.get('score') or 0):.4f})\n" + textwrap.fill((c.get("text") or "")[:1200], 100))
    return "\n\n".join(out)


def trimmed(chunks: list[dict], budget: int, extra: int = 250) -> list[dict]:
    """Leading passages within a budget of characters; at least one, none for a budget of 0."""
    kept, used = [], 0
    for c in chunks if budget > 0 else ():
        used += len(c.get("text") or "") + extra
        if kept and used > budget:
            break
        kept.append(c)
    return kept


def trimmed_to_tokens(chunks: list[dict], system: str, user: str, context: int, reply: int = 1024, most_chars: int | None = None, extra: int = 60, slack: int = 200) -> list[dict]:
    """Leading passages that leave room for the prompt and a reply of `reply` tokens in a context of `context` tokens.

    All of them in a large context; the first three where there is no room at all; else at least one.
    most_chars also bounds the characters of everything that is sent.
    """
    if context >= LARGE_CONTEXT:
        return list(chunks)
    room = context - reply - tokens_of(system) - tokens_of(user) - slack
    if room <= 0:
        return list(chunks[:3])
    kept, used, chars = [], 0, len(system) + len(user)
    for c in chunks:
        text = c.get("text") or ""
        used, chars = used + tokens_of(text) + extra, chars + len(text) + 250
        if used > room or (most_chars is not None and chars > most_chars):
            break
        kept.append(c)
    return kept or list(chunks[:1])


# What a question is after, by words of it, and how figures that no table holds are worked out.
_INTENTS = (("compar|versus|\\bvs\\b", "Compare the companies side by side."), ("risk|headwind", "Name each risk with its source."), ("outlook|guidance|expect|going forward", "Keep outlooks apart from reported figures."), ("trend|growth|over the years", "Give the figures in order of years."))
_METRICS = (("cagr|compound", "CAGR = (end / start) ^ (1 / years) - 1."), ("free cash flow|\\bfcf\\b", "Free cash flow = cash from operations - capital expenditure."), ("ebitda", "Where EBITDA isn't reported: operating profit + depreciation."))


def intent_note(query: str) -> str:
    return " ".join(note for pattern, note in _INTENTS if re.search(pattern, query, re.I))


def metric_note(query: str) -> str:
    return " ".join(note for pattern, note in _METRICS if re.search(pattern, query, re.I))


def context_of(chunks: list[dict]) -> str:
    """Passages newest first, reports before calls of a year, under their numbers: the context of a prompt without figures."""
    ranked = sorted(chunks, key=lambda c: (-(c.get("year") or 0), c.get("doc_type") != "annual_report"))
    return sources(ranked)


def gap_note(resolved: list[int], explicit: list[int]) -> str:
    return "" if explicit else f"No year was named; the last years {resolved[0]} to {resolved[-1]} were searched." if resolved else ""


@dataclass
class Prompt:
    system: str
    user: str
    mode: str
    counts: dict[str, int] = field(default_factory=dict)


def build(query: str, rows: list[dict], found: list[dict], chunks: list[dict], model: str = "medium") -> Prompt:
    """The prompt within the model's budget; its mode tells what there was: full, no_sql, vector_only or minimal."""
    resolved, explicit = year_intent(query)
    mode = "full" if rows and found else "no_sql" if found else "vector_only" if chunks else "minimal"
    parts = [f"Question: {query}", gap_note(resolved, explicit), intent_note(query), metric_note(query)]
    if rows:
        parts.append("Reported figures\n" + figures(rows))
    if found:
        parts.append("Comparisons\n" + insights(found))
    room = budget_for(model) - sum(map(len, parts))
    kept = trimmed(chunks, room)
    if kept:
        parts.append("Passages\n" + sources(kept))
    return Prompt("Answer from the figures and passages only, and cite them by their numbers.", "\n\n".join(p for p in parts if p), mode, {"rows": len(rows), "insights": len(found), "chunks": len(kept)})


def answer(query: str, symbol: str | None, get_rows: Callable, get_insights: Callable, get_chunks: Callable, model: str = "medium", answer_fn: Callable[[str, str], str] | None = None) -> dict[str, Any]:
    """A question end to end. The three getters turn atoms and years into small lists; a failing one degrades the mode and never stops the answer."""
    query = onward(query)
    resolved, _ = year_intent(query)
    atoms = decompose(query, symbol)

    def safely(f: Callable, *args) -> list[dict]:
        try:
            return list(f(*args))
        except Exception:  # noqa: BLE001 - a failed channel is left out
            return []

    chunks = safely(get_chunks, query, symbol, resolved)
    rows = safely(get_rows, atoms)
    p = build(query, rows, safely(get_insights, rows, chunks) if rows or chunks else [], chunks, model)
    return {"answer": (answer_fn or (lambda system, user: user))(p.system, p.user), "mode": p.mode, **p.counts}


def cached(lookup: Callable[[tuple], Any], store: Callable[[tuple, Any], None]):
    """Decorator: results by (query, symbol, doc_type, years)."""

    def around(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(query, symbol=None, doc_type=None, years=None, **kw):
            key = (query.strip(), (symbol or "").upper(), doc_type or "", tuple(sorted(years or ())))
            if (hit := lookup(key)) is not None:
                return hit
            result = f(query, symbol=symbol, doc_type=doc_type, years=years, **kw)
            store(key, result)
            return result

        return call

    return around
