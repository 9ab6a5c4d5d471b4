"""Segmentation of unit strings into prefixes, roots and exponents.

A unit string is cut by dynamic programming over one trie of lexemes. Every lexeme has a kind
(scale prefix, currency root, ratio root, time root, exponent, filler) and the segmentation of the
least cost wins: a lexeme costs 1, filler 0.6, a character no lexeme covers 4. A lexeme with several
readings ("m", "ps", "ratio", "%") is resolved by the dimension prior of the field: the dimension
of its common unit.
"""

from __future__ import annotations

import re
from functools import lru_cache, wraps
from typing import NamedTuple

# The lexicon, by kind. A scale or root is (spelling, value).
SCALES = {
    "hundred": 1e2, "hundreds": 1e2,
    "thousand": 1e3, "thousands": 1e3, "'000": 1e3, "'000s": 1e3, "000": 1e3, "000s": 1e3, "k": 1e3, "th": 1e3,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "lk": 1e5, "l": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "mio": 1e6, "m": 1e6, "mm": 1e6, "mns": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "bln": 1e9, "b": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
}
CURRENCIES = {
    "inr": ("INR", 1.0), "rs": ("INR", 1.0), "re": ("INR", 1.0), "rupee": ("INR", 1.0), "rupees": ("INR", 1.0), "₹": ("INR", 1.0),
    "paise": ("INR", 0.01), "paisa": ("INR", 0.01), "ps": ("INR", 0.01), "p": ("INR", 0.01),
    "usd": ("USD", 1.0), "us$": ("USD", 1.0), "$": ("USD", 1.0), "dollar": ("USD", 1.0), "dollars": ("USD", 1.0), "us dollar": ("USD", 1.0), "us dollars": ("USD", 1.0),
    "cent": ("USD", 0.01), "cents": ("USD", 0.01),
    "eur": ("EUR", 1.0), "€": ("EUR", 1.0), "euro": ("EUR", 1.0), "euros": ("EUR", 1.0),
    "gbp": ("GBP", 1.0), "£": ("GBP", 1.0), "jpy": ("JPY", 1.0), "¥": ("JPY", 1.0), "aed": ("AED", 1.0), "sgd": ("SGD", 1.0),
}
RATIOS = {
    "%": 0.01, "percent": 0.01, "per cent": 0.01, "pct": 0.01, "percentage": 0.01, "percentage points": 0.01, "pp": 0.01,
    "bps": 1e-4, "bp": 1e-4, "basis point": 1e-4, "basis points": 1e-4,
    "fraction": 1.0, "decimal": 1.0, "ratio": 1.0, "fraction of 1": 1.0, "ratio (0 to 1)": 1.0, "0 to 1": 1.0,
    "x": 1.0, "times": 1.0, "multiple": 1.0, "‰": 1e-3,
}
TIMES = {
    "d": 1.0, "day": 1.0, "days": 1.0, "no. of days": 1.0, "number of days": 1.0,
    "w": 7.0, "wk": 7.0, "wks": 7.0, "week": 7.0, "weeks": 7.0,
    "m": 30.0, "mo": 30.0, "mos": 30.0, "mth": 30.0, "mths": 30.0, "month": 30.0, "months": 30.0,
    "qtr": 91.0, "quarter": 91.0, "quarters": 91.0, "y": 365.0, "yr": 365.0, "yrs": 365.0, "year": 365.0, "years": 365.0,
    "h": 1 / 24, "hr": 1 / 24, "hrs": 1 / 24, "hour": 1 / 24, "hours": 1 / 24,
}
FILLERS = (
    "in", "of", "full", "only", "per share", "/share", "/ share", "a share", "per", "share", "no.", "no. of", "number of",
    "all figures", "all figures in", "all amounts in", "figures", "figures in", "amounts", "amount", "amounts in", "values", "values in",
    "unless stated", "unless otherwise stated", "stated", "statement", "unit", "units", "scale", "currency", "as", "a", "are", "as a",
    "n.a", "na", "as stated", "reported", "expressed in", "and", "the",
)

#: The dimension of each common unit, and what one common unit is worth in the dimension's base.
COMMON = {"crore": ("money", 1e7), "rs": ("money", 1.0), "%": ("ratio", 0.01), "x": ("ratio", 1.0), "days": ("time", 1.0)}

LEXEME_COST, FILLER_COST, UNKNOWN_COST, GAIN = 1.0, 0.6, 4.0, 2.0
#: How much less likely a kind of lexeme is in a field of each dimension, as what it costs beyond one that fits.
PRIORS = {
    "money": {"money": 0.0, "scale": 0.0, "exponent": 0.0, "ratio": 2.5, "time": 2.5},
    "ratio": {"ratio": 0.0, "exponent": 2.5, "scale": 2.5, "money": 2.5, "time": 2.5},
    "time": {"time": 0.0, "exponent": 2.5, "scale": 2.5, "money": 2.5, "ratio": 2.5},
}


class Lexeme(NamedTuple):
    kind: str  # scale, money, ratio, time, exponent, filler
    value: float
    currency: str | None


class Reading(NamedTuple):
    """What a string says: scale and currency are None where it says nothing of them."""

    scale: float | None = None
    currency: str | None = None
    root: float | None = None
    residue: bool = False

    @property
    def empty(self) -> bool:
        return self.scale is None and self.currency is None and self.root is None


def _build_trie() -> dict:
    trie: dict = {}

    def add(text: str, lexeme: Lexeme) -> None:
        node = trie
        for char in text:
            node = node.setdefault(char, {})
        node.setdefault("", []).append(lexeme)

    for text, value in SCALES.items():
        add(text, Lexeme("scale", value, None))
    for text, (currency, value) in CURRENCIES.items():
        add(text, Lexeme("money", value, currency))
    for text, value in RATIOS.items():
        add(text, Lexeme("ratio", value, None))
    for text, value in TIMES.items():
        add(text, Lexeme("time", value, None))
    for power in range(1, 16):
        for form in (f"10^{power}", f"10**{power}", f"e{power}", f"x10^{power}", f"×10^{power}"):
            add(form, Lexeme("exponent", 10.0**power, None))
    for text in FILLERS:
        add(text, Lexeme("filler", 1.0, None))
    return trie


TRIE = _build_trie()
_SPACE = re.compile(r"\s+")
_SEPARATORS = set(" .,:;()[]{}/-–—_|*")


def normal(text: str) -> str:
    return _SPACE.sub(" ", text.replace("’", "'").replace("‘", "'").replace("`", "'")).strip().lower()


_PLAIN = {ord(c): "'" for c in "’‘`"} | {ord(c): " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"} | dict.fromkeys(range(0x2000, 0x200B), " ")


def flat(text: str) -> str:
    """A sentence as the trie reads it, with every character in its place."""
    low = text.translate(_PLAIN).lower()
    if len(low) == len(text):
        return low
    return "".join(low if len(low := c.lower()) == 1 else c for c in text.translate(_PLAIN))


def _matches(text: str, at: int) -> list[tuple[int, Lexeme]]:
    """Lexemes that start at `at` and end at a word's end."""
    found, node, i = [], TRIE, at
    if at and text[at].isalpha() and text[at - 1].isalpha():
        return found
    if at and text[at].isdigit() and (text[at - 1].isdigit() or text[at - 1] == "."):
        return found
    while i < len(text) and (node := node.get(text[i])) is not None:
        i += 1
        if "" in node:
            inside = i < len(text) and ((text[i - 1].isalpha() and text[i].isalpha()) or (text[i - 1].isdigit() and text[i].isdigit()))
            if not inside:
                found += [(i, lexeme) for lexeme in node[""]]
    return found


def _cost(lexeme: Lexeme, dimension: str) -> float:
    return FILLER_COST if lexeme.kind == "filler" else LEXEME_COST + PRIORS[dimension][lexeme.kind]


def segment(text: str, dimension: str, at: int = 0, open_end: bool = False) -> tuple[list[Lexeme], int]:
    """The cheapest segmentation of `text` from `at` on: its lexemes in order and the number of characters left over.

    Ties go to the segmentation with fewer lexemes, then to the one found with the longer last lexeme.

    With an open end the text goes on after the unit, as in a sentence. Then no character may be left
    over inside, and the segmentation ends wherever that is cheapest, each lexeme of the field's
    dimension being worth GAIN: so fillers count only between or before such lexemes. Only the reach of
    the lexemes is walked, however long the text is.
    """
    best: dict[int, tuple[float, int, int, int, Lexeme | None]] = {at: (0.0, 0, 0, at, None)}
    ends: list[int] = [at]
    n, i = len(text), at
    while i < n:
        if i in best:
            cost, count, unknown, _, _ = best[i]
            if open_end:
                bridge = text[i] == " " or (text[i] in "./-'" and text[i + 1 : i + 2].isalpha())
                options = [(i + 1, 0.0, None)] if bridge else []
                for j, lexeme in _matches(text, i):
                    step = _cost(lexeme, dimension)
                    if step <= LEXEME_COST and not (lexeme.kind == "money" and text[j:].lstrip(" ")[:1].isdigit()) and not text[j : j + 1].isdigit():
                        options.append((j, step if lexeme.kind == "filler" else step - GAIN, lexeme))
            else:
                options = [(i + 1, (0.0 if text[i] in _SEPARATORS else UNKNOWN_COST), None)]
                options += [(j, _cost(lexeme, dimension), lexeme) for j, lexeme in _matches(text, i)]
            for j, step, lexeme in options:
                left = unknown + (lexeme is None and text[i] not in _SEPARATORS and not open_end)
                new = (cost + step, count + (lexeme is not None), left, i, lexeme)
                if j not in best or new[:2] < best[j][:2]:
                    best[j] = new
                    ends.append(j)
        elif open_end and i >= max(ends):
            break
        i += 1
    end = min(ends, key=lambda j: (best[j][0], best[j][1], j)) if open_end else n
    lexemes, i = [], end
    while i > at:
        _, _, _, before, lexeme = best[i]
        if lexeme is not None:
            lexemes.append(lexeme)
        i = before
    return lexemes[::-1], best[end][2]


def _remembered(read):
    """Keeps the readings of short strings; long ones, which hardly come again, would only fill the memory."""
    kept = lru_cache(maxsize=200_000)(read)
    return wraps(read)(lambda text, dimension: kept(text, dimension) if not text or len(text) <= 200 else read(text, dimension))


@_remembered
def read_unit(text: str | None, dimension: str) -> Reading:
    """The reading of a string that names nothing but a unit; residue is true where it says more."""
    if not text or not (text := normal(text)):
        return Reading()
    lexemes, left = segment(text, dimension)
    if left:
        return Reading(residue=True)
    return combine(lexemes, dimension)


def combine(lexemes: list[Lexeme], dimension: str) -> Reading:
    """Multiplies the lexemes that belong to the field's dimension. Those of another are residue."""
    scale = root = currency = None
    for lexeme in lexemes:
        if lexeme.kind == "filler":
            continue
        if dimension == "money" and lexeme.kind in ("scale", "exponent"):
            scale = (scale or 1.0) * lexeme.value
        elif dimension == "money" and lexeme.kind == "money":
            if currency is None:
                currency = lexeme.currency
                if lexeme.value != 1.0:
                    scale = (scale or 1.0) * lexeme.value
            elif lexeme.currency != currency:
                return Reading(residue=True)
        elif lexeme.kind == dimension and dimension != "money":
            root = lexeme.value if root is None else root
        else:
            return Reading(residue=True)
    return Reading(scale, currency, root)


_JOINT = re.compile(r"[(\[,]|(?<=\s)[-–—](?=\s)|(?<=\s)in(?=\s)", re.I)


@_remembered
def read_label(label: str | None, dimension: str) -> Reading:
    """The unit a field's label ends with: in brackets, or after a comma, a dash or "in".

    The longest end that names nothing but a unit counts, sought from the label's end until it says more.
    """
    found = Reading()
    if not label:
        return found
    bare = label.rstrip()
    closed = bare.endswith((")", "]"))
    for m in reversed(list(_JOINT.finditer(bare))):
        if not bare[: m.start()].strip():
            break
        if m.group() in "([" and not closed:
            break
        reading = read_unit(bare[m.end() :], dimension)
        if reading.residue:
            break
        if not reading.empty:
            found = reading
    return found


_NUMBER = r"\d[\d,]*(?:\.\d+)?|\.\d+"
_NUMBERS = re.compile(_NUMBER)
_RANGE = re.compile(rf"\s*(?:-|–|—|to|and)\s*(?:₹|rs\.?|inr|us\$|usd|\$|€|eur|euro)?\s*(?:{_NUMBER})", re.I)
_SYMBOLS = {text: currency for text, (currency, value) in CURRENCIES.items() if value == 1.0}
_LONGEST = max(map(len, _SYMBOLS))


def _currency_before(text: str, at: int) -> Lexeme | None:
    """The currency that stands right before a number."""
    while at and text[at - 1].isspace():
        at -= 1
    if at > 1 and text[at - 1] == "." and text[at - 2].isalpha():
        at -= 1
    for n in range(min(_LONGEST, at), 0, -1):
        word = text[at - n : at].lower()
        if word in _SYMBOLS and not (at > n and word[0].isalpha() and text[at - n - 1].isalnum()):
            return Lexeme("money", 1.0, _SYMBOLS[word])
    return None


def read_figure(text: str | None, figure: float | None, dimension: str) -> Reading:
    """The unit of `figure` where it stands in a sentence: currency before it, the rest after it.

    A number may be the first of a range ("8.4-9.1 crore"). Of several equal numbers the first one
    that has a unit of the field's dimension counts.
    """
    if not text or figure is None or figure != figure:
        return Reading()
    lowered = flat(text)
    for m in _NUMBERS.finditer(text):
        digits = m.group().rstrip(",").replace(",", "")
        if digits in ("", ".") or abs(float(digits) - abs(figure)) > 1e-9 * max(1.0, abs(figure)):
            continue
        end = m.start() + len(m.group().rstrip(","))
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "."):
            continue
        if r := _RANGE.match(text, end):
            end = r.end()
        lexemes, _ = segment(lowered, dimension, end, open_end=True)
        if b := _currency_before(text, m.start()):
            lexemes = [b] + lexemes
        reading = combine(lexemes, dimension)
        if not reading.residue and not reading.empty:
            return reading
    return Reading()


def factor(readings: list[Reading], common: str) -> tuple[float | None, str | None]:
    """(factor, currency) that turn a figure into its common unit, before exchange rates; None where no unit is named.

    Readings come in order of trust; each fills what those before it left open. A currency without
    a scale means single units of it; a scale without a currency means rupees.
    """
    dimension, worth = COMMON[common]
    readings = [r for r in readings if not r.residue]
    if dimension != "money":
        root = next((r.root for r in readings if r.root is not None), None)
        return (None, None) if root is None else (root / worth, None)
    scale = next((r.scale for r in readings if r.scale is not None), None)
    currency = next((r.currency for r in readings if r.currency is not None), None)
    if scale is None and currency is None:
        return None, None
    return (1.0 if scale is None else scale) / worth, currency or "INR"
