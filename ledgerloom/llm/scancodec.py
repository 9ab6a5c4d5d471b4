"""The models of problem 4: an averaged-perceptron editor of characters and line ends, and one of page furniture."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import xxhash

# Letters and digits that scanners take for one another, as (read, meant): what artificial misreadings are made with.
CONFUSIONS = (
    ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("|", "l"), ("|", "i"), ("|", "I"), ("5", "s"), ("5", "S"), ("6", "b"), ("8", "B"), ("9", "g"), ("9", "q"), ("2", "Z"), ("2", "z"),
    ("q", "g"), ("g", "q"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("i", "r"), ("r", "i"), ("i", "l"), ("l", "i"), ("I", "l"), ("l", "I"), ("b", "h"), ("h", "b"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("nn", "m"), ("ri", "n"), ("ti", "h"), ("O", "0"),
)
#: Letters that stand for digits inside numbers, as (read, meant).
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "S": "5", "s": "5", "B": "8", "b": "6", "G": "6", "g": "9", "q": "9", "Z": "2", "z": "2", "D": "0"}
#: Marks of a word broken at a line's end.
MARKS = "-¬­‐‑"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

TOKEN = re.compile(r"[A-Za-z0-9|]+(?:[,.][A-Za-z0-9|]+)*")
_NUMBER = re.compile(r"(?:FY|Q|H)?\d[\d,]*(?:\.\d+)?(?:st|nd|rd|th)?")
_HEAD = re.compile(r"(?:FY|Q|H)(?=.*\d)")
_DIGIT = re.compile(r"\d")
_ALPHA = re.compile(r"[A-Za-z]+")


def key(token: str) -> str:
    """A token's entry in the lexicon: small letters; tokens with digits keep their case and have 9 for every digit."""
    return token.lower() if token.isalpha() or not _DIGIT.search(token) else _DIGIT.sub("9", token)


def key_hash(k: str) -> int:
    return xxhash.xxh64_intdigest(k)


class Lexicon:
    """Counts of keys over the whole corpus, as two packed arrays ordered by the keys' 64-bit hashes.

    Hyphenated compounds have entries of their own. A key takes 16 bytes, whatever its length.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.int64)
        self.total = max(1, int(self.counts.sum()))
        self.added: dict[str, int] = {}
        self._memo: dict[str, int] = {}

    @classmethod
    def of(cls, counts: dict[str, int]) -> "Lexicon":
        return cls(np.array([key_hash(k) for k in counts], np.uint64), np.array(list(counts.values()), np.int64))

    def many(self, keys: list[str]) -> np.ndarray:
        """The counts of many keys at once; 0 for those never seen."""
        if not len(self.hashes) or not keys:
            found = np.zeros(len(keys), np.int64)
        else:
            h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == h, self.counts[at], 0)
        if self.added:
            found = found + np.array([self.added.get(k, 0) for k in keys], np.int64)
        return found

    def get(self, k: str) -> int:
        if (n := self._memo.get(k)) is None:
            if len(self._memo) > 300_000:
                self._memo.clear()
            h, n = np.uint64(key_hash(k)), 0
            at = int(self.hashes.searchsorted(h))
            if at < len(self.hashes) and self.hashes[at] == h:
                n = int(self.counts[at])
            self._memo[k] = n
        return n + self.added.get(k, 0) if self.added else n

    def log(self, k: str) -> float:
        return math.log2(1 + self.get(k))


class Edit(NamedTuple):
    """One operation on the characters of a token: at `at`, `read` becomes `put`. Empty `read` is an insertion, empty `put` a deletion."""

    at: int
    read: str
    put: str

    @property
    def kind(self) -> str:
        return "insert" if not self.read else "delete" if not self.put else "replace"


class Option(NamedTuple):
    token: str
    edits: tuple[Edit, ...]
    count: int


def _cased(put: str, token: str, at: int, upper: bool) -> str:
    """Letters put in take the case of the rest."""
    return put.upper() if upper else put.lower() if at else put


def _upper(token: str) -> bool:
    return sum(c.isupper() for c in token) > 1 and not any(c.islower() for c in token)


def _known_edits(token: str, confusions: Iterable[tuple[str, str]]) -> list[Edit]:
    """Every place of a token that one of the confusions may have changed, and doubled letters."""
    upper, out = _upper(token), {}
    for read, meant in confusions:
        at = token.find(read)
        while at >= 0:
            out.setdefault(Edit(at, read, _cased(meant, token, at, upper)))
            at = token.find(read, at + 1)
    if len(token) >= 5 and token.isalpha():
        for at in range(1, len(token)):
            if token[at].lower() == token[at - 1].lower():
                out.setdefault(Edit(at, token[at], ""))
    return list(out)


#: A misreading stands no more often than a word's own occurrences over this, and two.
AT_MOST = 5
#: An option so many times as frequent as the token is plain, and nothing further is sought.
PLAIN = 8
#: The share of all tokens below which a token counts as seldom seen: only then edits on no list are sought.
SELDOM = 1e-5


def _explains(counts: np.ndarray, own: int) -> np.ndarray:
    return (counts > own) & (own <= 2 + counts / AT_MOST)


def _any_edits(token: str, lexicon: Lexicon, own: int) -> list[Option]:
    """What the lexicon has more often than the token by any one replacement, deletion or insertion of a character, or by two characters read for one."""
    low, n, upper = key(token), len(token), _upper(token)
    new, places = [], []
    for at in range(n + 1):
        before = low[:at]
        for width in (0, 1, 2)[: n - at + 1]:
            after = low[at + width :]
            new += [before + c + after for c in _LETTERS]
            places.append((at, width))
    cuts = [low[:at] + low[at + 1 :] for at in range(n)]
    counts = lexicon.many(new + cuts)
    found: dict[str, Option] = {}
    for i in np.flatnonzero(_explains(counts, own)):
        if i < len(new):
            (at, width), c = places[i // len(_LETTERS)], _LETTERS[i % len(_LETTERS)]
            edit = Edit(at, token[at : at + width], c.upper() if upper or (not at and token[:1].isupper()) else c)
        else:
            edit = Edit(int(i) - len(new), token[i - len(new)], "")
        word = applied(token, (edit,))
        if word != token:
            found.setdefault(word, Option(word, (edit,), int(counts[i])))
    return list(found.values())


def applied(token: str, edits: Iterable[Edit]) -> str:
    for e in sorted(edits, reverse=True):
        token = token[: e.at] + e.put + token[e.at + len(e.read) :]
    return token


def _seen(token: str, edits: list[tuple[Edit, ...]], lexicon: Lexicon, own: int) -> list[Option]:
    """The edits whose result the lexicon has more often than the token."""
    new = [applied(token, e) if len(e) > 1 else token[: e[0].at] + e[0].put + token[e[0].at + len(e[0].read) :] for e in edits]
    counts = lexicon.many([x.lower() if x.isalpha() else key(x) for x in new])
    found: dict[str, Option] = {}
    for i in np.flatnonzero(_explains(counts, own)):
        if new[i] != token:
            found.setdefault(new[i], Option(new[i], edits[i], int(counts[i])))
    return list(found.values())


def options(token: str, lexicon: Lexicon, confusions: tuple[tuple[str, str], ...], unlisted: bool = True) -> list[Option]:
    """What the token may have been: by letters read for digits, by one known confusion, else also by two, else also by any one edit."""
    own = lexicon.get(key(token))
    out: list[Option] = []
    has_digit = any(c.isdigit() for c in token)
    if has_digit or sum(c in DIGITS for c in token) == len(token.replace(",", "").replace(".", "")):
        head = _HEAD.match(token)
        cut = head.end() if head else 0
        edits = tuple(Edit(i, c, DIGITS[c]) for i, c in enumerate(token) if i >= cut and c in DIGITS)
        number = applied(token, edits)
        if edits and _NUMBER.fullmatch(number) and any(c.isdigit() for c in token[cut:]):
            out.append(Option(number, edits, lexicon.get(key(number))))
    known = _known_edits(token, confusions)
    out += [o for o in _seen(token, [(e,) for e in known], lexicon, own) if all(o.token != p.token for p in out)]
    plain = lambda: any(o.count >= PLAIN * max(1, own) for o in out)
    if plain() or len(token) < 5:
        return out
    pairs = [(a, b) for a in known for b in known if a.at + len(a.read) <= b.at and a.put and b.put]
    out += _seen(token, pairs, lexicon, own)
    if not plain() and unlisted and own < SELDOM * lexicon.total and 2 * sum(map(str.isalpha, token)) > len(token):
        out += [o for o in _any_edits(token, lexicon, own) if all(o.token != p.token for p in out)]
    return out


class Perceptron:
    """Averaged perceptron over string features; the weights are those of all steps on average."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w: dict[str, float] = weights or {}
        self._sum: dict[str, float] = defaultdict(float)
        self._at: dict[str, int] = defaultdict(int)
        self._step = 0

    def score(self, features: list[str]) -> float:
        w = self.w
        return sum(w.get(f, 0.0) for f in features)

    def step(self) -> None:
        self._step += 1

    def add(self, features: list[str], by: float) -> None:
        for f in features:
            self._sum[f] += (self._step - self._at[f]) * self.w.get(f, 0.0)
            self._at[f] = self._step
            self.w[f] = self.w.get(f, 0.0) + by

    def average(self) -> "Perceptron":
        n = max(1, self._step)
        return Perceptron({f: (self._sum[f] + (self._step - self._at[f]) * v) / n for f, v in self.w.items()})


def _bucket(x: float) -> int:
    return int(max(-12, min(16, round(x))))


def _class(c: str) -> str:
    return "edge" if not c else "9" if c.isdigit() else "A" if c.isupper() else "v" if c in "aeiou" else "a" if c.islower() else c


def keep_features(token: str, n: int) -> list[str]:
    """What speaks for keeping every character: the shape of the token and how often it is seen."""
    kind = "digit" if any(c.isdigit() for c in token) else "bar" if "|" in token else "alpha"
    inside = kind == "digit" and any(c.isalpha() for c in token) and not _NUMBER.fullmatch(token)
    b = _bucket(math.log2(1 + n))
    return [f"keep {kind}", f"keep {kind} n{b}", f"keep mixed {inside} bar {'|' in token}", f"keep mixed {inside} n{b}", f"keep title {token[:1].isupper()} n{min(b, 4)}", f"keep len {min(len(token), 6)}"]


def edit_features(token: str, n: int, option: Option, known: frozenset) -> list[str]:
    """The characters an option changes, each with its neighbours and the token's shape, and what the lexicon says of the result."""
    own, other = math.log2(1 + n), math.log2(1 + option.count)
    d = _bucket(other - own)
    kind = "digit" if any(c.isdigit() or c == "|" for c in token) else "alpha"
    number = bool(_NUMBER.fullmatch(option.token)) and any(c.isdigit() for c in option.token)
    learnt = all((e.read.lower(), e.put.lower()) in known or (e.kind == "delete" and e.at and token[e.at].lower() == token[e.at - 1].lower()) for e in option.edits)
    how = "digits" if number else "any" if not learnt else "two" if len(option.edits) > 1 else "delete" if option.edits[0].kind == "delete" else "one"
    rare = how in ("two", "delete", "any")
    out = ["edit", f"gain {d}", f"gain {kind} {d}", f"n {_bucket(other)}", f"op {how} gain {d}", f"own {kind} {_bucket(own)} {min(_bucket(other), 6)}", f"number {number}", f"len {rare} {min(len(token), 8)}", f"title {token[:1].isupper()} {d}", f"edits {how} own {_bucket(own)}"]
    if number:
        return [*out, "digits"]
    for e in option.edits:
        before, after = token[max(0, e.at - 1) : e.at], token[e.at + len(e.read) : e.at + len(e.read) + 1]
        out += [e.kind, f"{e.kind} {e.read}>{e.put}".lower(), f"{e.kind} between {_class(before)} {_class(after)}", f"{how} {e.kind} {'start' if not before else 'end' if not after else 'inside'}"]
    return out


class Editor:
    """Keeps, replaces, deletes or inserts the characters of tokens and joins words broken at line ends."""

    def __init__(self, lexicon: Lexicon, edits: Perceptron, joins: Perceptron, opens: Perceptron, confusions: tuple[tuple[str, str], ...] = CONFUSIONS):
        self.lexicon, self.edits, self.joins, self.opens, self.confusions = lexicon, edits, joins, opens, confusions
        self.known = frozenset((read.lower(), meant.lower()) for read, meant in confusions)
        self._intact: set[str] = set()
        self._fixed: dict[str, str] = {}
        self._scores: dict[tuple, float] = {}

    def choices(self, token: str, unlisted: bool = True) -> list[tuple[str, list[str]]]:
        """What may become of a token, and the features of each; the first is to keep it."""
        n = self.lexicon.get(key(token))
        return [(token, keep_features(token, n))] + [(o.token, edit_features(token, n, o, self.known)) for o in options(token, self.lexicon, self.confusions, unlisted)]

    def best(self, token: str, unlisted: bool = True) -> str:
        choices = self.choices(token, unlisted)
        scores = [self.edits.score(f) for _, f in choices]
        return choices[scores.index(max(scores))][0]

    def word(self, token: str) -> str:
        """The token as it was meant."""
        if token in self._intact:
            return token
        if (new := self._fixed.get(token)) is None:
            new = token
            if _ALPHA.search(token) or ("|" in token and _DIGIT.search(token)):
                new = self.best(token)
            if len(self._intact) + len(self._fixed) > 300_000:
                self._intact.clear()
                self._fixed.clear()
            if new == token:
                self._intact.add(token)
            else:
                self._fixed[token] = new
        return new

    def misread(self, text: str) -> dict[str, str]:
        """The tokens of a text that aren't kept, and what they were."""
        return {t: new for t in set(TOKEN.findall(text)) - self._intact if (new := self.word(t)) != t}

    def _ends(self, a: str, mark: str, b: str) -> tuple:
        """What the lexicon says of a line's end `a` and the start `b` of the next, in buckets."""
        lexicon = self.lexicon
        tail, head = a.rsplit("-", 1)[-1], b.split("-", 1)[0]
        na, nb = lexicon.get(key(tail)), lexicon.get(key(head))
        both = tail + head
        n = lexicon.get(key(both))
        if not n and (mark or min(na, nb) < SELDOM * lexicon.total):
            n = lexicon.get(key(self.best(both, unlisted=False)))
        inner = lexicon.get(f"{tail}-{head}".lower())
        compound = inner if a == tail and b == head else max(inner, lexicon.get(f"{a}-{b}".lower()))
        whole, la, lb, lc = (math.log2(1 + x) for x in (n, na, nb, compound))
        m = "none" if not mark else "hyphen" if mark == "-" else "soft"
        return m, _bucket(whole), _bucket(whole - min(la, lb)), _bucket(whole - max(la, lb)), _bucket(lc), _bucket(whole - lc), _bucket(la), _bucket(lb), head[:1].islower(), min(len(tail), len(head), 4)

    @staticmethod
    def join_features(ends: tuple) -> list[str]:
        m, whole, least, most, compound, over, a, b, lower, short = ends
        return [
            f"mark {m}", f"{m} whole {whole}", f"{m} over least {least}", f"{m} over most {most}", f"{m} compound {compound}", f"{m} whole-compound {over}", f"{m} a {a}", f"{m} b {b}", f"{m} lower {lower}", f"{m} short {short}",
        ]

    @staticmethod
    def open_features(ends: tuple) -> list[str]:
        """A word left open at a block's end is known by its mark and by what is no compound; the next block needn't go on with it."""
        m, _, _, _, compound, _, a, _, _, _ = ends
        return [f"mark {m}", f"{m} compound {min(compound, 1)}", f"{m} a {min(a, 1)}"]

    def _decided(self, model: Perceptron, features, ends: tuple) -> bool:
        at = (features, ends)
        if (score := self._scores.get(at)) is None:
            if len(self._scores) > 300_000:
                self._scores.clear()
            score = self._scores[at] = model.score(features(ends))
        return score > 0

    def left_open(self, a: str, mark: str, b: str) -> bool:
        """Whether a block that ends in `a` and a mark ends inside a word, whatever the next one starts with."""
        return bool(mark) and self._decided(self.opens, self.open_features, self._ends(a, mark, b))

    def joined(self, a: str, mark: str, b: str) -> bool:
        """Whether `a` at a line's end and `b` at the next one's start are one word."""
        return bool(a and b) and b[0].islower() and self._decided(self.joins, self.join_features, self._ends(a, mark, b))


LINE_END = re.compile(rf"([A-Za-z|0-9]+(?:-[A-Za-z|0-9]+)*)[ \t]?([{MARKS}]?)[ \t]*$")
LINE_START = re.compile(r"\s*([A-Za-z|0-9]+(?:-[A-Za-z|0-9]+)*)")


def line_end(line: str) -> re.Match | None:
    """The word, and the mark if any, that a line ends with."""
    n = len(line.rstrip(" \t"))
    return LINE_END.search(line, line.rfind(" ", 0, max(0, n - 2)) + 1)


def break_of(line: str) -> tuple[str, str] | None:
    """(word, mark) at the end of a line that could go on in the next."""
    if not (m := line_end(line)) or not _ALPHA.search(m.group(1)):
        return None
    if m.group(2) == "-" and m.start(2) and line[m.start(2) - 1].isspace():
        return None  # a dash
    return m.group(1), m.group(2)


def start_of(line: str) -> str:
    m = LINE_START.match(line)
    return m.group(1) if m and _ALPHA.search(m.group(1)) else ""


class Training(NamedTuple):
    """Bounds of the samples the models are fitted on.

    The most frequent keys (words), neighbouring words (ordinary), seldom seen words that nothing
    explains (rare), compounds, pairs of line ends (pairs), and seldom seen words in which confusions
    are sought that the fixed list lacks (observed).
    """

    words: int = 4000
    ordinary: int = 20_000
    epochs: int = 3
    seed: int = 5
    rare: int = 1500
    compounds: int = 2000
    pairs: int = 40_000
    observed: int = 1000


class Examples(NamedTuple):
    """Keys the editor is fitted on: frequent ones, the most frequent first; seldom seen words and compounds, each in order of hash."""

    frequent: list[str]
    rare: list[str]
    compounds: list[str]


def noisy(word: str, confusions: tuple[tuple[str, str], ...], rng: np.random.Generator) -> str | None:
    """The word misread in one place, as a scanner would; now and then in a way that is on no list."""
    style = rng.random()
    if style < 0.04:
        at = int(rng.integers(1, len(word)))
        return word[:at] + word[at - 1] + word[at:]
    if style < 0.12 and len(word) > 5:
        at, c = int(rng.integers(1, len(word))), str(rng.choice(list(_LETTERS)))
        return word[:at] + (c + word[at + 1 :] if style < 0.08 else word[at + 1 :] if style < 0.1 else c + word[at:])
    places = [(at, read, meant) for read, meant in confusions for at in range(len(word)) if word.startswith(meant, at)]
    if not places:
        return None
    at, read, meant = places[int(rng.integers(len(places)))]
    return word[:at] + read + word[at + len(meant) :]


def observed_confusions(words: list[str], lexicon: Lexicon, t: Training) -> list[tuple[str, str]]:
    """Confusions the corpus shows: single edits that, more than once, turn a seldom seen word into one at least a hundred times as frequent."""
    seen: dict[tuple[str, str], set[str]] = defaultdict(set)
    for w in words[: t.observed]:
        for o in options(w, lexicon, ()) if len(w) > 5 else ():
            e = o.edits[0]
            if len(o.edits) == 1 and e.read and e.put and o.count >= 100 * max(1, lexicon.get(w)):
                seen[(e.read, e.put)].add(o.token)
    fixed = set(CONFUSIONS)
    return sorted(c for c, results in seen.items() if len(results) > 2 and c not in fixed)


def neighbours(line: str) -> list[tuple[str, str]]:
    """The words of a line that stand side by side, the second in small letters: as line ends that break no word would look."""
    spans = [(m.group(), m.end()) for m in re.finditer(r"[A-Za-z]+(?:-[A-Za-z]+)*", line)]
    return [(a, b) for (a, end), (b, _) in zip(spans, spans[1:]) if b[0].islower() and line[end : end + 1] == " " and line.startswith(b, end + 1)]


def train_editor(lexicon: Lexicon, known: Examples, ordinary: list[tuple[str, str]], t: Training = Training()) -> Editor:
    """Fits the models on frequent words misread or broken artificially, and on words and line ends as they are.

    A frequent word that is one confusion away from one twenty times as frequent is itself likely misread
    and no example.
    """
    count = lexicon.get
    rng = np.random.default_rng(t.seed)
    confusions = CONFUSIONS + tuple(observed_confusions(known.rare, lexicon, t))
    editor = Editor(lexicon, Perceptron(), Perceptron(), Perceptron(), confusions)
    clean = [w for w in known.frequent[: t.words] if all(o.count < 20 * count(w) for o in _seen(w, [(e,) for e in _known_edits(w, confusions)], lexicon, count(w)))]
    examples: list[tuple[str, str]] = []
    pretended: dict[str, int] = {}
    for w in clean:
        if any(c.isdigit() for c in w):
            if not _NUMBER.fullmatch(w):
                continue  # as likely a misread word as a code
            real = "".join(str(rng.integers(10)) if c == "9" else c for c in w)
            examples.append((real, real))
            swaps = [(i, x) for i, c in enumerate(real) for x, y in (("O", "0"), ("l", "1"), ("B", "8"), ("S", "5"), ("I", "1")) if c == y]
            if swaps and len(real) > 1:
                i, x = swaps[int(rng.integers(len(swaps)))]
                examples.append((real[:i] + x + real[i + 1 :], real))
            continue
        if len(w) < 2 or not w.isalpha():
            continue
        form = w.capitalize() if rng.random() < 0.15 else w
        examples += [(form, form)] * max(1, round(math.log2(1e4 * count(w) / lexicon.total)) if count(w) > 1e-4 * lexicon.total else 1)
        for twice in (False, False, True):
            bad = noisy(form, confusions, rng) if len(w) > 2 else None
            if bad and twice:
                bad = form.replace("ll", str(rng.choice(["II", "11", "1l"])), 1) if "ll" in form else noisy(bad, confusions, rng) if rng.random() < 0.4 else None
            if bad and bad != form and count(key(bad)) * 4 < count(w):
                examples.append((bad, form))
                # The same misreading may occur again and again in a corpus.
                if not count(key(bad)) and (again := int(count(w) * float(rng.choice([0, 0.002, 0.01, 0.02])))):
                    pretended[key(bad)] = again
    # Seldom seen words that no known confusion explains are intact: names and terms.
    rare = [w for w in known.rare if not _seen(w, [(e,) for e in _known_edits(w, confusions)], lexicon, count(w))][: t.rare]
    examples += [(w, w) for w in rare] + [(w.capitalize(), w.capitalize()) for w in rare[::2]]
    lexicon.added = pretended
    choices = [editor.choices(token) for token, _ in examples]
    p = editor.edits
    for _ in range(t.epochs):
        for i in rng.permutation(len(examples)):
            truth = next((f for new, f in choices[i] if new == examples[i][1]), None)
            p.step()
            scores = [p.score(f) for _, f in choices[i]]
            got = choices[i][scores.index(max(scores))]
            if truth is not None and got[0] != examples[i][1]:
                p.add(truth, 1.0)
                p.add(got[1], -1.0)
    lexicon.added = {}
    editor = Editor(lexicon, p.average(), Perceptron(), Perceptron(), confusions)

    pairs: list[tuple[str, str, str, bool]] = []
    words = [w for w in clean if w.isalpha() and len(w) >= 4 and count(w) > 1]
    heads = words or [""]
    ends: list[tuple[str, str, str, bool]] = []
    for w in words:
        for _ in range(2):
            at = int(rng.integers(2, len(w) - 1)) if len(w) > 3 else 2
            mark = str(rng.choice(["", "", "-", "-", "¬", "­", "‐"]))
            pairs.append((w[:at], mark, w[at:], True))
            if mark:
                ends.append((w[:at], mark, str(rng.choice([heads[int(rng.integers(len(heads)))], ""])), True))
    for k in known.compounds[: t.compounds]:
        parts = k.split("-")
        for i in range(1, len(parts)):
            for mark in ("-", "-", "‐"):
                pairs.append(("-".join(parts[:i]), mark, "-".join(parts[i:]), False))
                ends.append(pairs[-1])
    pairs += [(a, "", b, False) for a, b in ordinary[: t.ordinary]]
    for model, features, sample in ((editor.joins, editor.join_features, pairs), (editor.opens, editor.open_features, ends)):
        cached = [(features(editor._ends(a, m, b)), 1 if y else -1) for a, m, b, y in (sample[i] for i in rng.permutation(len(sample))[: t.pairs])]
        for _ in range(t.epochs):
            for i in rng.permutation(len(cached)):
                f, y = cached[i]
                model.step()
                if model.score(f) * y <= 0:
                    model.add(f, float(y))
    return Editor(lexicon, editor.edits, editor.joins.average(), editor.opens.average(), confusions)


FURNITURE = frozenset(("page", "pg", "p", "annual", "report"))
_ROMAN = re.compile(r"[ivxlc]{1,6}", re.I)
_PLAIN = re.compile(r"[\W_]*(?:page|pg\.?|p\.)?[\W_]*[\dOolI|]{1,4}[\W_]*(?:(?:of|/)[\W_]*[\dOolI|]{1,4}[\W_]*)?", re.I)
_VALUE = re.compile(r"[₹$€]?\s*\d[\d,.]*\s*%?\s+[a-z]")


class Form(NamedTuple):
    """What a line is like by itself."""

    form: str  # number, roman, capital roman, caps, title or text
    words: int
    stop: bool
    comma: bool
    report: bool
    lower: bool
    upper: bool
    value: bool
    cells: int
    last: str  # the last word of a line of few words, without case

    @property
    def text(self) -> str:
        f = self
        return f"{f.form}|{f.words}|{f.stop:d}|{f.comma:d}|{f.report:d}|{f.lower:d}|{f.upper:d}|{f.value:d}|{f.cells}|{f.last}"

    @classmethod
    def from_text(cls, text: str) -> "Form":
        form, words, *flags, cells, last = text.split("|")
        return cls(form, int(words), *(f == "1" for f in flags), int(cells), last)


def form_of(line: str) -> Form:
    bare = line.strip()
    words = bare.split()
    if len(words) > 9:
        return Form("caps" if bare.isupper() else "text", 10, bare[-1] == ".", bare[-1] == ",", False, bare[0].islower(), bare[0].isupper(), bool(_VALUE.match(bare)), min(bare.count(" | "), 3), "")
    plain = bool(_PLAIN.fullmatch(bare)) and any(c.isdigit() for c in bare)
    roman = not plain and len(words) == 1 and bool(_ROMAN.fullmatch(bare))
    if plain:
        form = "number"
    elif roman:
        form = "roman" if bare.islower() else "capital roman"
    else:
        form = "caps" if bare.isupper() else "title" if all([w[:1].isupper() or not w[:1].isalpha() for w in words]) else "text"
    last = _ALPHA.findall(bare)[-1:]
    report = not FURNITURE.isdisjoint([w.strip(".,|") for w in bare.lower().split()])
    return Form(form, len(words), bare.endswith("."), bare.endswith(","), report, bare[:1].islower(), bare[:1].isupper(), bool(_VALUE.match(bare)), min(bare.count(" | "), 3), "".join(last).lower())


class Line(NamedTuple):
    """A line's form, on how many pages of its document and in how many documents its skeleton stands, and where on the page."""

    form: str
    pages: int
    docs: int
    place: str
    whole: bool
    edge: bool
    heading: bool
    table: bool
    running: int
    alone: bool


def line_features(line: Line) -> list[str]:
    f = Form.from_text(line.form)
    often = "many" if line.pages >= 4 else str(line.pages)
    common = "many" if line.docs >= 5 else "few" if line.docs > 1 else "one"
    return [
        "line", f"form {f.form}", f"often {often}", f"form {f.form} often {often}", f"place {line.place}", f"form {f.form} place {line.place}", f"whole {line.whole} form {f.form}", f"edge {line.edge} form {f.form}", f"heading {line.heading}", f"heading {line.heading} often {often}",
        f"words {min(f.words, 8)}", f"stop {f.stop}", f"common {common} often {often}", f"form {f.form} common {common}", f"report {f.report}", f"lower {f.lower}",
        f"form {f.form} report {f.report} cells {f.cells}", f"form {f.form} stop {f.stop} words {min(f.words, 8)}", f"report {f.report} often {often}", f"alone {line.alone} often {often} whole {line.whole}", f"alone {line.alone} form {f.form}", f"form {f.form} common {common} often {often}", f"form {f.form} last {f.last}", f"last {f.last} lower {f.lower}", f"running {min(line.running, 2)} heading {line.heading}", f"running {min(line.running, 2)} often {often}", f"value {f.value}", f"table {line.table}", f"table {line.table} cells {f.cells}",
    ]


def train_furniture(lines: list[Line], t: Training = Training()) -> Perceptron:
    """Fits the furniture model on lines whose kind their repetition or form makes plain.

    Short lines on three pages or more of one document, or of two others, or at the edge of two pages of
    one document only, that are no headings, and page numbers, are furniture; long lines, headings, rows of tables and lines of running text are not;
    others are no examples.
    """
    rng = np.random.default_rng(t.seed)
    examples = []
    for line in lines:
        f = Form.from_text(line.form)
        if (line.table and f.cells) or f.value:
            examples.append((line_features(line), -1))
        elif f.form == "number" or f.form == "roman" or (f.form == "capital roman" and line.whole) or ((line.pages >= 3 or line.running >= 2 or (line.pages == 2 and line.docs == 1 and line.place in ("top", "bottom"))) and f.words <= 9 and not line.heading and not f.stop and f.upper):
            examples.append((line_features(line), 1))
        elif line.heading or f.words > 9 or f.stop or f.comma or f.lower:
            examples.append((line_features(line), -1))
    p = Perceptron()
    for _ in range(2 * t.epochs):
        for i in rng.permutation(len(examples)):
            features, y = examples[i]
            p.step()
            if p.score(features) * y <= 1:
                p.add(features, float(y))
    return p.average()
