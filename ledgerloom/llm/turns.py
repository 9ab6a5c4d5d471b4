"""Problem 2: transcripts into clean, ordered turns of one person each."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import stored

# Hesitations, sound annotations, titles, words of continuation and names of the moderator's part.
HESITATIONS = ("um", "umm", "ummm", "uh", "uhh", "uhm", "er", "err", "erm", "ah", "ahh", "hm", "hmm", "hmmm", "mm", "mhm", "eh")
PHRASES = ("i mean", "sort of", "kind of", "you know")
ANNOTATIONS = (
    "laughter", "laughs", "laughing", "applause", "crosstalk", "cross talk", "inaudible", "indiscernible", "unintelligible", "background noise", "noise", "music", "pause", "silence",
    "coughs", "coughing", "cough", "sighs", "phone rings", "phone ringing", "technical difficulty", "technical difficulties", "audio gap", "overlapping speech", "foreign language", "break",
)
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "shri", "smt", "madam")
CONTINUED = ("continued", "contd", "cont", "continues", "continuing")
MODERATORS = ("moderator", "operator", "conference moderator", "conference operator", "coordinator")
#: Kept where they follow or precede these words: context that makes a phrase speech.
NOT_AFTER = {"sort of": ("a", "what", "this", "that", "some", "any", "the"), "kind of": ("a", "what", "this", "that", "some", "any", "the"), "you know": ("do", "as", "if", "did"), "i mean": ("what",)}
NOT_BEFORE = {"you know": ("that", "what", "how", "why", "who", "where", "when")}
DOUBLED = ("that", "had")

TIME = re.compile(r"\[\s*\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*\]|\(\s*\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*\)|<\s*\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\s*>|\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b|\b\d{1,3}m\d{2}s\b")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+", re.U)
_LETTERS = re.compile(r"[^\W\d_]+", re.U)
_LABEL = re.compile(r"^[ \t]*([^:\n]+?(?:\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?[^:\n]+?)?)[ \t]*:(?=\s|$)", re.M)
_OPEN, _CLOSE = "[(<*{", "])>*}"


def _clutter() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("hesitation", HESITATIONS), ("phrase", PHRASES), ("annotation", ANNOTATIONS)):
        for w in words:
            a.add_word(w, (kind, w))
    a.make_automaton()
    return a


CLUTTER = _clutter()


def _intervals(text: str) -> list[tuple[int, int]]:
    """The parts of a text that are times, annotations, hesitations and stuttered words."""
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer would shift places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = [m.span() for m in TIME.finditer(text)]
    for last, (kind, word) in CLUTTER.iter(low):
        start, end = last - len(word) + 1, last + 1
        if (start and (low[start - 1].isalnum() or low[start - 1] in "'-")) or (end < len(low) and (low[end].isalnum() or low[end] in "'-")):
            continue
        if kind == "annotation":
            a, b = start - 1, end
            while a >= 0 and low[a] == " ":
                a -= 1
            while b < len(low) and low[b] == " ":
                b += 1
            if a >= 0 and b < len(low) and low[a] in _OPEN and low[b] == _CLOSE[_OPEN.index(low[a])]:
                found.append((a, b + 1))
            continue
        if kind == "phrase":
            before = _LETTERS.findall(low[max(0, start - 20) : start])
            after = _LETTERS.match(low[end:].lstrip())
            if (before and before[-1] in NOT_AFTER.get(word, ())) or (after and after.group() in NOT_BEFORE.get(word, ())):
                continue
        while end < len(low) and low[end] in ".,…" and not (low[end] == "." and low[end + 1 : end + 2].isdigit()):
            end += 1
        found.append((start, end))
    return found


def _subtract(text: str, intervals: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(intervals):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    return " ".join(out)


_SPACES = re.compile(r"\s+")
_LOOSE = re.compile(r"\s+([,.;:?!।])")
_STUTTER = re.compile(r"\b([^\W\d_]+)((?:\s+\1\b)+)", re.I)


def clean(text: str) -> str:
    """The text without times, annotations, hesitations and stutters, in single spaces; "" if nothing is said."""
    kept = _subtract(text, _intervals(text))
    kept = _STUTTER.sub(lambda m: m.group() if m.group(1).lower() in DOUBLED else m.group(1), kept)
    kept = _LOOSE.sub(r"\1", _SPACES.sub(" ", kept)).strip().lstrip(",;. ")
    return kept if any(c.isalnum() for c in kept) else ""


class Person(NamedTuple):
    pid: int
    first: str
    last: str
    role: str
    designation: tuple[str, ...]
    firm: tuple[str, ...]


def _tokens(text: str | None) -> tuple[str, ...]:
    return tuple(w.lower() for w in _WORDS.findall(text or ""))


def near(a: str, b: str) -> int:
    """Edits between two words, 3 if more than 2; a swap of neighbours is one edit."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > 2:
            return 3
        before, row = row, new
    return min(3, row[-1])


class Call:
    """The people of one call and an automaton over the forms in which a label may name them."""

    def __init__(self, people: tuple[tuple, ...]):
        self.people = []
        for pid, name, role, designation, firm in people:
            words = _tokens(name)
            if words and words[0] in TITLES:
                words = words[1:]
            self.people.append(Person(pid, words[0] if words else "", words[-1] if words else "", (role or "").strip().lower(), _tokens(designation), _tokens(firm)))
        forms: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for k, p in enumerate(self.people):
            if p.last:
                forms[f" {p.last} "].append(("last", k))
            if p.first and p.first != p.last:
                forms[f" {p.first} "].append(("first", k))
            for words in {p.designation, tuple(w for w in p.designation if w not in ("of", "officer", "and")), tuple(w for w in reversed(p.designation) if w not in ("of", "officer"))}:
                if words:
                    forms[f" {' '.join(words)} "].append(("designation", k))
            initials = "".join(w[0] for w in p.designation if w not in ("of", "and"))
            if len(initials) > 1:
                forms[f" {initials} "].append(("designation", k))
            if p.firm:
                forms[f" {' '.join(p.firm)} "].append(("firm", k))
            if p.role == "moderator":
                for word in MODERATORS:
                    forms[f" {word} "].append(("designation", k))
        self.automaton = ahocorasick.Automaton()
        for form, uses in forms.items():
            self.automaton.add_word(form, (len(form), tuple(uses)))
        if forms:
            self.automaton.make_automaton()
        self.resolve = lru_cache(4096)(self._resolve)

    def _resolve(self, label: str, strict: bool) -> int | None:
        """The person a label names. Strict: only if every word of the label is part of naming someone."""
        words = [w for w in _tokens(TIME.sub(" ", label)) if w not in TITLES and w not in CONTINUED]
        if not words or not self.people:
            return None
        text = " " + "  ".join(words) + " "  # every word has its own spaces, so neighbouring forms don't share one
        single = " " + " ".join(words) + " "
        explained: set[int] = set()
        starts, at = {}, 1
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w) + 1
        score = [0.0] * len(self.people)
        named = [0.0] * len(self.people)
        hits: dict[int, set[str]] = defaultdict(set)
        for source in (single, text):
            for last, (size, uses) in self.automaton.iter(source):
                body = source[last - size + 2 : last].split(" ")
                if source is single:
                    i = starts.get(last - size + 2)
                    if i is None:
                        continue
                    explained.update(range(i, i + len(body)))
                elif len(body) == 1:
                    explained.update(i for i, w in enumerate(words) if w == body[0])
                for kind, k in uses:
                    hits[k].add(kind)
        rest = [w for i, w in enumerate(words) if i not in explained]
        if strict:
            for w in rest:
                close = any(near(w, n) <= (2 if len(n) >= 8 else 1) for p in self.people for n in (p.first, p.last) if len(n) > 3 and len(w) > 3)
                known = any(w in p.designation or w in p.firm for p in self.people)
                if not (close or known or (len(w) == 1 and any(p.first.startswith(w) for p in self.people))):
                    return None
        for k, p in enumerate(self.people):
            for kind, weight in (("last", 2.0), ("first", 1.5)):
                if kind in hits[k]:
                    named[k] += weight
                    continue
                name = p.last if kind == "last" else p.first
                best = min((near(w, name) for w in rest if len(w) > 3), default=3) if len(name) > 3 else 3
                if best < 3 and (best == 1 or len(name) >= 8):
                    named[k] += weight * (0.8 if best == 1 else 0.6)
                elif kind == "first" and named[k] and any(len(w) == 1 and name.startswith(w) for w in words):
                    named[k] += 0.5
            score[k] = named[k] + (0.4 if "designation" in hits[k] else 0.0) + (0.3 if "firm" in hits[k] else 0.0)
        return self._best(named, score) if any(named) else self._best([1.0 if s else 0.0 for s in score], score)

    def _best(self, named: list[float], score: list[float]) -> int | None:
        """The pid of the highest score; none if two people share it."""
        pool = [k for k, n in enumerate(named) if n]
        if not pool:
            return None
        top = max(score[k] for k in pool)
        winners = {self.people[k].pid for k in pool if score[k] > top - 1e-9}
        return winners.pop() if len(winners) == 1 else None

    def listed(self, names: str) -> list[int]:
        """The people a free-form list names, in order: items end at ; / & "and" and at commas, unless a comma only inverts a name."""
        out: list[int] = []
        for part in re.split(r"[;/&|\n]|\band\b", names):
            pieces = [x for x in part.split(",") if x.strip()]
            i = 0
            while i < len(pieces):
                pair = f"{pieces[i]} {pieces[i + 1]}" if i + 1 < len(pieces) else ""
                if pair and len(_tokens(pieces[i])) == 1 and len(_tokens(pieces[i + 1])) == 1 and (both := self.resolve(pair, True)) is not None and self.resolve(pieces[i], False) == self.resolve(pieces[i + 1], False):
                    out.append(both)
                    i += 2
                    continue
                if (one := self.resolve(pieces[i], False)) is not None:
                    out.append(one)
                i += 1
        return list(dict.fromkeys(out))

    def segments(self, speaker: str | None, text: str) -> list[tuple[int | None, str]]:
        """A block's spoken parts in order: (person or None where it has no label, clean text)."""
        label = None
        if speaker and speaker.strip():
            label = self.resolve(speaker, False)
            label = -1 if label is None else label
        cuts: list[tuple[int, int, int | None]] = [(0, 0, label)]
        for m in _LABEL.finditer(text):
            if (who := self.resolve(m.group(1), True)) is not None:
                cuts.append((m.start(), m.end(), who))
        ends = [c[0] for c in cuts[1:]] + [len(text)]
        return [(who, said) for (_, start, who), end in zip(cuts, ends) if (said := clean(text[start:end]))]


_PEOPLE = T.ArrayType(
    T.StructType([T.StructField("pid", T.LongType()), T.StructField("name", T.StringType()), T.StructField("role", T.StringType()), T.StructField("designation", T.StringType()), T.StructField("firm", T.StringType())])
)


@lru_cache(256)
def _call(people: tuple[tuple, ...]) -> Call:
    return Call(people)


def _of(people) -> Call:
    return _call(tuple((p["pid"], p["name"], p["role"], p["designation"], p["firm"]) for p in people) if people is not None else ())


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("pid", T.LongType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_SEGMENTS)
def _segments(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for speakers, texts, people in batches:
        yield pd.Series([_of(p).segments(s, t) for s, t, p in zip(speakers, texts, people)], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _listed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for speakers, people in batches:
        yield pd.Series([_of(p).listed(s) for s, p in zip(speakers, people)], dtype=object)


def people_of_calls(participants: DataFrame) -> DataFrame:
    """doc_id and the list of its people, which is as long as a call has people."""
    one = participants.select("doc_id", F.struct(F.col("participant_id").cast("bigint").alias("pid"), F.col("full_name").alias("name"), "role", "designation", "firm").alias("p"))
    return one.where(F.col("doc_id").isNotNull() & F.col("p.pid").isNotNull() & F.col("p.name").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set("p")).alias("people"))


STRETCH = 4096


def spoken(page_blocks: DataFrame, participants: DataFrame) -> DataFrame:
    """Everything said, in parts: doc_id, block_index, part, pid (NULL without a label, -1 for someone unknown), text.

    Repeated rows count once; of different rows with one (doc_id, block_index) the one with the least text and speaker holds.
    """
    own = page_blocks.select("doc_id", "block_index", F.lower(F.trim("doc_type")).alias("doc_type"), F.lower(F.trim("block_type")).alias("block_type"), "text", "speaker")
    own = own.where((F.col("doc_type") == "concall") & (F.coalesce("block_type", F.lit("")) != "section_header") & F.col("doc_id").isNotNull() & F.col("block_index").isNotNull() & F.col("text").isNotNull())
    blocks = own.groupBy("doc_id", "block_index").agg(F.min(F.struct("text", "speaker")).alias("b")).select("doc_id", "block_index", "b.*")
    parts = blocks.join(people_of_calls(participants), "doc_id", "left").select("doc_id", "block_index", F.posexplode(_segments("speaker", "text", "people")).alias("part", "s"))
    return parts.select("doc_id", "block_index", "part", "s.pid", "s.text")


def turns(page_blocks: DataFrame, participants: DataFrame, with_text: bool = True) -> DataFrame:
    """Every part said with its turn: doc_id, block_index, part, text, pid, starts, turn (block and part where it began).

    A part without a label goes on with the person before; parts with no words but hesitations and
    annotations are nobody's, so they neither make nor end a turn; a person's parts in a row are one
    turn. Parts before the first label have no person.

    The label before a part is carried forward in two steps, within stretches of STRETCH blocks and
    over the stretches' last labels, so that a call of any length is never one task's group. Blocks are
    matched once; their parts are written to the shared folder and read for both steps.
    """
    said = spoken(page_blocks, participants)
    parts = stored(said if with_text else said.drop("text")).withColumn("stretch", F.expr(f"block_index div {STRETCH}"))
    place = F.struct("block_index", "part")
    ends = parts.where(F.col("pid").isNotNull()).groupBy("doc_id", "stretch").agg(F.max_by("pid", place).alias("last_pid"))
    later = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    into = parts.select("doc_id", "stretch").distinct().join(ends, ["doc_id", "stretch"], "left").withColumn("carried", F.last("last_pid", ignorenulls=True).over(later)).select("doc_id", "stretch", "carried")
    w = Window.partitionBy("doc_id", "stretch").orderBy("block_index", "part")
    before = F.coalesce(F.last("pid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    now = F.coalesce("pid", "before")
    return (
        parts.join(into, ["doc_id", "stretch"]).withColumn("before", before).withColumn("person", now)
        .withColumn("starts", F.col("person").isNotNull() & ~F.col("person").eqNullSafe(F.col("before")))
        .select("doc_id", "stretch", "block_index", "part", *(["text"] if with_text else []), F.col("person").alias("pid"), "starts")
    )


def clean_turns(page_blocks: DataFrame, participants: DataFrame) -> DataFrame:
    """One row per turn: doc_id, turn_start (block_index), part, participant_id, blocks, text in order.

    What someone says who isn't among the participants, and what comes before the first label, are turns
    too, with a NULL participant_id, so that no speech is lost.
    """
    said = turns(page_blocks, participants)
    start = F.when(F.col("starts"), F.struct("block_index", "part"))
    within = said.groupBy("doc_id", "stretch").agg(F.max(start).alias("last_start"))
    later = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    into = within.withColumn("carried_start", F.last("last_start", ignorenulls=True).over(later)).select("doc_id", "stretch", "carried_start")
    w = Window.partitionBy("doc_id", "stretch").orderBy("block_index", "part").rowsBetween(Window.unboundedPreceding, 0)
    placed = said.join(into, ["doc_id", "stretch"]).withColumn("turn", F.coalesce(F.last(start, ignorenulls=True).over(w), F.col("carried_start")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "part", "text"))), lambda x: x["text"]), " ")
    whole = placed.groupBy("doc_id", "turn", "pid").agg(text.alias("text"), F.countDistinct("block_index").alias("blocks"), F.min(F.struct("block_index", "part")).alias("first"))
    began = F.coalesce("turn", "first")
    return whole.select("doc_id", began["block_index"].alias("turn_start"), began["part"].alias("part"), F.when(F.col("pid") >= 0, F.col("pid")).alias("participant_id"), "blocks", "text")


def named_people(page_blocks: DataFrame, chunks: DataFrame, participants: DataFrame) -> DataFrame:
    """source_table, doc_id, item_no, participant_id: a row per turn of page_blocks and per person in chunks.speaker.

    Labels are matched without case, titles, times and words of continuation, as first and last name in
    either order, initial and last name, last name, part of the office or firm, and with up to two
    letters wrong; a label that fits two people of a call equally names nobody. NULL texts, speakers,
    documents and places, and documents without participants, give no rows; repeated rows count once.
    """
    began = turns(page_blocks, participants, with_text=False).where(F.col("starts") & (F.col("pid") >= 0)).select(F.lit("page_blocks").alias("source_table"), "doc_id", F.col("block_index").alias("item_no"), F.col("pid").alias("participant_id"))
    lists = chunks.select("doc_id", "chunk_index", "speaker").where(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull() & (F.trim("speaker") != "")).distinct()
    listed = lists.join(people_of_calls(participants), "doc_id").select(F.lit("chunks").alias("source_table"), "doc_id", F.col("chunk_index").alias("item_no"), F.explode(_listed("speaker", "people")).alias("participant_id"))
    return began.unionByName(listed).distinct()
