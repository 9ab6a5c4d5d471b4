"""Problem 3: items over a size limit, cut at natural boundaries with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.whitespace import WORD, word_count

#: Ranks of the boundary before a word; a node of the tree is split at the highest rank inside it. Items and
#: sections have a rank for every depth: the deeper, the lower.
WORDS, CLAUSE, SENTENCE, LINE, ITEM, BLOCK, SECTION = 1, 2, 3, 4, 10, 11, 20
DEPTHS = 6

_SENTENCE_END = re.compile(r"[.!?।॥…][\"'”’)\]]*$")
_CLAUSE_END = re.compile(r"[,;:–—][\"'”’)\]]*$|^[-–—|]$")
_ABBREVIATION = re.compile(r"^(?:rs|no|nos|mr|mrs|ms|dr|st|vs|viz|approx|fig|ltd|inc|co|e\.g|i\.e|[a-z])\.$", re.I)
_ITEM = re.compile(r"\s*(?:[-*•‣◦]|\(?[0-9]{1,3}[.)]|\(?[a-z][.)])\s+\S", re.I)
_TURN = re.compile(r"\s*[^\s:][^:\n]{0,60}(?:\[[^\]\n]{1,30}\])?\s*:\s+\S")
_MARKDOWN = re.compile(r"\s*#{1,6}\s+\S")


_NUMBERED = re.compile(r"\s*(\d{1,3}(?:\.\d{1,3})*)\.?\s+[^\W\d_]")


def heading_depth(line: str) -> int | None:
    """The depth of a heading from 1, None for other lines.

    Headings are lines of Markdown (depth by its marks), header lines in square brackets, short lines in
    capitals, and short numbered titles without a full stop ("2.1 Credit risk", depth by the number's parts).
    """
    bare = line.strip()
    if m := _MARKDOWN.match(line):
        return min(DEPTHS, m.group().count("#"))
    if bare.startswith("[") and bare.endswith("]"):
        return 1
    letters = [c for c in bare if c.isalpha()]
    if len(bare) > 80 or len(letters) < 3 or "|" in bare or bare.endswith((".", ",", ";", ":")):
        return None
    if all(c.isupper() for c in letters):
        return 1
    if (m := _NUMBERED.match(line)) and "." in m.group(1) and len(bare.split()) <= 8:
        return min(DEPTHS, m.group(1).count(".") + 1)
    return None


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """The words of a text as (start, end) and the rank of the boundary before each (the first has 0)."""
    spans: list[tuple[int, int]] = []
    ranks: list[int] = []
    blank, after_heading, kind = False, False, ""
    indents: list[int] = []  # of the items that are open, outermost first
    at = 0
    for line in text.split("\n"):
        found = [(at + m.start(), at + m.end()) for m in WORD.finditer(line)]
        at += len(line) + 1
        if not found:
            blank = True
            continue
        depth = heading_depth(line)
        heading = depth is not None
        new = "heading" if heading else "row" if "|" in line else "item" if _ITEM.match(line) else "turn" if _TURN.match(line) else "text"
        if new == "item":
            indent = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
            while indents and indents[-1] >= indent:
                indents.pop()
            indents.append(indent)
        elif heading or blank:
            indents = []
        if heading and not after_heading:
            rank = SECTION - depth
        elif after_heading:
            rank = LINE
        elif blank or (new == "turn"):
            rank = BLOCK
        elif new == "item":
            rank = max(LINE + 1, ITEM - len(indents) + 1)
        elif new != kind and "row" in (new, kind):
            rank = ITEM
        else:
            rank = LINE
        for k, (start, end) in enumerate(found):
            if k:
                before = text[spans[-1][0] : spans[-1][1]]
                rank = WORDS
                if _SENTENCE_END.search(before) and not _ABBREVIATION.match(before):
                    rank = SENTENCE
                elif _CLAUSE_END.search(before):
                    rank = CLAUSE
            ranks.append(rank if spans else 0)
            spans.append((start, end))
        blank, after_heading, kind = False, heading, new
    return spans, ranks


def _room(lo: int, cap: int, first: int) -> int:
    """How many words a piece that starts at word `lo` may have of its own: the first repeats nothing."""
    return first if lo == 0 else cap


def _merge(units: list[tuple[int, int]], cap: int, first: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in units:
        if out and hi - out[-1][0] <= _room(out[-1][0], cap, first):
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def pack(ranks: list[int], lo: int, hi: int, cap: int, first: int | None = None) -> list[tuple[int, int]]:
    """Packs the subtree over words lo..hi into units of at most `cap` words, the one that starts the text of at most `first`.

    A subtree within the cap is one unit. An oversized one is split into its children, at the highest
    rank inside it; they are packed first, then neighbouring units are merged up to the cap. A node
    without inner boundaries is cut into even runs of words.
    """
    first = cap if first is None else first
    if hi - lo <= _room(lo, cap, first):
        return [(lo, hi)]
    rank = max(ranks[lo + 1 : hi])
    if rank == WORDS:
        n = -(-(hi - lo) // cap)
        edges = [lo + (hi - lo) * k // n for k in range(n + 1)]
        return list(zip(edges, edges[1:]))
    cuts = [lo, *(i for i in range(lo + 1, hi) if ranks[i] == rank), hi]
    return _merge([unit for a, b in zip(cuts, cuts[1:]) for unit in pack(ranks, a, b, cap, first)], cap, first)


def pieces(text: str, max_words: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first word, end word, start, end) of each piece; every piece but the first repeats `overlap` words."""
    spans, ranks = boundaries(text)
    if len(spans) <= max_words:
        return [(0, len(spans), 0, len(text))]
    overlap = max(0, min(overlap, max_words - 1))
    out: list[tuple[int, int, int, int]] = []
    for lo, hi in pack(ranks, 0, len(spans), max_words - overlap, max_words):
        first = max(lo - overlap, out[-1][0]) if out else 0
        out.append((first, hi, spans[first][0], spans[hi - 1][1]))
    return out


_PIECE = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("word_count", T.IntegerType()),
        T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()),
    ]
)


def _pages(first: int, end: int, words: int, start: float | None, stop: float | None, weights: list[int] | None = None) -> tuple[int | None, int | None]:
    """Pages of a piece of words first..end.

    weights: the words that stand on each page from start to stop; the item's words are laid over them in
    proportion, so a sparse page has few. Without any, words are taken to be spread evenly.
    """
    if start is None or start != start:
        start = stop
    if stop is None or stop != stop:
        stop = start
    if start is None or start != start:
        return None, None
    start, stop = int(start), int(stop)
    n = max(1, stop - start + 1)
    if weights is None or len(weights) != n or not sum(weights):
        return start + first * n // words, start + max(first, end - 1) * n // words
    ends, total = list(accumulate(weights)), sum(weights)
    page = lambda word: start + min(n - 1, bisect_right(ends, word * total // words))
    return page(first), page(max(first, end - 1))


@F.pandas_udf(T.ArrayType(_PIECE))
def _cut(text: pd.Series, max_words: pd.Series, overlap: pd.Series, page_start: pd.Series, page_end: pd.Series, weights: pd.Series) -> pd.Series:
    out = []
    for t, m, o, a, b, w in zip(text, max_words, overlap, page_start, page_end, weights):
        cut = pieces(t, int(m), int(o))
        words = max(1, cut[-1][1])
        known = None if w is None else [int(x) for x in w]
        out.append([(k, t[start:end], last - first, *_pages(first, last, words, a, b, known)) for k, (first, last, start, end) in enumerate(cut)])
    return pd.Series(out, dtype=object)


def page_words(page_blocks: DataFrame) -> DataFrame:
    """doc_id, page and words: how many words stand on each page, every block counted once."""
    known = page_blocks.where(F.col("doc_id").isNotNull() & (F.col("page_num") > 0))
    one = known.groupBy("doc_id", "block_index").agg(F.min(F.struct("page_num", word_count("text").alias("words"))).alias("b"))
    return one.groupBy("doc_id", F.col("b.page_num").alias("page")).agg(F.sum("b.words").cast("int").alias("words"))


def split_oversized(chunks: DataFrame, limits: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The pieces of every row whose text has more than max_words of its (doc_type, chunk_type).

    Columns: chunk_id, piece_no (from 0), pieces, text, word_count, page_start, page_end. A piece has at
    most max_words words, starts with the last overlap_words words of the one before and ends at the
    highest natural boundary that packing allows (sections and list items by their depth, block, line,
    sentence, clause); where a text has none, between two words.

    pages: doc_id, page, words (`page_words`), by which a piece's pages are found; without them, or for
    rows of pages it doesn't have or of 10 000 pages and more, an item's words are taken to be spread evenly over its pages.

    Words are runs of non-space characters; the stored word_count isn't used. NULL and empty texts and
    kinds without a limit give no row; an overlap not below the limit counts as limit - 1; repeated rows
    count once (of different pieces of one chunk_id and number the least in text holds); NULL pages stay
    NULL; texts of any length are processed whole.

    The words are counted in the JVM and only oversized rows go to Python; limits is a small
    dimension table, joined without a hint. Only the pages of oversized rows are looked up.
    """
    rules = limits.select(F.lower(F.trim("doc_type")).alias("doc_type"), F.lower(F.trim("chunk_type")).alias("chunk_type"), "max_words", F.coalesce("overlap_words", F.lit(0)).alias("overlap_words")).where("max_words > 0").groupBy("doc_type", "chunk_type").agg(F.min("max_words").alias("max_words"), F.min("overlap_words").alias("overlap_words"))
    where = ["doc_id"] if pages is not None else []
    big = (
        chunks.select("chunk_id", *where, F.lower(F.trim("doc_type")).alias("doc_type"), F.lower(F.trim("chunk_type")).alias("chunk_type"), "text", "page_start", "page_end")
        .join(rules, ["doc_type", "chunk_type"])
        .where((F.length("text") > 2 * F.col("max_words")) & (word_count("text") > F.col("max_words")))
    )
    if pages is None:
        weighed = big.withColumn("weights", F.lit(None).cast("array<int>"))
    else:
        span = ["doc_id", "page_start", "page_end"]
        asked = big.where("page_end > page_start and page_end - page_start < 10000").select(*span).distinct().withColumn("page", F.explode(F.sequence("page_start", "page_end")))
        found = asked.join(pages, ["doc_id", "page"], "left").groupBy(*span).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("words", F.lit(0)).alias("words")))), lambda x: x["words"]).alias("weights"))
        weighed = big.join(found, span, "left")
    cut = weighed.select("chunk_id", _cut("text", "max_words", "overlap_words", "page_start", "page_end", "weights").alias("p"))
    rows = cut.select("chunk_id", F.size("p").alias("pieces"), F.explode("p").alias("q"))
    one = rows.groupBy("chunk_id", F.col("q.piece_no").alias("piece_no")).agg(F.min(F.struct("q.text", "q.word_count", "q.page_start", "q.page_end", "pieces")).alias("d"))
    return one.select("chunk_id", "piece_no", "d.pieces", "d.text", "d.word_count", "d.page_start", "d.page_end")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The chunk_ids that `split_oversized` cuts."""
    return split_oversized(chunks, limits).where("piece_no = 0").select("chunk_id")
