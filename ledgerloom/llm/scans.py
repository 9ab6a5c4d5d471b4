"""Problem 4: text of scanned pages into continuous, readable paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import scancodec as codec
from ledgerloom.session import stored


class Settings(NamedTuple):
    """The samples bound what the models are fitted on."""

    sample_blocks: int = 600
    sample_lines: int = 12_000
    stretch: int = 4096
    flush: int = 200_000


_DROPPED = bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) != "|")
_ALIKE = bytes.maketrans(b"01|lr568eqf9h2", b"oiiiisbbcgtgbz")
_ALONE = re.compile(r"(?<![a-z|])[0-9][0-9,.]*(?![a-z|])")
_CAPITALS = re.compile(r"[A-Z\s]{3,60}")
_COMPOUND = re.compile(r"[a-z]+(?:-[a-z]+)+")
INK, CELLS, LABEL = 1, 2, 4


def skeleton(line: str) -> int:
    """The hash of a line without case, numbers, spaces, marks and differences that misreading makes, so that a running header keeps its skeleton."""
    low = _ALONE.sub("", line.lower()).encode("utf-8", "replace").translate(None, _DROPPED)
    for read, meant in ((b"rn", b"m"), (b"cl", b"d"), (b"li", b"h"), (b"ii", b"u"), (b"vv", b"w")):
        low = low.replace(read, meant)
    return xxhash.xxh64_intdigest(low.translate(_ALIKE))


def line_facts(line: str) -> tuple[int, str, str, str, int]:
    """Of one line: skeleton, form, the word it starts with, the broken word it may end with, and INK, CELLS (a row of a table) and LABEL (no running text if alone)."""
    if not line or line.isspace():
        return 0, "", "", "", 0
    flags = INK | (CELLS if " | " in line else 0)
    if (len(line) < 60 and "A" <= line[0] <= "Z" and not any(c in line for c in ".,;")) or _CAPITALS.fullmatch(line):
        flags |= LABEL
    start, end = codec.LINE_START.match(line), codec.break_of(line)
    return skeleton(line), codec.form_of(line).text, start.group(1) if start else "", end[0] + end[1] if end else "", flags


_LINE = T.StructType([T.StructField("sk", T.LongType()), T.StructField("form", T.StringType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("flags", T.IntegerType())])
_FACTS = T.StructType(
    [
        T.StructField("k", T.StringType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("doc_id", T.IntegerType()), T.StructField("block_index", T.IntegerType()), T.StructField("page_num", T.IntegerType()), T.StructField("th", T.LongType()), T.StructField("sec", T.LongType()), T.StructField("lines", T.ArrayType(_LINE)),
    ]
)
_TYPES = {"k": pa.string(), "h": pa.int64(), "n": pa.int64(), "doc_id": pa.int32(), "block_index": pa.int32(), "page_num": pa.int32(), "th": pa.int64(), "sec": pa.int64(), "lines": pa.list_(pa.struct([("sk", pa.int64()), ("form", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("flags", pa.int32())]))}


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def _batch(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], names=list(_TYPES))


def facts_of(page_blocks: DataFrame, s: Settings) -> DataFrame:
    """What one pass over the texts finds: counts of keys (k, its hash h, n) in all blocks and, per annual_report block, the facts of its lines.

    Keys are words, forms of numbers and compounds. They are counted per partition first, in at most
    `flush` entries at a time. Rows hold either a count or a block; texts themselves don't go on.
    """

    def counted(tokens: Counter, compounds: Counter) -> pa.RecordBatch:
        keys: Counter = Counter(compounds)
        for token, n in tokens.items():
            if any(c.isalnum() for c in token):
                keys[codec.key(token)] += n
        return _batch(len(keys), {"k": pa.array(list(keys), pa.string()), "h": pa.array(_signed([codec.key_hash(k) for k in keys])), "n": pa.array(list(keys.values()), pa.int64())})

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, compounds = Counter(), Counter()
        for batch in batches:
            at, sizes, flat, sections = [], [], [], []
            texts, annual, section = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "annual", "section"))
            for i, text in enumerate(texts):
                tokens.update(codec.TOKEN.findall(text))
                if "-" in text:
                    compounds.update(k for w in text.lower().split() if "-" in w for k in _COMPOUND.findall(w))
                if annual[i]:
                    lines = text.split("\n")
                    at.append(i)
                    sizes.append(len(lines))
                    flat += map(line_facts, lines)
                    sections.append(skeleton(section[i]) if section[i] else 0)
            if at:
                sk, form, head, tail, flags = zip(*flat)
                entries = pa.StructArray.from_arrays([pa.array(_signed(sk)), pa.array(form, pa.string()), pa.array(head, pa.string()), pa.array(tail, pa.string()), pa.array(flags, pa.int32())], fields=list(_TYPES["lines"].value_type))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                own = {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(at)) for c in ("doc_id", "block_index", "page_num", "th")}
                yield _batch(len(at), own | {"sec": pa.array(_signed(sections)), "lines": pa.ListArray.from_arrays(offsets, entries, type=_TYPES["lines"])})
            if len(tokens) + len(compounds) > s.flush:
                yield counted(tokens, compounds)
                tokens, compounds = Counter(), Counter()
        yield counted(tokens, compounds)

    annual = _is_annual() & F.col("doc_id").isNotNull() & F.col("block_index").isNotNull()
    read = page_blocks.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("int").alias("doc_id"), F.col("block_index").cast("int").alias("block_index"), F.coalesce("page_num", F.lit(0)).cast("int").alias("page_num"), F.xxhash64("text").alias("th"), F.coalesce(annual, F.lit(False)).alias("annual"), "section", "text"
    )
    return read.mapInArrow(facts, _FACTS)


def _is_annual() -> Column:
    return F.lower(F.trim("doc_type")) == "annual_report"


def key_counts(facts: DataFrame) -> DataFrame:
    """h, n, k: how often each word, number's form and compound stands in all blocks."""
    return facts.where(F.col("k").isNotNull()).groupBy("h").agg(F.sum("n").alias("n"), F.min("k").alias("k"))


def lexicon_of(counts: DataFrame, t: codec.Training = codec.Training()) -> tuple[codec.Lexicon, codec.Examples]:
    """The count of every key, and the keys to fit the editor on.

    All counts come to the driver, as 16 bytes a key, whatever the keys; none is left out at any size.
    Which words are frequent or seldom is a matter of their order, not of a number.
    """
    packed = counts.select("h", "n").toPandas()
    plain = counts.where(~F.col("k").contains("-"))
    frequent = plain.orderBy(F.desc("n"), "k").limit(t.words).toPandas()["k"]
    rare = plain.where(F.col("k").rlike("^[a-z]{3,}$")).orderBy("n", "h").limit(t.rare + t.observed).toPandas()["k"]
    compounds = counts.where(F.col("k").contains("-") & (F.col("n") > 1)).orderBy("h").limit(t.compounds).toPandas()["k"]
    return codec.Lexicon(packed["h"].to_numpy(np.int64).view(np.uint64), packed["n"].to_numpy(np.int64)), codec.Examples(list(frequent), list(rare), list(compounds))


def annual_blocks(facts: DataFrame) -> DataFrame:
    """doc_id, block_index, page_num, th, sec, lines: one row per block; of different texts in one place that with the least hash holds."""
    return facts.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "block_index").agg(F.min_by(F.struct("page_num", "th", "sec", "lines"), F.struct("th", "page_num", "sec")).alias("b")).select("doc_id", "block_index", "b.*")


def furniture_lines(blocks: DataFrame, s: Settings) -> DataFrame:
    """doc_id, block_index, line_no (from 0) of running headers, footers and page numbers.

    Every line has its skeleton counted over the pages of its document, over the documents of the corpus
    and over those in which it runs on, all pre-aggregated, and whether it is a block of its own
    somewhere in the document; with its place on the page they are the
    features of a perceptron fitted on a bounded sample of lines. Only skeletons that stand more than
    once are joined back.
    """
    has = lambda c, flag: c.bitwiseAND(F.lit(flag)) != 0
    n = F.size("lines")
    edges = blocks.where("page_num > 0").groupBy("doc_id", "page_num").agg(F.min("block_index").alias("first"), F.max("block_index").alias("last"))
    place = F.when(F.col("first").isNull(), "unknown").when(F.col("block_index") == F.col("first"), "top").when(F.col("block_index") == F.col("last"), "bottom").otherwise("inside")
    lines = blocks.join(edges, ["doc_id", "page_num"], "left").select("doc_id", "block_index", "page_num", place.alias("place"), n.alias("n"), (F.size(F.filter("lines", lambda x: has(x["flags"], CELLS))) * 2 > n).alias("rows"), F.posexplode("lines").alias("line_no", "l"))
    lines = lines.where(has(F.col("l.flags"), INK)).select("doc_id", "block_index", "page_num", "place", "line_no", "n", "rows", "l.sk", "l.form")
    page = F.when(F.col("page_num") > 0, F.col("page_num")).otherwise(-F.col("block_index"))
    by_page = lines.groupBy("doc_id", "sk", page.alias("p")).agg(F.bool_or(F.col("n") == 1).alias("alone"))
    in_doc = by_page.groupBy("doc_id", "sk").agg(F.count("*").cast("int").alias("pages"), F.bool_or("alone").alias("alone"))
    in_all = in_doc.groupBy("sk").agg(F.count("*").cast("int").alias("docs"), F.count_if(F.col("pages") >= 3).cast("int").alias("running")).where("docs > 1")
    headings = blocks.where("sec <> 0").select(F.col("sec").alias("sk")).distinct().withColumn("heading", F.lit(True))
    known = in_all.join(headings, "sk", "full")
    pages = F.coalesce("pages", F.lit(1))
    placed = (
        lines.join(in_doc.where("pages > 1"), ["doc_id", "sk"], "left").join(known, "sk", "left")
        .select(
            "doc_id", "block_index", "line_no", "form", pages.alias("pages"), F.coalesce("docs", F.lit(1)).alias("docs"),
            "place", (F.col("n") == 1).alias("whole"), ((F.col("line_no") == 0) | (F.col("line_no") == F.col("n") - 1)).alias("edge"), F.coalesce("heading", F.lit(False)).alias("heading"), (F.col("rows") & (F.col("n") > 1)).alias("table"),
            F.coalesce("running", F.when(pages >= 3, 1).otherwise(0)).alias("running"), F.coalesce("alone", F.col("n") == 1).alias("alone"),
        )
    )
    placed = stored(placed)  # read for the sample and for the verdicts
    columns = list(codec.Line._fields)
    # A long line that is a block of its own is plain; such lines would only crowd out the others.
    sample = placed.where(~(F.col("whole") & F.col("form").like("text|10|%"))).select(*columns, F.xxhash64("doc_id", "block_index", "line_no").alias("h")).orderBy("h", *columns).limit(s.sample_lines).toPandas()
    model = placed.sparkSession.sparkContext.broadcast(codec.train_furniture([codec.Line(*row) for row in sample[columns].itertuples(index=False, name=None)]).w)

    @F.pandas_udf(T.BooleanType())
    def is_furniture(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        p, seen = codec.Perceptron(model.value), {}
        for batch in batches:
            out = []
            for row in zip(*batch):
                if (v := seen.get(row)) is None:
                    if len(seen) > 100_000:
                        seen.clear()
                    v = seen[row] = p.score(codec.line_features(codec.Line(*row))) > 0
                out.append(v)
            yield pd.Series(out, dtype=bool)

    return placed.where(is_furniture(*columns)).select("doc_id", "block_index", "line_no")


_SCAN = T.StructType([T.StructField("hyphen", T.BooleanType()), T.StructField("char", T.BooleanType()), T.StructField("text", T.StringType())])


def scan(editor: codec.Editor, text: str, removed: set[int], head: str, tail: str) -> tuple[bool, bool, str]:
    """A block's noise and its repaired text.

    removed: the numbers of its lines that are furniture; head: the word the next block of running text
    starts with; tail: the broken word the one before ends with.
    """
    char = False
    lines = text.split("\n")
    misread = bool(editor.misread(text))

    def fix(part: str) -> str:
        nonlocal char
        if not misread:
            return part
        new = codec.TOKEN.sub(lambda m: editor.word(m.group()), part)
        char |= new != part
        return new

    for i in removed:
        if i < len(lines):
            fix(lines[i])
    kept = [line for i, line in enumerate(lines) if i not in removed]
    if sum(" | " in line for line in kept) * 2 > len(kept):
        fixed = "\n".join(map(fix, kept))
        return False, char, fixed
    hyphen = False
    if kept and tail and (b := codec.break_of(tail)) and (start := codec.start_of(kept[0])) and editor.joined(b[0], b[1], start.split("-", 1)[0]):
        at = kept[0].index(start) + len(start.split("-", 1)[0])
        kept[0] = kept[0][at:]
    out: list[str] = []
    carry = False  # whether the text so far ends inside a word
    for i, line in enumerate(kept):
        last = i == len(kept) - 1
        b = codec.break_of(line)
        following = "" if not b else head if last else codec.start_of(kept[i + 1])
        body, joint, ending = line, None, ""
        if b and following and editor.joined(b[0], b[1], following.split("-", 1)[0]):
            hyphen = True
            first = following.split("-", 1)[0]
            body, joint = line[: codec.line_end(line).start()], b[0] + first
            if not last:
                kept[i + 1] = kept[i + 1][kept[i + 1].index(following) + len(first) :]
        elif last and b and editor.left_open(b[0], b[1], following):
            hyphen = True
        elif b and b[1] and following:  # a compound that broke at its own hyphen
            body, ending = line[: codec.line_end(line).start()], f"{fix(b[0])}-"
        said = fix(body)
        if joint is not None:
            whole = codec.TOKEN.sub(lambda m: editor.word(m.group()), joint)
            char |= whole != joint
            said += whole
        said += ending
        out.append(said if carry else f" {said.strip()}")
        carry = joint is not None or bool(ending)
    return hyphen, char, " ".join("".join(out).split())


_HELD: list = []


def _editor(shared) -> codec.Editor:
    """The editor of this worker, with what it remembers of tokens, for all tasks of one broadcast."""
    value = shared.value
    if not _HELD or _HELD[0] is not value:
        hashes, counts, edits, joins, opens, confusions = value
        _HELD[:] = [value, codec.Editor(codec.Lexicon(hashes, counts), codec.Perceptron(edits), codec.Perceptron(joins), codec.Perceptron(opens), confusions)]
    return _HELD[1]


def _neighbours_of(page_blocks: DataFrame, s: Settings, t: codec.Training) -> list[tuple[str, str]]:
    """Words that stand side by side in a sample of blocks, found on the executors."""
    h = F.xxhash64("doc_id", "block_index")
    annual = page_blocks.where(_is_annual() & F.col("text").isNotNull())
    first = annual.select(h.alias("h")).distinct().orderBy("h").limit(s.sample_blocks).agg(F.max("h")).first()[0]

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])))
    def pairs(texts: pd.Series) -> pd.Series:
        return pd.Series([[p for line in text.split("\n") for p in codec.neighbours(line)] for text in texts], dtype=object)

    found = annual.where(h <= F.lit(first)).select(h.alias("h"), F.posexplode(pairs("text")).alias("at", "p")).select("h", "at", "p.a", "p.b").distinct()
    return [(r.a, r.b) for r in found.orderBy("h", "at", "a", "b").limit(t.ordinary).collect()]


def repaired(page_blocks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Every annual_report block with its noise: doc_id, block_index, page_num, furniture, hyphen, char and the repaired text.

    Furniture lines are removed; misread characters replaced, deleted or inserted; words broken at line
    and block ends joined (the block where the word begins has it whole); lines become running text,
    tables keep their rows. block_type isn't used. NULL texts and keys give no row, repeated rows count
    once (of different texts in one place that with the least hash holds), empty texts have no noise,
    extra columns are ignored; with no blocks there is no row.

    One pass over the texts gives the lexicon, which counts all keys of all blocks, and facts of all
    lines, however long; models are fitted on bounded samples (Settings, scancodec.Training). The
    neighbours of a block come from windows over stretches of a document and the stretches' ends, so
    that no document is one task's group. Texts are shuffled once, when all is known of their block.
    """
    t = codec.Training()
    facts = stored(facts_of(page_blocks, s))
    lexicon, known = lexicon_of(stored(key_counts(facts)), t)
    editor = codec.train_editor(lexicon, known, _neighbours_of(page_blocks, s, t), t)
    shared = page_blocks.sparkSession.sparkContext.broadcast((lexicon.hashes, lexicon.counts, editor.edits.w, editor.joins.w, editor.opens.w, editor.confusions))

    blocks = stored(annual_blocks(facts))
    removed = furniture_lines(blocks, s).groupBy("doc_id", "block_index").agg(F.collect_set("line_no").alias("removed"))
    full = blocks.join(removed, ["doc_id", "block_index"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("removed", i) & (x["flags"] != 0))
    slim = full.select("doc_id", "block_index", "page_num", "th", "removed", F.size(kept).alias("n"), F.try_element_at(kept, F.lit(1)).alias("first"), F.try_element_at(kept, F.lit(-1))["tail"].alias("last_tail"))
    flag = lambda x: F.coalesce(F.col("first.flags").bitwiseAND(F.lit(x)) != 0, F.lit(False))
    prose = (F.col("n") > 0) & ~flag(CELLS) & ~((F.col("n") == 1) & flag(LABEL))
    own = slim.select(
        "doc_id", "block_index", "page_num", "th", "removed", F.expr(f"block_index div {s.stretch}").alias("stretch"), prose.alias("prose"), F.when(prose, F.col("first.head")).alias("own_head"), F.when(prose, F.col("last_tail")).alias("own_tail")
    )
    ends = own.groupBy("doc_id", "stretch").agg(F.min_by("own_head", F.when(F.col("prose"), F.col("block_index"))).alias("s_head"), F.max_by("own_tail", F.when(F.col("prose"), F.col("block_index"))).alias("s_tail"))
    over = Window.partitionBy("doc_id").orderBy("stretch")
    around = ends.select("doc_id", "stretch", F.last("s_tail", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("in_tail"), F.first("s_head", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("in_head"))
    w = Window.partitionBy("doc_id", "stretch").orderBy("block_index")
    near = own.join(around, ["doc_id", "stretch"]).select(
        "doc_id", "block_index", "page_num", "th", "removed",
        F.when(F.col("prose"), F.coalesce(F.first("own_head", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("in_head"))).alias("head"),
        F.when(F.col("prose"), F.coalesce(F.last("own_tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("in_tail"))).alias("tail"),
    )
    texts = page_blocks.where(_is_annual() & F.col("text").isNotNull()).select(F.col("doc_id").cast("int").alias("doc_id"), F.col("block_index").cast("int").alias("block_index"), F.xxhash64("text").alias("th"), "text").dropDuplicates(["doc_id", "block_index", "th"])

    @F.pandas_udf(_SCAN)
    def scanned(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        e = _editor(shared)
        for batch in batches:
            rows = [scan(e, text, {int(i) for i in gone}, h or "", t or "") for text, gone, h, t in zip(*batch)]
            yield pd.DataFrame(rows, columns=["hyphen", "char", "text"])

    joined = near.join(texts, ["doc_id", "block_index", "th"])
    return joined.withColumn("s", scanned("text", "removed", "head", "tail")).select("doc_id", "block_index", "page_num", (F.size("removed") > 0).alias("furniture"), "s.hyphen", "s.char", F.col("s.text").alias("text"))


def noise_found(page_blocks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, block_index, noise ('hyphen', 'char', 'furniture'): one row per kind a block has."""
    r = repaired(page_blocks, s)
    kinds = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("hyphen", "char", "furniture"))), lambda x: x.isNotNull())
    return r.select("doc_id", "block_index", F.explode(kinds).alias("noise"))


def paragraphs(page_blocks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, page_num, paragraph (its first block_index) and text: blocks in order, each running on until a sentence ends.

    The last text and the last start of each stretch are carried into the later ones, so that a
    paragraph runs over the edge of a stretch.
    """
    r = stored(repaired(page_blocks, s).where(F.col("text") != "").select("doc_id", "page_num", "block_index", "text"))
    r = r.withColumn("stretch", F.expr(f"block_index div {s.stretch}"))
    keys = ["doc_id", "page_num", "stretch"]
    w = Window.partitionBy(*keys).orderBy("block_index")
    earlier = Window.partitionBy("doc_id", "page_num").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = r.groupBy(*keys).agg(F.max_by("text", "block_index").alias("s_text")).select(*keys, F.last("s_text").over(earlier).alias("in_text"))
    closed = F.col("before").isNull() | F.col("before").rlike(r"[.!?:।][\"'”’)]*$") | F.col("text").rlike(r"^[^a-z0-9]*[A-Z].*\n") | ~F.col("text").rlike(r"^[a-z0-9(,;]")
    begun = r.join(ends, keys).withColumn("before", F.coalesce(F.lag("text").over(w), F.col("in_text"))).withColumn("start", F.when(closed, F.col("block_index"))).drop("in_text", "before")
    into = begun.groupBy(*keys).agg(F.max("start").alias("s_start")).select(*keys, F.last("s_start", ignorenulls=True).over(earlier).alias("in_start"))
    placed = begun.join(into, keys).withColumn("paragraph", F.coalesce(F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("in_start")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), " ")
    return placed.groupBy("doc_id", "page_num", "paragraph").agg(text.alias("text"))
