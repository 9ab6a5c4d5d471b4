"""Problem 10: texts cut off by field limits or in transfer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import stored

# Marks that say a text goes on elsewhere, and characters that close a sentence.
MARKS = ("...", "…", "[...]", "[…]", "(...)", "[more]", "(more)", "...more", "[truncated]", "(truncated)", "read more", ">>")
CLOSERS = ".!?।॥"
_QUOTES = "\"'”’)]»"
_PAIRS = (("(", ")"), ("[", "]"), ("“", "”"))


class Settings(NamedTuple):
    """sample_rows is the bound on the texts the classifier is fitted on; the features of an ending look at its last `lines` lines and, for a signature, at `signature` characters."""

    sample_rows: int = 8000
    buckets: int = 1 << 17
    epochs: int = 6
    rounds: int = 2
    threshold: float = 0.5
    least_at_limit: int = 3
    seed: int = 11
    lines: int = 8
    signature: int = 90


_MARK = re.compile("(?:" + "|".join(re.escape(m) for m in sorted(MARKS, key=len, reverse=True)) + r")\s*$", re.I)
_WORD = re.compile(r"\S+")


def _shape(text: str) -> str:
    """Runs of capitals, small letters, other letters and digits, one sign each; the rest as it is."""
    out = []
    for c in text:
        sign = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "w" if c.isalpha() or ord(c) > 0x900 and c.isprintable() and not c.isspace() and not c in "।॥—–…‘’“”₹€" else " " if c.isspace() else c
        if not out or out[-1] != sign or sign not in "9Aaw ":
            out.append(sign)
    return "".join(out)


def limit_features(at_limit: bool, closed: bool, kind: str) -> list[str]:
    return [f"limit {at_limit}", f"limit {at_limit} closed {closed}", f"limit {at_limit} kind {kind}"]


def ending(text: str, s: Settings = Settings()) -> tuple[list[str], bool, str]:
    """What the end of a text looks like: closing characters, punctuation and its last line beside those before; whether it is closed, and of what kind."""
    bare = text.rstrip()
    mark = _MARK.search(bare)
    lines = [line for line in bare.rsplit("\n", s.lines)[-s.lines :] if line.strip()]
    last = lines[-1].strip() if lines else ""
    before = lines[-2].strip() if len(lines) > 1 else ""
    words = last.split()
    end = bare[-1:]
    closed = bare.rstrip(_QUOTES)[-1:] in CLOSERS and not mark and bare.rstrip(_QUOTES) != ""
    cells, cells_before = last.count("|"), before.count("|")
    if cells or last.startswith("|"):
        kind = "row"
    elif cells_before and (not closed) and len(words) <= 4 and "\n" in bare:
        kind = "rowstart"
    elif re.match(r"[-*•]\s", last):
        kind = "item"
    elif re.match(r"[—–]\s", last) or re.search(r"\s—\s[^.]*$", last[-s.signature :]):
        kind = "signature"
    else:
        kind = "text"
    open_pair = any(bare.count(a) > bare.count(b) for a, b in _PAIRS) or bare.count('"') % 2 == 1
    tail = words[-1] if words else ""
    out = [
        "1", f"kind {kind}", f"mark {bool(mark)}", f"closed {closed}", f"kind {kind} closed {closed}", f"open {open_pair}",
        f"space {bare != text}", f"end {end if not end.isalnum() else _shape(end)}", f"broken {end == chr(0xFFFD)}", f"shape {_shape(bare[-4:])}", f"kind {kind} shape {_shape(bare[-3:])}", f"kind {kind} tail {tail.lower()}",
        f"tail {tail.lower()}", f"tail shape {kind} {_shape(tail)}",
    ]
    if re.search(r"\d,$", bare):
        out.append("number open")
    if len(words) > 1:
        out += [f"two {' '.join(words[-2:]).lower()}", f"two shape {kind} {_shape(' '.join(words[-2:]))}"]
    if len(last) <= 60 and not closed and kind in ("text", "signature"):
        out.append(f"line {last.lower()}")
    if kind in ("row", "rowstart"):
        peers = [line.count("|") for line in lines[-4:-1] if "|" in line]
        relation = "none" if not peers else "same" if cells == peers[-1] else "less" if cells < peers[-1] else "more"
        out += [f"cells {relation}", f"cells {relation} shape {_shape(bare[-2:])}"]
        if end == "," or end == "." or end == "|":
            out.append("row ends open")
        number = re.search(r"(\d[\d,]*)$", last)
        if number and re.search(r",\d{0,2}$", number.group()):
            out.append("number ends short")
    if kind == "item":
        peer = next((line.strip() for line in reversed(lines[:-1]) if re.match(r"\s*[-*•]\s", line)), None)
        if peer is None:
            out.append("item alone")
        else:
            same = peer.split()[-1:] == words[-1:]
            out += [f"item same end {same}", f"item shape {_shape(' '.join(peer.split()[-3:])) == _shape(' '.join(words[-3:]))}"]
    if kind == "signature":
        out.append(f"signature {len(last.rsplit('— ', 1)[-1].split())} {_shape(tail)}")
    return out, closed, kind


def features(text: str, at_limit: bool, s: Settings = Settings()) -> list[str]:
    """The features of a text's end and of its length to the limit of its source."""
    names, closed, kind = ending(text, s)
    return names + limit_features(at_limit, closed, kind)


def hashed(names: list[str], buckets: int) -> np.ndarray:
    return np.fromiter({zlib.crc32(n.encode()) % buckets for n in names}, np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of a logistic regression by Adagrad over shuffled mini-batches, with a little ridge."""
    rng = np.random.default_rng(s.seed)
    w, g2 = np.zeros(s.buckets, np.float32), np.full(s.buckets, 1e-3, np.float32)
    lengths = np.array([len(r) for r in rows])
    for _ in range(s.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            take = order[at : at + 64]
            flat = np.concatenate([rows[i] for i in take])
            owner = np.repeat(np.arange(len(take)), lengths[take])
            z = np.bincount(owner, w[flat], minlength=len(take))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]) * weights[take]
            touched, place = np.unique(flat, return_inverse=True)
            grad = np.bincount(place, error[owner], minlength=len(touched)) / len(take) + 1e-5 * w[touched]
            g2[touched] += (grad**2).astype(np.float32)
            w[touched] -= (0.3 * grad / np.sqrt(g2[touched])).astype(np.float32)
    return w


def artificial_cut(text: str, rng: np.random.Generator) -> tuple[str, bool] | None:
    """The text cut inside a word, number, sentence, item or row, and whether it counts as at its limit; None if too short."""
    bare = text.rstrip()
    if len(bare) < 40:
        return None
    at = int(rng.integers(max(20, len(bare) // 5), len(bare) - 2))
    cut, rest = bare[:at], bare[at:]
    kept = cut.rstrip()
    if not kept or kept.rstrip(_QUOTES)[-1:] in CLOSERS and (rest[:1].isspace() or cut != kept) or "\n" in rest[:1] or cut[-1:] == "\n":
        return None  # between two sentences or lines: nothing is cut inside
    style = rng.random()
    if style < 0.2:
        cut = cut.rsplit(None, 1)[0].rstrip(",;:") + (" " if rng.random() < 0.5 else "") + str(rng.choice(MARKS[:8]))
    elif style < 0.27:
        cut += "�"
    elif style < 0.35:
        cut += " " * int(rng.integers(1, 3))
    return cut, bool(style >= 0.2 and rng.random() < 0.5)


class Example(NamedTuple):
    """What a text gives to the fit: hashed features of its end as it is, and those of its artificial cuts."""

    intact: list[int] | None
    cuts: list[list[int]]


def example(text: str, at_limit: bool, rng: np.random.Generator, s: Settings) -> Example:
    """A text with a mark, a broken character at its end, or at its limit without a closing character is no example."""
    bare = text.rstrip()
    if _MARK.search(text) or bare.endswith(chr(0xFFFD)) or (at_limit and bare.rstrip(_QUOTES)[-1:] not in CLOSERS):
        return Example(None, [])
    cuts = [c for _ in range(3) if (c := artificial_cut(text, rng)) is not None]
    return Example(hashed(features(text, at_limit, s), s.buckets).tolist(), [hashed(features(*c, s), s.buckets).tolist() for c in cuts])


def train(examples: list[Example], s: Settings) -> np.ndarray:
    """A classifier of cut texts from texts as they are, most of them intact, and artificial cuts of them.

    After each round, texts the model itself takes for cut leave the intact examples.
    """
    intact = [np.array(e.intact, np.int64) for e in examples if e.intact is not None]
    cuts = [np.array(c, np.int64) for e in examples for c in e.cuts]
    w = np.zeros(s.buckets, np.float32)
    for _ in range(s.rounds):
        rows = intact + cuts
        if not intact or not cuts:
            break
        labels = np.array([0.0] * len(intact) + [1.0] * len(cuts))
        weights = np.where(labels > 0, len(intact) / len(cuts), 1.0)
        w = fit(rows, labels, weights, s)
        intact = [r for r in intact if w[r].sum() < 0] or intact
    return w


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.trim("source").alias("source"), "text").where(F.col("text").rlike(r"\S"))


def _sizes() -> tuple[Column, Column]:
    return F.length("text").alias("chars"), F.octet_length("text").alias("bytes")


def field_limits(documents: DataFrame, least: int = Settings().least_at_limit) -> DataFrame:
    """source, unit ('chars' or 'bytes') and limit: lengths at which the longest texts of a source pile up.

    A length is a limit if at least `least` texts have it and texts of that length, or up to three more,
    are half of all texts as long or longer. Counted over all texts, pre-aggregated by source and length.
    """
    sizes = _texts(documents).select("source", *_sizes()).select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("x"))
    counts = sizes.groupBy("source", "x.unit", "x.n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source", "unit").orderBy("n")
    near = F.sum("c").over(w.rangeBetween(-3, 3))
    up = F.sum("c").over(w.rangeBetween(-3, Window.unboundedFollowing))
    piled = counts.withColumn("near", near).withColumn("up", up).where((F.col("c") >= least) & (F.col("n") > 20) & (F.col("near") * 2 >= F.col("up")))
    return piled.groupBy("source", "unit").agg(F.max_by("n", F.struct("c", "n")).alias("limit"))


def _at_limit(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of source, chars, bytes and stripped (characters before outer white space at the end), without their text, and whether they are at their source's limit."""
    in_chars = (F.col("stripped") <= F.col("char_limit")) & (F.col("char_limit") <= F.col("chars"))
    in_bytes = F.abs(F.col("bytes") - F.col("byte_limit")) <= 3
    joined = sized.join(limits.withColumnRenamed("source", "limit_source"), F.col("source") == F.col("limit_source"), "left")
    return joined.withColumn("at_limit", F.coalesce(in_chars, F.lit(False)) | F.coalesce(in_bytes, F.lit(False))).drop("limit_source", "char_limit", "byte_limit", "chars", "bytes", "stripped")


_EXAMPLES = T.StructType([T.StructField(n, T.StructType([T.StructField("intact", T.ArrayType(T.IntegerType())), T.StructField("cuts", T.ArrayType(T.ArrayType(T.IntegerType())))])) for n in ("free", "full")] + [T.StructField("stripped", T.IntegerType())])
_ENDING = T.StructType([T.StructField("free", T.DoubleType()), T.StructField("full", T.DoubleType()), T.StructField("stripped", T.IntegerType())])


def truncation_scores(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, source and probability of being cut off, of every document with a text.

    NULL, empty and blank texts give no row; a NULL source has no limit of its own; repeated rows count
    once by doc_id (of different rows of one doc_id the least source and probability hold); extra
    columns are ignored; with no texts there is no row.

    The classifier is fitted on at most sample_rows texts, those with the least hashes of doc_id. Their
    features are hashed on the executors, so what comes to the driver doesn't grow with the length of
    texts. Limits are counted over all texts, and every text is scored in whole in Arrow batches, both
    for a text at its limit and for one that isn't; only these two numbers and the lengths meet the
    limits of the sources, so no text is ever shuffled. The weights (buckets * 4 bytes) are broadcast.
    """
    limit = lambda unit: F.max(F.when(F.col("unit") == unit, F.col("limit")))
    limits = stored(field_limits(documents, s.least_at_limit).groupBy("source").agg(limit("chars").alias("char_limit"), limit("bytes").alias("byte_limit")))
    texts = _texts(documents).withColumn("h", F.xxhash64(F.lit(s.seed), "doc_id"))
    first = texts.select("h").distinct().orderBy("h").limit(s.sample_rows).agg(F.max("h")).first()[0]

    @F.pandas_udf(_EXAMPLES)
    def examples(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hashes, batch in batches:
            both = lambda h, t: [example(t, at, np.random.default_rng(h & (1 << 63) - 1), s)._asdict() for at in (False, True)]
            yield pd.DataFrame([(*both(int(h), t), len(t.rstrip())) for h, t in zip(hashes, batch)], columns=["free", "full", "stripped"])

    known = _at_limit(texts.where(F.col("h") <= F.lit(first)).select("h", "doc_id", "source", *_sizes(), examples("h", "text").alias("e")).select("h", "doc_id", "source", "chars", "bytes", "e.*"), limits)
    sample = known.select("h", "doc_id", F.when(F.col("at_limit"), F.col("full")).otherwise(F.col("free")).alias("e")).orderBy("h", "doc_id", "e").limit(s.sample_rows).toPandas()
    w = train([Example(e["intact"], e["cuts"]) for e in sample["e"]], s)
    shared = documents.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf(_ENDING)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        extra = lru_cache(256)(lambda at, closed, kind: weights[hashed(limit_features(at, closed, kind), s.buckets)])
        for batch in batches:
            rows = []
            for t in batch:
                names, closed, kind = ending(t, s)
                own = {zlib.crc32(n.encode()) % s.buckets for n in names}
                z = weights[list(own)].sum(dtype=np.float64)
                rows.append((z + extra(False, closed, kind).sum(dtype=np.float64), z + extra(True, closed, kind).sum(dtype=np.float64), len(t.rstrip())))
            yield pd.DataFrame(rows, columns=["free", "full", "stripped"])

    scored = _at_limit(texts.select("doc_id", "source", *_sizes(), score("text").alias("z")).select("doc_id", "source", "chars", "bytes", "z.*"), limits)
    p = 1 / (1 + F.exp(-F.when(F.col("at_limit"), F.col("full")).otherwise(F.col("free"))))
    one = scored.select("doc_id", F.struct("source", p.alias("p")).alias("d")).groupBy("doc_id").agg(F.min("d").alias("d"))
    return one.select("doc_id", "d.source", "d.p")


def truncated(scores: DataFrame, threshold: float = Settings().threshold) -> DataFrame:
    return scores.where(F.col("p") >= threshold).select("doc_id")


def truncation_rates(scores: DataFrame, threshold: float = Settings().threshold) -> DataFrame:
    """source, documents, truncated and rate."""
    cut = F.count_if(F.col("p") >= threshold)
    return scores.groupBy("source").agg(F.count("*").alias("documents"), cut.alias("truncated"), (cut / F.count("*")).alias("rate"))
