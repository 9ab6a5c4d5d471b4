"""Packing blocks in their order as a fold with a limit, without running a document through one task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored

STRETCH = 4096


class Late:
    """A pack ends with the block that takes its words, times 1.3, over the limit."""

    def __init__(self, limit: int):
        self.limit = limit
        self.states = next(n for n in range(limit + 2) if int(n * 1.3) > limit)

    def step(self, held: np.ndarray, size: int, flush: bool) -> tuple[np.ndarray, np.ndarray]:
        """What is held after a block, for everything that may be held before, and whether the block starts a pack."""
        after = held + size
        return np.where(np.floor(after * 1.3) > self.limit, 0, after), held == 0


class Early:
    """A pack ends before a block that would take it over the limit, and before a block that asks for it."""

    def __init__(self, limit: int):
        self.limit, self.states = limit, limit + 2  # all that is over the limit is alike

    def step(self, held: np.ndarray, size: int, flush: bool) -> tuple[np.ndarray, np.ndarray]:
        new = (held == 0) | (held + size > self.limit) | flush
        return np.minimum(np.where(new, size, held + size), self.limit + 1), new


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in columns))


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 20_000) -> Iterator[pd.DataFrame]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


_FOLD = ["doc_id", "stretch", "block_index", "size", "boundary", "flush"]


def packs(blocks: DataFrame, rule: Late | Early, stretch: int = STRETCH) -> DataFrame:
    """doc_id, block_index and pack (the block_index where the block's pack starts) of every block that isn't a boundary.

    blocks: doc_id, block_index, size (above 0), boundary (nothing is packed across it) and flush; one
    row per block; NULL sizes and flags count as 0 and false, blocks of size 0 that are no boundary have
    no pack.

    What a pack holds at the end of a stretch of blocks depends on what it held at its start, of which
    there are no more kinds than the limit allows. So each stretch is folded for all of them at once, the
    stretches of a document are chained (one row per stretch), and each stretch is folded again from
    what it really starts with. No task holds more than a stretch.
    """
    doc_type = blocks.schema["doc_id"].dataType.simpleString()
    own = blocks.select("doc_id", "block_index", F.coalesce("size", F.lit(0)).cast("int").alias("size"), F.coalesce("boundary", F.lit(False)).alias("boundary"), F.coalesce("flush", F.lit(False)).alias("flush"))
    own = stored(own.where((F.col("size") > 0) | F.col("boundary")).withColumn("stretch", F.expr(f"block_index div {stretch}")))  # sizes only, read for every step

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (doc, at), group in groupby(_rows(batches, _FOLD), key=lambda r: r[:2]):
                held, starts = np.arange(rule.states), np.full(rule.states, -1)
                for _, _, index, size, boundary, flush in group:
                    if boundary:
                        held, starts = np.zeros(1, np.int64), np.full(1, -1)
                        continue
                    held, new = rule.step(held, size, flush)
                    starts = np.where(new, index, starts)
                    if len(held) > 1 and (held == held[0]).all() and (starts == starts[0]).all() and starts[0] >= 0:
                        held, starts = held[:1], starts[:1]  # from here on it doesn't matter what was held before
                yield doc, at, held.tolist(), starts.tolist()

        yield from _frames(rows(), ["doc_id", "stretch", "held", "starts"], 1000)

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for doc, group in groupby(_rows(batches, ["doc_id", "stretch", "held", "starts"]), key=lambda r: r[0]):
                held, start = 0, -1
                for _, at, after, starts in group:
                    yield doc, at, held, start
                    k = held if len(after) > 1 else 0
                    held, start = int(after[k]), int(starts[k]) if starts[k] >= 0 else start

        yield from _frames(rows(), ["doc_id", "stretch", "held_in", "start_in"])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (doc, _), group in groupby(_rows(batches, [*_FOLD, "held_in", "start_in"]), key=lambda r: r[:2]):
                held = start = None
                for _, _, index, size, boundary, flush, held_in, start_in in group:
                    if held is None:
                        held, start = np.array([held_in]), start_in
                    if boundary:
                        held = np.zeros(1, np.int64)
                        continue
                    held, new = rule.step(held, size, flush)
                    start = index if new[0] else start
                    yield doc, index, start

        yield from _frames(rows(), ["doc_id", "block_index", "pack"])

    last = own.groupBy("doc_id").agg(F.max("stretch").alias("last"))
    split = own.join(last.where("last > 0"), "doc_id", "left_semi")  # a document of one stretch starts with nothing
    chain = (
        split.repartition("doc_id", "stretch").sortWithinPartitions("doc_id", "stretch", "block_index").mapInPandas(ends, f"doc_id {doc_type}, stretch bigint, held array<int>, starts array<bigint>")
        .repartition("doc_id").sortWithinPartitions("doc_id", "stretch").mapInPandas(chained, f"doc_id {doc_type}, stretch bigint, held_in int, start_in bigint")
    )
    known = own.join(chain, ["doc_id", "stretch"], "left").withColumn("held_in", F.coalesce("held_in", F.lit(0))).withColumn("start_in", F.coalesce("start_in", F.lit(-1)))
    return known.repartition("doc_id", "stretch").sortWithinPartitions("doc_id", "stretch", "block_index").mapInPandas(folded, f"doc_id {doc_type}, block_index int, pack int")


