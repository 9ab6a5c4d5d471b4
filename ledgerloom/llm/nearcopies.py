"""Problem 5: near-copies of texts, as a similarity join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import stored

# Fixed value: a-z and 0-9 stay, all other bytes part words.
_APART = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Join(NamedTuple):
    """Parameters of the join. A pair of similarity s meets in a tile with probability 1 - (1 - s^rows)^bands.

    exact: candidates come from the rarest shingles of each text instead, which loses no pair but shuffles all shingles twice.
    """

    words: int = 3
    threshold: float = 0.6
    bands: int = 72
    rows: int = 4
    filter_bits: int = 1 << 23
    seed: int = 1
    exact: bool = False
    part: int = 2048


class _Words(dict):
    """64-bit hashes of words; forgotten when there are too many to keep."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def shingles(text: str | None, words: int, hashes: _Words) -> np.ndarray:
    """The sorted set of hashed runs of `words` words of the whole text; empty if it has fewer."""
    found = text.lower().encode("ascii", "replace").translate(_APART).split() if text else ()
    if len(found) < words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    run, other = h[:n] * _A, h * _C
    for k in range(1, words):
        run = _mix(run + np.uint64(k))
        run += other[k : n + k]
    run = _mix(run)
    run.sort()
    return run[np.concatenate([[True], run[1:] != run[:-1]])]


def _multipliers(join: Join) -> np.ndarray:
    return np.random.default_rng(join.seed).integers(0, 1 << 31, size=join.bands * join.rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(found: np.ndarray, join: Join, multipliers: np.ndarray) -> np.ndarray:
    """One key per band, of the least of each of its rows' permutations of 32-bit hashes: equal shingles are least alike, so short hashes only add pairs to check."""
    short, each = (found >> np.uint64(32)).astype(np.uint32), multipliers[:, None]
    least = np.full(len(multipliers), np.uint32((1 << 32) - 1))
    for at in range(0, len(short), 1024):
        np.minimum(least, (short[None, at : at + 1024] * each).min(axis=1), out=least)
    rows = least.astype(np.uint64).reshape(join.bands, join.rows)
    key = np.arange(join.bands, dtype=np.uint64) * _C
    for k in range(join.rows):
        key = _mix(key + rows[:, k])
    return key


def bits_of(size: int) -> int:
    """The bits of a set's map: a power of two, twice the size or more, so that maps of large sets don't fill up."""
    return max(256, 1 << (2 * size - 1).bit_length())


def bitmap(found: np.ndarray, bits: int) -> bytes:
    """A bit for each shingle's hash. The bits in which two maps differ are no more than the shingles in which the sets do."""
    marks = np.zeros(bits, np.uint8)
    marks[(found % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


_SIGNATURE = T.StructType(
    [T.StructField("chunk_id", T.StringType()), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bitmap", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
)


def signatures(chunks: DataFrame, join: Join) -> DataFrame:
    """chunk_id, node (hash of its shingle set), size, bitmap and band keys; texts with too few words give none.

    The keys of a node come once per partition, so copies, however many, are not shuffled again and again.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, multipliers, seen = _Words(), _multipliers(join), set()
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, max(1, whole.num_rows), 2000)):
            ids, nodes, sizes, maps, keys, counts = [], [], [], [], [], []
            for chunk_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(found := shingles(text, join.words, hashes)):
                    ids.append(chunk_id)
                    nodes.append(node := xxhash.xxh64_intdigest(found.tobytes()))
                    sizes.append(len(found))
                    maps.append(bitmap(found, bits_of(len(found))))
                    counts.append(0 if node in seen else len(found) if join.exact else join.bands)
                    if counts[-1]:
                        seen.add(node)
                        keys.append(found if join.exact else band_keys(found, join, multipliers))
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=[f.name for f in _SIGNATURE],
            )

    return chunks.select("chunk_id", "text").where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).mapInArrow(sign, _SIGNATURE)


def _folded(maps: pd.Series, width: int) -> np.ndarray:
    """Maps of one width as rows of words, folded to a smaller width: the map a set would have there."""
    words = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1, width // 8)
    return np.bitwise_or.reduce(words, axis=1)


def _may_match(join: Join):
    """Whether sizes and bit counts allow the threshold: an upper bound of the overlap, so no pair is lost."""

    @F.pandas_udf(T.BooleanType())
    def bound(size_a: pd.Series, size_b: pd.Series, map_a: pd.Series, map_b: pd.Series) -> pd.Series:
        if not len(size_a):
            return pd.Series([], dtype=bool)
        left, right = map_a.str.len().to_numpy(), map_b.str.len().to_numpy()
        differ = np.zeros(len(size_a), np.int64)
        for width in {*zip(left, right)}:  # few: widths are powers of two, and near sizes have near ones
            at = np.flatnonzero((left == width[0]) & (right == width[1]))
            a, b = (_folded(m.iloc[at], min(width)) for m in (map_a, map_b))
            differ[at] = np.bitwise_count(a ^ b).sum(axis=1)
        total = size_a.to_numpy(np.int64) + size_b.to_numpy(np.int64)
        overlap = (total - differ) // 2
        return pd.Series(overlap >= join.threshold / (1 + join.threshold) * total - 1e-9)

    return bound


def _overlap(join: Join):
    """Exact intersection of the sorted shingle arrays of two texts, as similarity."""

    @F.pandas_udf(T.DoubleType())
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes = _Words()
        for lefts, rights in batches:
            out = []
            for at in range(0, len(lefts), 1000):
                left, right = lefts[at : at + 1000], rights[at : at + 1000]
                sets = {t: shingles(t, join.words, hashes) for t in {*left, *right}}
                for a, b in zip(left, right):
                    a, b = sets[a], sets[b]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    out.append(both / (len(a) + len(b) - both))
            yield pd.Series(out, dtype="float64")

    return similarity


def _only(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """The rows whose chunk_id may be wanted, by a bitmap of hashes; none that is wanted is lost.

    The bitmap has a fixed size (bits / 8 bytes, in rows of 4 KB), whatever is wanted, so it is collected
    and broadcast; it only spares the later exact join the texts that nobody wants.
    """
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(bits))
    marks = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).collect()
    packed = np.zeros(max(bits // 8, 4096), np.uint8)
    for m in marks:
        packed[(m["bucket"] - 1) * 4096 : m["bucket"] * 4096] = np.frombuffer(m["b"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(T.BooleanType())
    def marked(p: pd.Series) -> pd.Series:
        at = p.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return rows.where(marked(place))


class NearCopies(NamedTuple):
    members: DataFrame  # chunk_id, node: every text; texts of one node have the same shingles
    links: DataFrame  # node_a < node_b, similarity: every pair of different shingle sets over the threshold


def _rarest(posted: DataFrame, join: Join) -> DataFrame:
    """Of each node's shingles those that come first in order of rarity, as many as a pair over the threshold can't do without.

    Two sets whose intersection is at least threshold * the larger size share one of the first
    size - ceil(threshold * size) + 1 elements of both, in any order that is the same for all sets. The
    list that is sorted is as long as one text.
    """
    often = posted.groupBy("key").agg(F.count("*").alias("often"))
    alone = F.col("often") > 1  # a shingle of one node only meets none
    ranked = posted.join(often, "key").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("s"))
    first = F.slice("s", 1, (F.col("size") - F.ceil(F.lit(join.threshold) * F.col("size") - 1e-9) + 1).cast("int"))
    return ranked.select("node", "size", F.explode(first).alias("s")).select("node", "size", "s.key", "s.often").where(alone).drop("often")


_MET = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "node_a", "node_b")] + [T.StructField("size", T.IntegerType())])


def _pairs_of_runs(key: np.ndarray, node: np.ndarray, size: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within runs of one key, of nodes of near sizes."""
    left, right = [], []
    at, step = np.arange(len(key)), 1
    while len(at := at[at + step < len(key)]) and len(at := at[key[at + step] == key[at]]):
        a, b = size[at], size[at + step]
        near = np.minimum(a, b) >= join.threshold * np.maximum(a, b) - 1e-9
        left.append(at[near])
        right.append(at[near] + step)
        step += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def _met(posted: DataFrame, join: Join) -> DataFrame:
    """node_a < node_b of all nodes of near sizes that share a key.

    posted: key, node, size. The nodes of a tile come in order, and its pairs are made where they are; a
    tile of more than join.part nodes is handed on and joined with itself in parts, so that no tile is
    one task.
    """

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        crowd: list[int] = []  # the key of a crowded tile that may go on

        def settled(key: np.ndarray, node: np.ndarray, size: np.ndarray, crowds: list[int]) -> pa.RecordBatch:
            if len(key):
                fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
                key, node, size = key[fresh], node[fresh], size[fresh]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            lengths = np.diff(np.concatenate([starts, [len(key)]]))
            many = np.repeat((lengths > join.part) | np.isin(key[starts], crowds), lengths)
            k, n, s = key[~many], node[~many], size[~many]
            i, j = _pairs_of_runs(k, n, s, join)
            rest = int(many.sum())
            blank = lambda count: pa.nulls(count, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([blank(len(i)), pa.array(key[many])]), pa.concat_arrays([pa.array(n[i]), pa.array(node[many])]), pa.concat_arrays([pa.array(n[j]), blank(rest)]), pa.concat_arrays([pa.nulls(len(i), pa.int32()), pa.array(size[many])])],
                names=[f.name for f in _MET],
            )

        for batch in batches:
            key, node, size = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns))
            last, before = int(np.searchsorted(key, key[-1])) if len(key) else 0, crowd
            if len(key) - last > join.part or (crowd and len(key) and key[-1] == crowd[0]):
                crowd, last = [key[-1]], len(key)
            elif last:
                crowd = []
            held = [key[last:], node[last:], size[last:]]
            yield settled(key[:last], node[:last], size[:last], before + crowd)
        yield settled(*held, crowd)

    ordered = posted.select("key", "node", "size").repartition("key").sortWithinPartitions("key", "node")
    found = stored(ordered.mapInArrow(tiles, _MET))
    crowded = found.where(F.col("key").isNotNull()).select("key", F.col("node_a").alias("node"), "size").distinct()
    parts = crowded.groupBy("key").agg(F.ceil(F.count("*") / join.part).cast("int").alias("parts"))
    both = crowded.join(parts, "key")
    a = both.select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("node").alias("node_a"), F.col("size").alias("s_a")).repartition("key", "part")
    b = both.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("node_b"), F.col("size").alias("s_b")).repartition("key", "part")
    more = a.join(b, ["key", "part"]).where((F.col("node_a") < F.col("node_b")) & (F.least("s_a", "s_b") >= F.lit(join.threshold) * F.greatest("s_a", "s_b") - 1e-9)).select("node_a", "node_b")
    return found.where(F.col("key").isNull()).select("node_a", "node_b").unionByName(more).distinct()


def near_copies(chunks: DataFrame, join: Join = Join()) -> NearCopies:
    """Exact copies as classes and near-copies as links between classes.

    Texts are compared in whole, by runs of a-z and 0-9 of their lower case. NULL ids, NULL texts and
    texts with fewer words than a shingle have no part; repeated rows count once, since members are
    distinct; extra columns are ignored; an empty table gives no members and no links.

    Texts with the same shingles are one node from the start, so a group of copies of any size costs one
    node. Nodes meet in tiles of equal banded min-hash keys (or of equal rare shingles, `Join.exact`);
    only nodes of near sizes (the smaller set has at least `threshold` of the larger) become a pair of a
    tile. A pair must pass the bit counts of the hashed bitmaps, which bound the overlap from above, and
    then the exact intersection. No partner list is capped and nothing comes to the driver.

    Signatures are written once to the shared folder, for the text is the costly part to read.
    """
    signed = stored(signatures(chunks, join))
    nodes = signed.groupBy("node").agg(F.min("chunk_id").alias("rep"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"))
    keyed = signed.select("node", "size", F.explode("keys").alias("key"))
    met = _met(_rarest(keyed.distinct(), join) if join.exact else keyed, join)
    side = lambda x: nodes.select(F.col("node").alias(f"node_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "size", "bitmap")))
    paired = met.join(side("a"), "node_a").join(side("b"), "node_b")
    likely = stored(paired.where(_may_match(join)("size_a", "size_b", "bitmap_a", "bitmap_b")).select("node_a", "node_b", "rep_a", "rep_b"))
    wanted = likely.select(F.explode(F.array("rep_a", "rep_b")).alias("chunk_id")).distinct()
    texts = _only(chunks.select("chunk_id", "text").where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()), wanted, join.filter_bits).join(wanted, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    text = lambda x: texts.select(F.col("chunk_id").alias(f"rep_{x}"), F.col("text").alias(f"text_{x}"))
    scored = likely.join(text("a"), "rep_a").join(text("b"), "rep_b").select("node_a", "node_b", _overlap(join)("text_a", "text_b").alias("similarity"))
    links = scored.where(F.col("similarity") >= join.threshold - 1e-12)
    return NearCopies(signed.select("chunk_id", "node").distinct(), links)


def pairs(found: NearCopies) -> DataFrame:
    """All pairs of chunk_ids over the threshold: chunk_id_a < chunk_id_b. Copies are expanded only here."""
    m = found.members
    a, b = m.select(F.col("node").alias("node_a"), F.col("chunk_id").alias("x")), m.select(F.col("node").alias("node_b"), F.col("chunk_id").alias("y"))
    linked = found.links.select("node_a", "node_b").join(a, "node_a").join(b, "node_b")
    same = a.join(b, F.col("node_a") == F.col("node_b")).where("x < y")
    both = linked.select("x", "y").unionByName(same.select("x", "y"))
    return both.where("x <> y").select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def classes(found: NearCopies) -> DataFrame:
    """One row per chunk: chunk_id, class_id (least chunk_id with the same shingles), copies, links (near classes)."""
    by_node = found.members.groupBy("node").agg(F.min("chunk_id").alias("class_id"), F.count("*").alias("copies"))
    ends = found.links.select(F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return found.members.join(by_node, "node").join(ends, "node", "left").select("chunk_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
