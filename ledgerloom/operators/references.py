"""Problem 6: references to rows that are missing, deleted or came later."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Reference(NamedTuple):
    """One foreign key: a field of a child table and the key of its parent."""

    child: str
    field: str
    parent: str
    parent_key: str
    parent_time: str
    uuid: bool = False


REFERENCES = (
    Reference("rag_chunks", "doc_id", "rag_documents", "id", "created_at"),
    Reference("rag_chunks", "qdrant_id", "chunks", "chunk_id", "loaded_at", uuid=True),
    Reference("rag_documents", "company_id", "rag_companies", "id", "created_at"),
)


def key_text(c: str | Column, uuid: bool) -> Column:
    """A key as comparable text: UUIDs without case, hyphens, braces, prefix and spaces; others trimmed."""
    text = F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    if not uuid:
        return text
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"^urn:uuid:", ""), r"[\s{}()-]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(F.lower(text))


def references(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """All references of all child rows, one scan of each child: child_table, ref_field, child_id, key, at."""
    out = []
    for child in dict.fromkeys(r.child for r in refs):
        own = [r for r in refs if r.child == child]
        each = F.array(*(F.struct(F.lit(r.field).alias("ref_field"), key_text(r.field, r.uuid).alias("key")) for r in own))
        out.append(
            tables[child].select(F.lit(child).alias("child_table"), F.col("id").alias("child_id"), F.col("created_at").alias("at"), F.explode(each).alias("ref"))
            .select("child_table", "ref.ref_field", "child_id", "ref.key", "at").where(F.col("key").isNotNull())
        )
    return reduce(DataFrame.unionByName, out).dropDuplicates(["child_table", "ref_field", "child_id", "key", "at"])


def key_facts(tables: dict[str, DataFrame], deleted: DataFrame, refs: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """What is known of each key: there (a parent row has it), since (its earliest time), gone (logged as deleted)."""
    there = [
        tables[r.parent].select(F.lit(r.child).alias("child_table"), F.lit(r.field).alias("ref_field"), key_text(r.parent_key, r.uuid).alias("key"), F.col(r.parent_time).alias("since"), F.lit(True).alias("there"))
        for r in refs
    ]
    parents = {r.parent: r for r in refs}
    log = deleted.select("table_name", "row_key").where(F.col("table_name").isin(*parents))
    named = F.array(*(F.struct(F.lit(r.parent).alias("parent"), F.lit(r.child).alias("child_table"), F.lit(r.field).alias("ref_field"), key_text("row_key", r.uuid).alias("key")) for r in refs))
    gone = log.select("table_name", F.explode(named).alias("k")).where(F.col("k.parent") == F.col("table_name")).select("k.child_table", "k.ref_field", "k.key", F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(False).alias("there"))
    return (
        reduce(DataFrame.unionByName, [*there, gone]).where(F.col("key").isNotNull())
        .groupBy("child_table", "ref_field", "key").agg(F.bool_or("there").alias("there"), F.min("since").alias("since"), F.bool_or(~F.col("there")).alias("gone"))
    )


def _reason(at: str = "at") -> Column:
    """NULL where the reference holds."""
    there = F.coalesce("there", F.lit(False))
    return F.when(there & (F.col("since") > F.col(at)), "late").when(there, None).when(F.coalesce("gone", F.lit(False)), "deleted").otherwise("missing")


_KEY = ["child_table", "ref_field", "key"]


class Suspects(NamedTuple):
    """Pre-aggregated references (key, month, n, first and last time) that may be orphans, with what is known of their key."""

    heavy: DataFrame
    rest: DataFrame


def suspects(refs: DataFrame, facts: DataFrame, heavy_share: float = 0.001) -> Suspects:
    """References are counted per key and month, with partial aggregation before the shuffle; only these counts meet the parents.

    Keys with more than `heavy_share` of all references are heavy; there can be no more than
    1 / heavy_share of them, which bounds what is broadcast whatever the data. Their facts are broadcast;
    the counts of all other keys go through a shuffle join, in which no key has more than its share.
    """
    counted = refs.groupBy(*_KEY, F.date_trunc("month", "at").alias("month")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    per_key = counted.groupBy(*_KEY).agg(F.sum("n").alias("n"))
    total = per_key.agg(F.sum("n").alias("total")).first()["total"] or 0
    heavy = per_key.where(F.col("n") > max(1.0, heavy_share * total)).select(*_KEY)
    facts_of_heavy = F.broadcast(heavy.join(facts, _KEY, "left").withColumn("heavy", F.lit(True)))
    marked = counted.join(facts_of_heavy, _KEY, "left")
    known = marked.where(F.col("heavy")).drop("heavy")
    rest = marked.where(F.col("heavy").isNull()).select(*counted.columns).join(facts, _KEY, "left")
    may = ~F.coalesce("there", F.lit(False)) | F.coalesce(F.col("since") > F.col("first"), F.lit(False))
    return Suspects(known.where(may), rest.where(may))


def orphans(refs: DataFrame, facts: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """Every orphan reference: child_table, ref_field, child_id, at, reason.

    The keys that the pre-aggregated references (`suspects`) don't find in time are joined back to the
    rows: heavy ones broadcast, so that rows with a heavy key are never shuffled by key, the others by a
    shuffle join; both are united.

    NULL keys refer to nothing; a NULL time is never late; repeated rows count once; empty tables
    give no rows (without parents every reference is missing).
    """
    found = suspects(refs, facts, heavy_share)
    own = lambda df: df.select(*_KEY, "there", "since", "gone").distinct()
    columns = ["child_table", "ref_field", "child_id", "at"]
    first = refs.join(F.broadcast(own(found.heavy)), _KEY)  # no more rows than there are heavy keys
    rest = refs.join(own(found.rest), _KEY)
    return first.unionByName(rest).select(*columns, _reason().alias("reason")).where(F.col("reason").isNotNull())


def orphan_counts(refs: DataFrame, facts: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """Orphans per child table, field, month of the child row (NULL if unknown) and reason, from the pre-aggregated references.

    A key's references of a month are all late or none, unless the parent came between the first and the
    last of them: only those are counted row by row.
    """
    found = suspects(refs, facts, heavy_share)
    both = found.heavy.unionByName(found.rest)
    split = F.coalesce("there", F.lit(False)) & F.coalesce(F.col("since") <= F.col("last"), F.lit(False))
    whole = both.where(~split).select("child_table", "ref_field", "month", _reason("last").alias("reason"), "n")
    part = refs.join(both.where(split).select(*_KEY, "month", "there", "since", "gone"), _KEY).where(F.date_trunc("month", "at") == F.col("month"))
    rows = part.select("child_table", "ref_field", "month", _reason().alias("reason"), F.lit(1).cast("bigint").alias("n"))
    return whole.unionByName(rows).where(F.col("reason").isNotNull()).groupBy("child_table", "ref_field", F.date_format("month", "yyyy-MM").alias("period"), "reason").agg(F.sum("n").alias("orphans"))
