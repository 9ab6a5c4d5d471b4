from datetime import datetime as t

from ledgerloom.operators import references as r

CHUNKS = "id int, doc_id int, qdrant_id string, created_at timestamp_ntz, key string"
DOCS = "id int, company_id int, created_at timestamp_ntz"


def tables(spark, hot=0):
    a, b = t(2024, 1, 1), t(2024, 2, 1)
    uuid = "06d4c384-0e9e-4fa6-a32d-f07e8b839bee"
    rows = [(1, 1, uuid.upper(), a, "x"), (1, 1, uuid.upper(), a, "x"), (2, 9, "{" + uuid + "}", b, None), (3, None, None, None, None), (4, 8, "urn:uuid:" + uuid.replace("-", ""), b, ""), (5, 1, "", None, "")]
    rows += [(100 + i, 77, None, b, "") for i in range(hot)]
    return {
        "rag_chunks": spark.createDataFrame(rows, CHUNKS),
        "rag_documents": spark.createDataFrame([(1, 1, b), (7, 5, None)], DOCS),
        "chunks": spark.createDataFrame([(uuid, a)], "chunk_id string, loaded_at timestamp_ntz"),
        "rag_companies": spark.createDataFrame([(1, b)], "id int, created_at timestamp_ntz"),
    }, spark.createDataFrame([("rag_documents", "9", b)], "table_name string, row_key string, deleted_at timestamp_ntz")


def found(spark, hot=0, **kw):
    t_, deleted = tables(spark, hot)
    return r.orphans(r.references(t_), r.key_facts(t_, deleted), **kw)


EXPECTED = {
    ("rag_chunks", "doc_id", 1, "late"), ("rag_chunks", "doc_id", 2, "deleted"), ("rag_chunks", "doc_id", 4, "missing"), ("rag_chunks", "qdrant_id", 5, "missing"), ("rag_documents", "company_id", 7, "missing"),
}


def rows(df):
    return sorted(tuple(x) for x in df.select("child_table", "ref_field", "child_id", "reason").collect())


def test_reasons(spark):
    assert rows(found(spark)) == sorted(EXPECTED)


def test_heavy_keys_agree_with_the_plain_join(spark):
    hot = {("rag_chunks", "doc_id", 100 + i, "missing") for i in range(50)}
    assert rows(found(spark, 50)) == rows(found(spark, 50, heavy_share=1.0)) == sorted(EXPECTED | hot)


def counts(spark, hot=0, **kw):
    t_, deleted = tables(spark, hot)
    return {tuple(x) for x in r.orphan_counts(r.references(t_), r.key_facts(t_, deleted), **kw).collect()}


def test_counts_agree_with_the_rows(spark):
    """A parent that comes between two references of one month makes only the earlier one late."""
    child = [(i, 1 + i % 3, None, at, "") for i, at in enumerate([t(2024, 1, 3), t(2024, 1, 20), t(2024, 1, 20), t(2024, 2, 1), None, t(2024, 1, 1), t(2024, 3, 9)] * 3)]
    tables_ = {
        "rag_chunks": spark.createDataFrame(child, CHUNKS), "rag_documents": spark.createDataFrame([(1, None, t(2024, 1, 10)), (2, None, t(2024, 2, 5)), (2, None, t(2024, 2, 6))], DOCS),
        "chunks": spark.createDataFrame([], "chunk_id string, loaded_at timestamp_ntz"), "rag_companies": spark.createDataFrame([], "id int, created_at timestamp_ntz"),
    }
    none = spark.createDataFrame([], "table_name string, row_key string, deleted_at timestamp_ntz")
    given = r.references(tables_), r.key_facts(tables_, none)
    for share in (0.001, 0.2, 1.0):
        want = {}
        for x in r.orphans(*given, heavy_share=share).collect():
            k = (x.child_table, x.ref_field, x["at"] and x["at"].strftime("%Y-%m"), x.reason)
            want[k] = want.get(k, 0) + 1
        assert {tuple(x)[:4]: x.orphans for x in r.orphan_counts(*given, heavy_share=share).collect()} == want and ("rag_chunks", "doc_id", "2024-01", "late") in want
    assert counts(spark, 50) == counts(spark, 50, heavy_share=1.0)


def test_report_and_empty(spark):
    report = counts(spark)
    assert ("rag_chunks", "doc_id", "2024-01", "late", 1) in report and ("rag_documents", "company_id", None, "missing", 1) in report
    t_, deleted = tables(spark)
    empty = {k: v.limit(0) for k, v in t_.items()}
    assert r.orphans(r.references(empty), r.key_facts(empty, deleted.limit(0))).count() == 0
    assert r.orphan_counts(r.references(empty), r.key_facts(empty, deleted.limit(0))).count() == 0
