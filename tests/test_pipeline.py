import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as t
from ledgerloom.operators import bridge, cache, chunking, evaluate, fusion, ledger, prompt, retrieval, understand
from ledgerloom.operators.catalog import KINDS, TABLES, TEXT_KINDS
from ledgerloom.sources import objects


def column(spark, c, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(c(F.col("x"))).collect()]


def test_cleaning(spark):
    assert column(spark, lambda c: t.clean(c, aggressive=True), "ﬁne  “text”\n\n\n\nPage 2 of 9\n  12  \nRs 5 Cr of sales", None) == ["fine \"text\"\n\nRs 5 Crore of sales", None]
    assert column(spark, lambda c: F.size(t.words(c)), "a b  c", "", "   ") == [3, 0, 0] and column(spark, t.is_garbage, "word " * 20, "word " * 19, "1 " * 30 + "a") == [False, True, True]
    assert column(spark, lambda c: t.tokens(c, True), "Up 5% and 12%.")[0] == ["up", "5", "and", "12"] and column(spark, t.sentences, "One. Two! Three")[0] == ["One.", "Two!", "Three"]


def test_windows_and_tables(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, "x"), (3, ""), (4, None)], "id int, text string")
    got = {(r.id, r.window_no): r.window_text.split() for r in chunking.windows(df, size=10, overlap=3).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)] and got[(1, 1)][0] == "7" and got[(1, 3)][-1] == "24"
    for n, full, compat in ((9, 9, 8), (17, 17, 16), (1, 1, 1), (8, 8, 8)):
        rows = spark.createDataFrame([([[str(i)] for i in range(n)],)], "table_data array<array<string>>")
        for flag, want in ((False, full), (True, compat)):
            seen = {c for r in chunking.row_groups(rows, compat=flag).collect() for row in r.group_rows for c in row}
            assert len(seen) == want, (n, flag)


def test_turns_and_roles(spark):
    assert chunking.split_turns("Ravi Kumar: Hello.\nAnita Mehta - Thanks.\n") == [("Ravi Kumar", "Hello."), ("Anita Mehta", "Thanks.")] and chunking.split_turns("no label here") == [(None, "no label here")] and chunking.split_turns(None) == []
    assert column(spark, chunking.speaker_role, "Conference Operator", "CFO", "Blue Securities", None) == ["moderator", "management", "analyst", "unknown"]


def test_bridge(spark):
    assert len(TABLES) == 21 and len(KINDS) == 96 and len(TEXT_KINDS) == 9 and KINDS["repo_rate"].value == "repo_rate"
    atoms = [bridge.Atom("revenue", "comparative", symbols=("A", "B")), bridge.Atom("mda", "qualitative"), bridge.Atom("nothing"), bridge.Atom("dividend", symbol="a")]
    assert [a.symbol for a in bridge.expand(atoms[:1])] == ["A", "B"] and [bridge.channel(a) for a in atoms] == ["sql", "vector", "sql", "sql"]
    actions = spark.createDataFrame([("A", "2024-01-01", "Dividend", 5.0), ("A", "2024-02-01", "Split", 2.0), ("B", "2024-02-01", "Dividend", 9.0)], "symbol string, action_date string, action_type string, value double").withColumn("action_date", F.to_date("action_date"))
    got = bridge.fetch(atoms, {"corporate_actions": actions})
    assert [f.error is None for f in got] == [False, False, False, True] and [r.value for r in got[-1].rows.collect()] == [5.0]
    assert spark.createDataFrame([(1, 2020), (2, 2023)], "a int, year int").where(bridge.payload_filter({"a": [1, 2], "year": {"$gte": 2021}})).count() == 1 and bridge.year_filter("abc", [2020]) == {"symbol": "ABC", "year": 2020}


def test_ledger(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 1), (None, 4)], "k string, v int")
    assert [tuple(r) for r in ledger.insert_if_absent(old, new, "k", ["v"]).collect()] == [("b", 1)] and {tuple(r) for r in ledger.upsert_latest(old, new.where("k is not null"), "k", ["v"]).collect()} == {("a", 2), ("b", 3)}
    kept, counts = ledger.delete_where(new, F.col("k") == "b")
    assert kept.count() == 2 and tuple(counts.first()) == (2, 2)
    assert column(spark, ledger.document_class, "Annual Report 2024", "Q3 Transcript", "Transcript of annual report", "Notice") == ["annual_report", "concall", "concall", "other"]
    page = '<a href="/a/ar2023.pdf">Annual <b>Report</b> 2022-23</a><a href="http://x/b.pdf">annual report 2022-23</a><a href="mailto:x">concall</a><a href="c.pdf">Q2 FY24 Transcript</a><a href="z">Notice</a>'
    got = [tuple(r)[1:] for r in ledger.links(spark.createDataFrame([(1, "https://site.in/co", page)], "page_id int, url string, html string")).orderBy("year").collect()]
    assert got == [("https://site.in/a/ar2023.pdf", "Annual Report 2022-23", 2023, "annual_report"), ("https://site.in/c.pdf", "Q2 FY24 Transcript", 2024, "concall")]


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(300)] + [(999, None)], "item_id bigint, vector array<double>")
    q = v.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    big, tiles = ({tuple(r) for r in retrieval.cosine_topk(q, v, 5, *block).collect()} for block in ((4096, 1024), (64, 4)))
    assert big == tiles and len(big) == 75
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog bird"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.bm25 for r in retrieval.bm25(docs, spark.createDataFrame([(1, "cat cat")], "query_id int, query string")).collect()}
    assert list(got) == [1] and got[1] == pytest.approx(2 * math.log(3.5 / 1.5 + 1) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.25)), rel=1e-3)
    assert retrieval.bm25(docs.limit(0), spark.createDataFrame([(1, "cat")], "query_id int, query string")).count() == 0


def test_claims(spark):
    chunks = spark.createDataFrame([(1, "We expect net profit margin of 22-23% next year. Revenue was Rs 15,000 crore in May. Revenue grew 12 percent."), (2, None)], "chunk_id int, text string")
    got = {(r.sub_type, r.value_low, r.value_high, r.unit, r.is_forward) for r in fusion.claims_of_text(chunks).collect()}
    assert ("opm", 22.0, 23.0, "%", True) in got and ("revenue", 15000.0, None, "crore", False) in got and not any(g[1] == 12.0 for g in got)
    rows = spark.createDataFrame([(1, "a", 20.0, "crore"), (2, "b", 79000.0, "crore"), (3, "c", 1.0, "crore"), (4, "d", 5.0, "crore"), (5, "a", None, "crore"), (6, "e", 1.0, "crore")], "row_id int, sub_type string, value double, unit string")
    claims = spark.createDataFrame([(1, "a", 2000.0, None, "lakh", False, "management", 0.1), (2, "a", 99.0, None, "crore", False, "analyst", 0.9), (3, "b", 50000.0, None, "crore", False, None, None), (4, "c", 1.0, None, "crore", True, "ceo", 0.5), (5, "d", 5.5, 6.0, "crore", False, "cfo", 0.5), (6, "z", 1.0, None, "%", True, None, 0.1)], "claim_id int, sub_type string, value_low double, value_high double, unit string, is_forward boolean, speaker_role string, chunk_score double")
    found = {r.row_id: (r.insight, r.claim_id, r.divergence_pct) for r in fusion.cross_reference(rows, claims).collect()}
    assert found == {1: ("CONFIRM", 1, 0.0), 2: ("CONTRADICT", 3, 36.71), 3: ("FORWARD", 4, None), 4: ("CONTRADICT", 5, 15.0), 6: ("UNMATCHED", None, None)} and [r.claim_id for r in fusion.orphan_outlooks(rows, claims).collect()] == [6]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(q, i, i) for q in (1, 2) for i in range(1, 21)], "query_id int, item_id int, rank int")
    relevant = spark.createDataFrame([(1, 3, 1), (1, 7, 1), (2, 99, 1)], "query_id int, item_id int, gain int")
    got = {(r.query_id, r.k): r for r in evaluate.metrics_at(ranked, relevant).collect()}
    assert (got[(1, 10)].hit, got[(1, 10)].mrr, got[(1, 10)].precision, got[(2, 10)].hit, got[(1, 5)].precision, got[(2, 10)].first_hit) == (1, 0.333333, 0.2, 0, 0.2, None)
    means = {(r.metric, r.k): (r.value, r.band) for r in evaluate.aggregated(evaluate.metrics_at(ranked, relevant)).collect()}
    assert means[("hit", 10)] == (0.5, "fail") and means[("mrr", 10)][0] == 0.1667


def test_cache(spark):
    e = spark.createDataFrame([(1, "k", "A", "both", "2024-01-01 00:00:00", "old"), (2, "k", "A", "both", "2024-01-05 00:00:00", "new"), (3, "x", "B", "both", "2023-01-01 00:00:00", "gone")], "entry_id int, key string, symbol string, doc_type string, stored_at string, response string").withColumn("stored_at", F.col("stored_at").cast("timestamp"))
    q = spark.createDataFrame([(1, "k"), (2, "x"), (3, None)], "question_id int, key string")
    assert {tuple(r)[1:] for r in cache.lookup(q, e, F.lit("2024-01-06 00:00:00").cast("timestamp")).collect()} == {(1, "new", True), (2, None, False), (3, None, False)}
    assert cache.invalidated(e, "a").count() == 1 and cache.invalidated(e).count() == 0 and cache.stored(e, e.limit(0)).count() == 2


def test_questions():
    y = understand.year_intent
    assert y("last two years") == ([2024, 2025],) * 2 and y("FY23 to FY25")[0] == [2023, 2024, 2025] and y("2019-2021")[0] == [2019, 2020, 2021] and y("FY22 and FY24") == ([2022, 2024],) * 2 and y("how is it") == ([2023, 2024, 2025], []) and y("in 2021")[1] == [2021]
    assert understand.onward("margin since FY23") == "margin FY2023, FY2024, FY2025" and understand.onward("from FY30 onward") == "from FY30 onward"
    kinds = lambda q: {a.sub_type for a in understand.decompose(q)}
    assert {"revenue"} <= kinds("Show sales for FY24") and {"ebitda", "ebitda_proxy"} <= kinds("EBITDA FY22 to FY24") and "risk_factors" in kinds("main risks?") and "fii" in kinds("FII holding") and kinds("hello") == set()
    assert [a.source for a in understand.decompose("hello", "X", lambda q: [bridge.Atom("eps")])] == ["model"]


def test_prompt():
    rows = [{"symbol": "A", "metric": "Revenue", "period": "2024-03-31", "value": 23452.0, "unit": "crore"}, {"symbol": "A", "metric": "Margin", "value": 54.7, "unit": "%"}]
    assert "₹23,452.0 cr" in prompt.figures(rows) and "54.70%" in prompt.figures(rows) and "[SQL-2]" in prompt.figures(rows)
    chunks = [{"text": "x" * 600, "score": 0.5, "symbol": "A"} for _ in range(20)]
    assert 1 <= len(prompt.trimmed(chunks, 3000)) < 20 and prompt.trimmed(chunks, 0) == [] and len(prompt.trimmed(chunks, 1)) == 1
    broken = lambda *a: 1 / 0
    modes = [prompt.answer("revenue?", "A", r, i, c)["mode"] for r, i, c in ((lambda a: rows, lambda *a: [{"type": "CONFIRM", "note": "n"}], lambda *a: chunks), (broken, lambda *a: [{"type": "FORWARD"}], lambda *a: chunks), (broken, broken, lambda *a: chunks), (broken, broken, broken))]
    assert modes == ["full", "no_sql", "vector_only", "minimal"]
    calls, kept = [], {}
    f = prompt.cached(kept.get, kept.__setitem__)(lambda q, **kw: calls.append(q) or q.upper())
    assert f("a", symbol="x", years=[2, 1]) == f(" a ", symbol="X", years=[1, 2]) == "A" and len(calls) == 1


def test_files(spark, tmp_path):
    folder = tmp_path / "bucket" / "acme"
    folder.mkdir(parents=True)
    (folder / "2024_Annual Report.pdf").write_bytes(b"PART ONE\n\nSome prose.\n\nA | B")
    (folder / "x.html").write_bytes(b"<html><p>One</p><p>Two &amp; three</p></html>")
    listed = objects.list_objects(spark, str(tmp_path)).first()
    assert (listed.key_symbol, listed.key_title, listed.key_year) == ("ACME", "2024_Annual Report", 2024) and objects.list_objects(spark, str(tmp_path), year=2020).count() == 0
    got = objects.extract(spark, str(tmp_path)).orderBy("path", "block_index").collect()
    assert [(r.block_type, r.text) for r in got] == [("section_header", "PART ONE"), ("prose", "Some prose."), ("table", "A | B"), ("prose", "One"), ("prose", "Two & three")]
    (tmp_path / "g.csv").write_text('query,symbol,doc_type,years,relevant_ids\nq1,A,both,"[2024]","[""a"",""b""]"\nq2,,both,,"c, d"\nq3,A,both,,\n')
    assert [(r.query, r.symbol, r.relevant_ids) for r in objects.golden_csv(spark, str(tmp_path / "g.csv")).orderBy("query").collect()] == [("q1", "A", ["a", "b"]), ("q2", None, ["c", "d"])]


def test_streams(spark, tmp_path, small):
    from ledgerloom.streaming import ingest

    events = spark.read.parquet(f"{small}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("append").parquet(str(tmp_path / "in"))
    events.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.stream(spark, events.schema, str(tmp_path / "in"))
    state = {}

    def write(df):
        df.write.mode("overwrite").parquet(path := str(tmp_path / f"t{len(state)}"))
        state[len(state)] = path

    read = lambda: spark.read.parquet(state[len(state) - 1]) if state else None
    ingest.upserts(stream, read, write, "user_id", ["ts", "event_id"], str(tmp_path / "c")).awaitTermination(120)
    last = {r.user_id: r.event_id for r in read().collect()}
    want = {r.user_id: r.event_id for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()}
    assert last == want
    q = ingest.counts(ingest.first_seen(stream, "event_id", "ts"), "ts", "event_type", late=None).writeStream.format("memory").queryName("n").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert 0 < spark.sql("select sum(n) from n").first()[0] <= events.count()


def test_absent_companies_are_looked_up_in_all(spark, tmp_path):
    from ledgerloom.plans import warehouse

    spark.createDataFrame([(1, "ABC"), (2, "abcd "), (3, None)], "id int, symbol string").write.parquet(f"{tmp_path}/rag_companies.parquet")
    spark.createDataFrame([(1, "ABC"), (2, "ABCD"), (5, "XYZ"), (4, "xyz"), (6, "UVWX"), (7, " "), (8, None)], "id int, symbol string").write.parquet(f"{tmp_path}/rag_documents.parquet")
    assert {tuple(x) for x in warehouse.insert_if_absent(spark, str(tmp_path)).collect()} == {("XYZ", 4), ("UVWX", 6)}


def test_nearest_entry_is_sought_in_all(spark, tmp_path):
    from ledgerloom.plans import retrieval

    vectors = [(0, [1.0, 0.0], 1), (60, [0.8, 0.6], 1), (3, [0.6, 0.8], 1), (20, [1.0, 0.0], 2), (7, [0.0, 1.0], 3)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.question_id: (x.entry_id, x.similarity, x.hit) for x in retrieval.cache_semantic(spark, str(tmp_path)).collect()}
    assert got == {0: (60, 0.8, True), 60: (3, 0.96, True)}
