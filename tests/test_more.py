"""Operators of fusion, dispatch, evaluation, ledger, prompts and ingestion on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import cli
from ledgerloom.functions.fiscal import year_of_title
from ledgerloom.operators import bridge, cache, evaluate, fusion, ledger, prompt, retrieval, understand
from ledgerloom.session import cut, settings_from, shared_folder, stored
from ledgerloom.sources import objects
from ledgerloom.streaming.ingest import ingest


def test_titles(spark):
    cases = {"Q3 FY24 call": 2024, "Q1-FY-2023": 2023, "Report FY-24": 2024, "fy 22": 2022, "Annual 2023-24": 2024, "Annual 2023/24": 2024, "2021–2022": 2022, "Report 2019": 2019, "none": None, None: None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "title string, want int").select("title", "want", year_of_title("title").alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows


def test_years_of_questions():
    y = understand.year_intent
    assert y("past 2 years")[0] == y("previous two years")[0] == y("recent 2 years")[0] == [2024, 2025] and y("FY23/25")[0] == [2023, 2024, 2025] and y("year 2024 and 2022") == ([2024], [2024]) and y("FY-21 to FY-22")[0] == [2021, 2022]
    assert understand.named_years("FY23 to FY25") == [2023, 2024, 2025] and understand.named_years("FY23 to FY25", compat=True) == [2023, 2025] and understand.named_years("FY 2023-25", compat=True) == [2023, 2024] and understand.named_years("FY 2023-25") == [2023, 2024, 2025]
    s = understand.summary(understand.decompose("Show revenue and risks of FY24", "abc"))
    assert s["years"] == [2024] and s["symbols"] == ["abc"] and s["channels"] == ["sql", "vector"] and s["needs"]["quantitative"] >= 1


def points(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        kind = "concall" if i % 3 == 0 else "annual_report"
        rows.append((i, f"revenue growth text {i} " + "guidance " * (i % 4), [float(x) for x in rng.normal(size=4)], kind, "AbC " if i % 5 else "other", 2018 + i % 7, "management" if i % 2 else "moderator"))
    return spark.createDataFrame(rows, "item_id bigint, text string, vector array<double>, doc_type string, symbol string, year int, speaker_role string"), rows


def test_retrieval_dispatch(spark):
    pts, rows = points(spark)
    questions = spark.createDataFrame(
        [(1, "revenue", "annual_report", "abc", 2020, None, None, None), (2, "revenue", "concall", "abc", None, 2030, 2031, "management"), (3, "revenue in FY21", "both", "ABC", None, None, None, "analyst"), (4, "revenue", "annual_report", None, None, 2018, 2024, None), (5, "revenue", "concall", "nobody", 2020, None, None, None)],
        "query_id int, query string, doc_type string, symbol string, year int, year_from int, year_to int, speaker_role string",
    )
    vector = [1.0, 0.5, -0.2, 0.1]
    fixed = lambda text: F.when(text.isNotNull(), F.array(*map(F.lit, vector)))
    unit = lambda v: np.array(v) / np.linalg.norm(v)

    def brute(kind, symbol, keep, k):
        own = [(-round(float(unit(vector) @ unit(r[2])), 6), r[0]) for r in rows if r[3] == kind and (symbol is None or r[4].strip().upper() == symbol) and keep(r)]
        return [i for _, i in sorted(own)[:k]]

    for tiles in ({}, {"item_block": 7, "query_block": 2}):
        got = {}
        for r in retrieval.retrieve(questions, pts, fixed, k_annual=10, k_call=6, least=4, **tiles).collect():
            got.setdefault((r.query_id, r.doc_type), []).append(r)
        ids = {k: ({r.item_id for r in v}, v[0].widened) for k, v in got.items()}
        in_2020 = brute("annual_report", "ABC", lambda r: r[5] == 2020, 10)
        assert ids[(1, "annual_report")] == (set(in_2020), False) if len(in_2020) >= 4 else ids[(1, "annual_report")] == (set(brute("annual_report", "ABC", lambda r: True, 10)), True)
        assert ids[(2, "concall")] == (set(brute("concall", "ABC", lambda r: True, 6)), True)  # nothing in those years: year and role go
        assert ids[(3, "concall")][1] and ids[(3, "annual_report")] == ((set(x), False) if len(x := brute("annual_report", "ABC", lambda r: r[5] == 2021, 10)) >= 4 else (set(brute("annual_report", "ABC", lambda r: True, 10)), True))
        assert ids[(4, "annual_report")] == (set(brute("annual_report", None, lambda r: True, 10)), False) and not any(k[0] == 5 for k in ids)
        ranks = [r.rank for r in sorted(got[(4, "annual_report")], key=lambda r: (-r.score, r.item_id))]
        assert ranks == list(range(1, 11)) and got[(3, "concall")][0].explicit == [2021]
    needs = spark.createDataFrame([(1, "Revenue", "revenue", "qualitative", "mda", "A", [2020, 2022]), (2, "Outlook", "capex plans", "forward_looking", "capex", "A", None), (3, "Margin", None, "qualitative", "concall_margin", None, [2021])], "query_id int, metric string, raw_text string, need_type string, sub_type string, symbol string, years array<int>")
    asked = {r.query_id: (r.query, r.doc_type, r.year_from, r.year_to) for r in retrieval.questions_of_needs(needs, ("concall_margin",)).collect()}
    assert asked == {1: ("Revenue", "annual_report", 2020, 2022), 2: ("Outlook capex plans", "concall", None, None), 3: ("Margin", "concall", 2021, 2021)}


def test_retrieval_shuffles_no_texts(spark):
    """Three hundred questions that ask the same: one answer, and texts aren't shuffled for each of them."""
    rng = np.random.default_rng(5)
    rows = [(i, "revenue growth " + " ".join(map(str, rng.integers(0, 1 << 60, 500))), [float(x) for x in rng.normal(size=4)], "annual_report", "abc", 2020, None) for i in range(40)]
    pts = spark.createDataFrame(rows, "item_id bigint, text string, vector array<double>, doc_type string, symbol string, year int, speaker_role string")
    questions = spark.range(300).selectExpr("id as query_id", "'revenue' as query", "'annual_report' as doc_type", "'ABC' as symbol", "2020 as year")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables too large for it
    before = shuffled()
    got = {}
    for r in retrieval.retrieve(questions, pts, lambda text: F.when(text.isNotNull(), F.array(*map(F.lit, (1.0, 0.5, -0.2, 0.1)))), k_annual=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.item_id, r.vector_score, r.bm25, r.score))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled() - before < 2_000_000  # the texts of all candidates are 57 MB
    assert len(got) == 300 and {tuple(sorted(v)) for v in got.values()} == {tuple(sorted(got[0]))} and [r[0] for r in sorted(got[0])] == [*range(1, 21)]


def test_tiles_of_hot_keys_agree(spark):
    pts, _ = points(spark)
    e = pts.select(F.col("item_id").alias("entry_id"), F.lit("A").alias("symbol"), F.lit("b").alias("doc_type"), "vector", F.array("year").alias("years"))
    q = e.withColumnRenamed("entry_id", "question_id")
    whole, cut_ = ({tuple(r) for r in cache.nearest(q, e, 0.2, True, **b).collect()} for b in ({}, {"item_block": 5, "query_block": 3}))
    assert whole == cut_ and len(whole) == 60


def test_fusion(spark):
    annual = spark.createDataFrame([("A", "2024-03-31", "100.5", 10.0, None), ("A", "2023-03-31", "bad", None, 2.0), ("B", "2024-03-31", "90", 5.0, 1.0)], "symbol string, period_end string, sales string, net_profit double, eps double").withColumn("period_end", F.to_date("period_end"))
    fetched = bridge.fetch([bridge.Atom("revenue", years=(2023, 2024), metric="Revenue"), bridge.Atom("net_profit", years=(2024,)), bridge.Atom("ebitda")], {"annual_results": annual})
    rows = {(r.sub_type, r.symbol, r.year): (r.value, r.unit, r.value_col, r.period) for r in fusion.metric_rows_of(fetched).collect()}
    assert rows[("revenue", "A", 2024)] == (100.5, "crore", "sales", "2024-03-31") and rows[("revenue", "A", 2023)][0] is None and rows[("net_profit", "B", 2024)][0] == 5.0 and len(rows) == 5
    chunks = spark.createDataFrame(
        [("c1", "Revenue was Rs 101 crore this year. We expect net profit of Rs 12 crore next year.", "concall", 0.9, "A", 2024, "CFO", "management"), ("c2", "Revenue was Rs 500 crore.", "concall", 0.8, "A", 2024, None, "analyst"), ("c3", "Order book of Rs 7 crore, guidance maintained.", "concall", 0.7, "A", 2024, None, None), ("r1", "Text of the report", "annual_report", 0.5, "A", 2024, None, None), ("r2", None, None, 0.6, None, None, None, None)],
        "chunk_id string, text string, doc_type string, score double, symbol string, year int, speaker string, speaker_role string",
    )
    found = fusion.fuse(fetched, chunks)
    got = {(r.sub_type, r.symbol, r.year): r.insight for r in found.insights.collect()}
    assert got[("revenue", "A", 2024)] == "CONFIRM" and got[("net_profit", "A", 2024)] == "FORWARD" and ("order_book", "A", 2024) not in got and len(found.errors) == 1
    everything = fusion.fused_rows(fusion.metric_rows_of(fetched), chunks)
    assert ("order_book", "FORWARD") in {(r.sub_type, r.insight) for r in fusion.of_type(everything.insights, "FORWARD").collect()}
    assert [r.chunk_id for r in found.concall_chunks.collect()] == ["c1", "c2", "c3"] and [r.chunk_id for r in found.annual_chunks.collect()] == ["r2", "r1"]
    shown = fusion.context(found, most=1)
    assert shown["annual_chunks"].count() == 1 and shown["metric_rows"].count() == 5 and fusion.totals(fetched, chunks) == {"rows": 5, "chunks": 5, "errors": 1}
    assert fusion.symbol_of(chunks, "Z") == "Z" and fusion.symbol_of(chunks) == "A" and fusion.symbol_of(chunks.limit(0)) is None
    nothing = fusion.fuse(bridge.fetch([bridge.Atom("ebitda")], {}), chunks)
    assert nothing.insights.count() == 0 and nothing.metric_rows.count() == 0
    assert [f.atom.sub_type for f in bridge.fetch_symbol("a", ["revenue", "nothing"], {"annual_results": annual}, (2024,))] == ["revenue"] and bridge.fetch_symbol("a", ["revenue"], {"annual_results": annual}, (2024,))[0].rows.count() == 1


def test_units_of_cross_reference(spark):
    """A margin of 0.2 as a fraction, claimed as 20 per cent, is confirmed; dollars are rupees of their year."""
    rows = spark.createDataFrame([(1, "opm", "Margin", 2024, "2024-03-31", 0.2, "opm", "fraction", None, "A"), (2, "revenue", "Revenue", 2024, "2024-03-31", 10.0, "sales", "USD mn", None, "A")], "row_id bigint, sub_type string, metric string, year int, period string, value double, value_col string, unit string, raw_row map<string,string>, symbol string")
    claims = spark.createDataFrame([(1, "opm", "Margin", 20.0, None, "%", 2024, "Margin was 20%.", False, None, 0.5, "A"), (2, "revenue", "Revenue", 7900.0, 8100.0, "lakh", 2024, "Revenue was Rs 7,900 to 8,100 lakh.", False, None, 0.5, "A")], "claim_id bigint, sub_type string, metric string, value_low double, value_high double, unit string, year int, source_text string, is_forward boolean, speaker_role string, chunk_score double, symbol string")
    units = spark.createDataFrame([("opm", "%"), ("revenue", "crore")], "sub_type string, common_unit string")
    r, c = fusion.in_common_units(rows, claims, units, spark.createDataFrame([("USD", 2024, 80.0)], "currency string, year int, inr_per_unit double"))
    assert {x.row_id: (x.value, x.unit) for x in r.collect()} == {1: (20.0, "%"), 2: (pytest.approx(80.0), "crore")}
    assert {x.row_id: x.insight for x in fusion.cross_reference(r, c).collect()} == {1: "CONFIRM", 2: "CONFIRM"} and {x.claim_id: x.value_high for x in c.collect()}[2] == pytest.approx(81.0)


def test_evaluation_run(spark, tmp_path):
    made = evaluate.GoldenSet().add("a revenue", ["x3", "x7"], symbol="A", years=[2024]).add("b risk", ["y99"], doc_type="concall", years=[2020, 2022], graded_ids={"y99": 3}).add("nothing", [])
    golden = made.build(spark)
    questions, relevant = evaluate.questions_and_relevance(golden)
    q = {r.query: (r.year, r.year_from, r.year_to) for r in questions.collect()}
    assert q == {"a revenue": (2024, None, None), "b risk": (None, 2020, 2022), "nothing": (None, None, None)} and {r.gain for r in relevant.collect()} == {1, 3}
    ranked = lambda qs: qs.where("query <> 'nothing'").select("query_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.when(F.col("query") == "a revenue", "x").otherwise("z"), i.cast("string")))).alias("at", "item_id")).selectExpr("query_id", "item_id", "double(-at) as score")
    ticks = iter(range(100))
    metrics, times = evaluate.run_eval(golden, ranked, depths=(5, 10), clock=lambda: next(ticks))
    got = {(r.k, r.hit, r.mrr, r.precision) for r in metrics.collect()}
    assert got == {(5, 1, 0.333333, 0.2), (10, 1, 0.333333, 0.2), (5, 0, 0.0, 0.0), (10, 0, 0.0, 0.0), (5, None, None, None), (10, None, None, None)}
    t = times.first()
    assert (t.queries, t.errors, t.mean_rerank_ms) == (3, 0, 0.0) and t.mean_retrieval_ms == pytest.approx(1000 / 3, rel=1e-3)
    means = {(r.metric, r.k): r.value for r in evaluate.aggregated(metrics).collect()}
    assert means[("hit", 10)] == 0.5 and means[("mrr", 10)] == 0.1667 and means[("precision", 10)] == 0.1
    broken = evaluate.run_eval(golden, lambda qs: 1 / 0, depths=(10,))
    assert broken[1].first().errors == 3 and {r.hit for r in broken[0].collect()} == {0, None}
    assert evaluate.golden_of(golden, "concall").count() == 1 and evaluate.golden_of(golden, symbol="a").count() == 1
    assert [(r.id, r.end) for r in evaluate.ends(spark.range(9), ["id"], 2).collect()] == [(0, "first"), (1, "first"), (8, "last"), (7, "last")]


def test_ledger_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS ledger_test LOCATION '" + str(tmp_path / "db") + "'")
    assert set(ledger.create_tables(spark, "ledger_test")) == set(ledger.SCHEMAS) and ledger.create_tables(spark, "ledger_test") == [] and ledger.existing(spark, "ledger_test") == sorted(ledger.SCHEMAS)
    spark.sql("DROP DATABASE ledger_test CASCADE")
    c = spark.createDataFrame([(1, "A", None, None), (1, None, None, None), (2, "A", None, None)], "id int, symbol string, name string, created_at timestamp_ntz")
    assert {tuple(r) for r in ledger.violations(c, "rag_companies").collect()} == {("symbol is null", 1), ("id is not unique", 1), ("symbol is not unique", 1)} and ledger.violations(c.where("id = 2"), "rag_companies").count() == 0
    path = str(tmp_path / "table")
    for n in (3, 5):
        ledger.swap(spark.range(n), path)
    ledger.swap(spark.read.parquet(path).where("id > 1"), path)
    assert [r.id for r in spark.read.parquet(path).orderBy("id").collect()] == [2, 3, 4]
    files = spark.createDataFrame([("application/pdf", 20_000), ("text/HTML; x", 50_000), (None, 10_240), ("application/pdf", 10_239)], "content_type string, length int")
    assert ledger.downloads(files).count() == 2 and ledger.chunks_of(spark.createDataFrame([(1, 7, 2), (2, 7, 1), (3, 8, 0)], "id int, doc_id int, chunk_index int"), 7).first().id == 2


def test_prompts():
    assert prompt.budget_for("Some-Large-model") == 80_000 and prompt.budget_for("tiny") == 24_000 and prompt.tokens_of("") == 1
    chunks = [{"text": "x" * 350, "year": 2020 + i, "doc_type": "concall" if i % 2 else "annual_report"} for i in range(10)]
    fits = lambda context, **kw: len(prompt.trimmed_to_tokens(chunks, "s" * 35, "u" * 35, context, reply=100, **kw))
    assert fits(20_000) == 10 and fits(100) == 3 and fits(320 + 160 * 4) == 4 and fits(400) == 1 and fits(320 + 160 * 9, most_chars=1900) == 3
    assert prompt.context_of([{"text": "old", "year": 2019, "doc_type": "annual_report"}, {"text": "call", "year": 2021, "doc_type": "concall"}, {"text": "new", "year": 2021, "doc_type": "annual_report"}]).index("new") < prompt.context_of([{"text": "call", "year": 2021, "doc_type": "concall"}, {"text": "new", "year": 2021, "doc_type": "annual_report"}]).index("call") + 200
    p = prompt.build("Compare revenue CAGR and risks", [], [], [])
    assert "side by side" in p.user and "1 / years" in p.user and p.mode == "minimal"


def test_ingest(spark, tmp_path, capsys):
    root, store = tmp_path / "files", str(tmp_path / "store")
    sentence = "Revenue of the company rose in the home market because of higher demand and better prices this year. "
    for folder, name, text in (("annual_report/acme", "2024_report.txt", "RISKS\n\n" + sentence * 3 + "\n\nItem | FY24\nRevenue of the whole group | 5"), ("concall/acme", "2023_call.txt", "Ravi Kumar: " + sentence * 3), ("annual_report/beta", "empty.txt", "short")):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / name).write_text(text)
    embedder = lambda c: F.array(F.length(c).cast("double"))
    first = {r.minio_key: (r.ok, r.message) for r in ingest(spark, str(root), store, embedder=embedder).collect()}
    assert first == {"annual_report/acme/2024_report.txt": (True, None), "concall/acme/2023_call.txt": (True, None), "annual_report/beta/empty.txt": (False, "no chunks")}
    docs = {r.minio_key: (r.ingested, r.symbol, r.year) for r in spark.read.parquet(f"{store}/documents").collect()}
    assert docs["concall/acme/2023_call.txt"] == (1, "ACME", 2023) and docs["annual_report/beta/empty.txt"][0] == 2
    pts = spark.read.parquet(f"{store}/points").collect()
    assert {r.chunk_type for r in pts} == {"prose", "table", "speaker_turn"} and any(r.text.startswith("[Concall: ACME FY2023]") for r in pts)
    again = ingest(spark, str(root), store, embedder=embedder)
    assert [r.minio_key for r in again.collect()] == ["annual_report/beta/empty.txt"] and ingest(spark, str(root), store, force=True, embedder=embedder).count() == 3
    assert spark.read.parquet(f"{store}/points").count() == len(pts) and ledger.run_totals(spark.read.parquet(f"{store}/log")).first().failed == 3
    assert cli.main([store, "--list", "--symbol", "acme", "--stats"], spark) == 0 and "2023_call" in capsys.readouterr().out and cli.main([str(tmp_path / "nowhere"), "--stats"], spark) == 1


def test_sources(spark, tmp_path):
    assert objects.scalar(spark.sql("select '12.5' as x")) == 12.5 and objects.scalar(spark.sql("select 'x' as x")) is None and objects.scalar(spark.range(0)) is None
    assert objects.call_blocks(b"Ravi Kumar: Hello there.\n\nNo label") == [("speaker_turn", "Ravi Kumar: Hello there."), ("prose", "No label")]
    (tmp_path / "env").write_text("# x\nspark.a=1\nspark.b='two'\n\nnot a setting\n")
    assert settings_from(str(tmp_path / "env")) == {"spark.a": "1", "spark.b": "two"}
    assert [r.k for r in spark.createDataFrame([("```json\n{\"k\": 1}\n```",), ("{\"k\": 2}",)], "t string").select(F.from_json(understand.unfenced("t"), "k int")["k"].alias("k")).collect()] == [1, 2]


def test_stored_tables(spark):
    df = stored(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.where("id = 3").first().x == 6 and stored(df.limit(0)).count() == 0 and shared_folder(spark).removeprefix("file:") in df.inputFiles()[0]
    assert cut(df).count() == 10
    rows = spark.createDataFrame([(1, "t" * 35, 0.5), (2, "t" * 70, 0.4), (3, None, 0.3)], "id int, text string, score double").withColumn("q", F.lit(1)).where("text is not null")
    assert [r.used for r in cache.within_tokens(rows, 150, "q", [F.desc("score")]).orderBy("place").collect()] == [70, 150] and cache.within_tokens(rows, 0, "q", ["id"]).count() == 2
    assert json.loads(cache.stats(spark.createDataFrame([("abc",)], "response string"), 5, 0.5).toJSON().first()) == {"entries": 1, "bytes": 3, "ttl": 5, "threshold": 0.5}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as Stub

    context = Stub(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Stub(sparkContext=context))
