import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import chunking as c
from ledgerloom.operators import packing

BLOCKS = "doc_id int, doc_type string, block_index int, page_num int, block_type string, text string, section string, speaker string, speaker_role string, table_data array<array<string>>, size string, pack string"


def folded(blocks, rule):
    """The packs of one document by a plain fold: lists of block indexes."""
    out, held = [], 0
    for index, size, boundary, flush in blocks:
        if boundary:
            held = 0
        elif size:
            if isinstance(rule, packing.Late):
                if not held:
                    out.append([])
                held += size
                if int(held * 1.3) > rule.limit:
                    held = 0
            else:
                if not held or held + size > rule.limit or flush:
                    out.append([])
                    held = 0
                held += size
            out[-1].append(index)
    return out


@pytest.mark.parametrize("rule", [packing.Late(60), packing.Early(40)])
def test_packs_are_the_fold_for_any_stretch(spark, rule):
    rng = random.Random(7)
    docs = {d: [(3 * i, rng.choice([0, 1, 4, 9, 25, 70]), rng.random() < (0.1 if d % 2 else 0.0), rng.random() < 0.1) for i in range(rng.randint(1, 160))] for d in range(8)}
    frame = spark.createDataFrame([(d, *b) for d, blocks in docs.items() for b in blocks], "doc_id int, block_index int, size int, boundary boolean, flush boolean")
    want = {(d, i): p[0] for d, blocks in docs.items() for p in folded(blocks, rule) for i in p}
    for stretch in (4096, 30, 3):
        got = {(r.doc_id, r.block_index): r.pack for r in packing.packs(frame.repartition(5), rule, stretch).collect()}
        assert got == want
    assert packing.packs(frame.limit(0), rule).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=30), st.integers(0, 46))
def test_what_was_held_before_only_matters_until_all_agree(sizes, held):
    """Folding for all that may be held before agrees with folding for the one that is."""
    import numpy as np

    rule = packing.Late(60)
    every, one = np.arange(rule.states), np.array([min(held, rule.states - 1)])
    for size in sizes:
        every, one = rule.step(every, size, False)[0], rule.step(one, size, False)[0]
    assert every[min(held, rule.states - 1)] == one[0]


def report(doc=1):
    prose = lambda n, i: f"Revenue of unit {i} " + "rose in the home market " * n
    rows, at = [], 0
    for i, (kind, text) in enumerate([("prose", prose(6, 0)), ("prose", prose(6, 1)), ("section_header", "Risks"), ("prose", prose(90, 2)), ("prose", prose(90, 3)), ("prose", prose(9, 4)), ("table", "t"), ("prose", prose(7, 5)), ("section_header", "Risks"), ("prose", prose(7, 6)), ("prose", "too short"), ("prose", None), ("prose", "")]):
        table = [["Item", " FY24 "], ["Revenue of the whole group", "5"], ["Cost", None]] if kind == "table" else None
        rows.append((doc, "annual_report", at, 10 + i, kind, text, None, None, None, table, "", ""))
        at += 1
    return rows


def call(doc=2):
    words = "we saw good growth in the home market and margins were steady "
    turns = [("Operator", "moderator", words * 2), ("Ravi Kumar", "analyst", "Thank you. " + words * 2), ("Ravi Kumar", "analyst", "Could you explain margins? " + words * 2), ("Anita Mehta", "management", words * 60), (None, None, words * 20), ("Anita Mehta", "", words)]
    return [(doc, "concall", i, i, "speaker_turn", text, None, who, role, None, "", "") for i, (who, role, text) in enumerate(turns)] + [(doc, "concall", 99, 9, "section_header", "Q&A SESSION", None, None, None, None, "", "")]


def test_reports(spark):
    rows = report()
    blocks = spark.createDataFrame(rows + rows[:3], BLOCKS)
    got = c.annual_chunks(blocks).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and len({r.chunk_id for r in got}) == len(got)
    first = got[0]
    assert first.section == "General" and first.text.startswith("[Section: General]\nRevenue of unit 0") and "unit 1" in first.text and (first.page_start, first.page_end) == (10, 11) and first.word_count == len(first.text.split())
    # No chunk spans a header or a table, and two sections of one name stay apart.
    spans = [r for r in got if r.chunk_type == "prose"]
    for r in spans:
        units = {int(x) for x in __import__("re").findall(r"unit (\d)", r.text)}
        assert units <= {0, 1} or units <= {2, 3, 4} or units == {5} or units == {6}
    assert {u for r in spans for u in __import__("re").findall(r"unit (\d)", r.text)} == set("0123456")
    table = next(r for r in got if r.chunk_type == "table")
    assert table.text == "[Section: Risks] [Table]\nItem | FY24\nRevenue of the whole group | 5\nCost |" and table.word_count == 12 and (table.page_start, table.page_end) == (16, 16)
    assert all(r.chunk_index < table.chunk_index for r in spans if "unit 2" in r.text) and max(len(r.text.split()) for r in got) <= c.WINDOW
    small = sorted(tuple(r) for r in c.annual_chunks(blocks, stretch=2).collect())
    assert small == sorted(tuple(r) for r in got)


def test_calls(spark):
    about = spark.createDataFrame([(2, " acme ", 2024)], "doc_id int, symbol string, year int")
    got = c.call_chunks(spark.createDataFrame(call(), BLOCKS), about).orderBy("chunk_index").collect()
    assert got[0].text.startswith("[Concall: ACME FY2024] [Speakers: Operator, Ravi Kumar]\nOperator [moderator]:\nwe saw good") and "\n\nRavi Kumar [analyst]:\nThank you." in got[0].text and "Could you" not in got[0].text
    assert "Could you explain" in got[1].text and got[1].speaker_role == "analyst" and (got[1].page_start, got[1].page_end) == (2, 3) and "Q&A" not in "".join(r.text for r in got)
    assert got[-1].text.split("]\n", 1)[1].startswith("we saw") and "Anita Mehta:\nwe saw" in got[-1].text and [r.chunk_index for r in got] == [0, 1, 2]
    assert c.call_chunks(spark.createDataFrame(call(), BLOCKS)).first().text.startswith("[Concall: ? FY?]")


def test_dispatch(spark):
    blocks = spark.createDataFrame(report() + call() + [(3, "notice", 0, 1, "prose", "x", None, None, None, None, "", "")], BLOCKS)
    assert {r.doc_id for r in c.chunk_documents(blocks, unknown="skip").collect()} == {1, 2}
    with pytest.raises(Exception, match="unknown doc_type: notice"):
        c.chunk_documents(blocks).collect()
    assert c.chunk_documents(blocks.limit(0)).count() == 0
