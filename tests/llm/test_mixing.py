import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import mixing as m


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 1000).map(lambda x: x / 1000), st.integers(0, 10_000), st.integers(0, 5)), min_size=1), st.integers(0, 40_000))
def test_weights_keep_limits(sources, budget):
    t, n, r = ({k: v[i] for k, v in sources.items()} for i in range(3))
    w = m.weights(t, n, r, budget)
    assert all(w[k] >= 0 and budget * w[k] <= n[k] * r[k] * (1 + 1e-6) + 1e-6 for k in t) and sum(w.values()) <= 1 + 1e-6


def test_weights_keep_proportions_of_those_with_enough():
    w = m.weights({"a": 0.5, "b": 0.3, "c": 0.2, "gone": 0.1}, {"a": 10_000, "b": 10_000, "c": 50}, {"a": 1, "b": 1, "c": 2, "gone": 3}, 1000)
    assert w["a"] / w["b"] == pytest.approx(5 / 3) and w["c"] == pytest.approx(0.1, rel=1e-3) and w["gone"] == 0 and sum(w.values()) == pytest.approx(1)


def test_temperature():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    e = m.exponent_for_entropy(shares, 0.95 * math.log(3))
    assert m.entropy(m.temper(shares, e)) == pytest.approx(0.95 * math.log(3), abs=1e-6) and m.temper(shares, 1.0)["a"] == pytest.approx(0.7) and m.temper(shares, 0.0)["b"] == pytest.approx(1 / 3)


def test_mix(spark):
    rows = [(i, f"text number {i} of the big source", "big") for i in range(200)] + [(1000 + i, f"small source text {i}", "small") for i in range(5)]
    rows += [(2000, "small source text 0", "small"), (2001, None, "big"), (2002, "", "big"), (2003, "no source", None), (2004, "not named", "other"), (0, rows[0][1], "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as tokens", "2 as block")
    goals = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn, report = m.mix(docs, goals)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small", "absent"} and got["absent"].actual_share == 0 and got["big"].actual_share == pytest.approx(0.8, abs=0.05) and got["small"].max_times <= 3 and got["small"].texts == 5
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.times <= 3 for r in rows) and 2000 not in {r.doc_id for r in rows}
    assert sum(r.tokens * r.times for r in rows) == sum(r.tokens_drawn for r in got.values())
    assert {r.source: r.max_times for r in m.mix(docs, goals, total_tokens=10**9)[1].collect()} == {"big": 1, "small": 3, "absent": 0}
    empty = m.mix(docs.limit(0), goals)
    assert empty[0].count() == 0 and {r.actual_share for r in empty[1].collect()} == {None} and m.mix(docs, goals.limit(0))[1].count() == 0


def test_unnamed_source_takes_no_text(spark):
    rows = [(i, f"shared text number {i}", "Unnamed") for i in range(10)] + [(100 + i, f"shared text number {i}", " wire ") for i in range(10)] + [(200 + i, f"own text number {i}", "big") for i in range(40)]
    rows += [(300, "shared text number 0", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for idle in ([], [("Unnamed", 0.0, 1)], [("Unnamed", 0.5, 0)]):
        goals = spark.createDataFrame([("wire", 0.2, 1), ("big", 0.8, 1), *idle], "source string, target_share double, max_repeats int")
        drawn, report = m.mix(docs, goals, total_tokens=10**9)
        assert {r.source: r.texts for r in report.collect() if r.source != "Unnamed"} == {"wire": 10, "big": 40} and {r.doc_id for r in drawn.collect()} == set(range(100, 110)) | set(range(200, 240))


def test_tempered_shares(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}" for _ in range(n)), f"s{n}") for i, n in enumerate((400, 90, 30, 7, 2))] + [(9, None, "none")], "doc_id bigint, text string, source string")
    got = m.tempered_shares(docs, keep_entropy=0.9).collect()
    natural, hot = ({r.source: r[c] for r in got} for c in ("natural_share", "tempered_share"))
    assert len(got) == 5 and sum(hot.values()) == pytest.approx(1) and m.entropy(hot) == pytest.approx(0.9 * math.log(5), abs=1e-6)
    want = m.temper(natural, m.exponent_for_entropy(natural, 0.9 * math.log(5)))
    assert all(hot[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert m.tempered_shares(docs.limit(0)).count() == 0 and [r.tempered_share for r in m.tempered_shares(docs.limit(1)).collect()] == [1.0]


def test_tempered_shares_keep_repetition_limits(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}" for _ in range(n)), f"s{n}") for i, n in enumerate((400, 90, 30, 7, 2))], "doc_id bigint, text string, source string")
    tokens = {r.source: r.tokens for r in m.tempered_shares(docs).collect()}
    budget = 2 * sum(tokens.values())
    for limit in (3.0, 10.0):
        got = m.tempered_shares(docs, keep_entropy=0.99, total_tokens=budget, max_repeats=limit).collect()
        uses = {r.source: budget * r.tempered_share / r.tokens for r in got}
        assert max(uses.values()) <= limit * 1.0001 and max(uses.values()) > 0.98 * limit and sum(r.tempered_share for r in got) == pytest.approx(1)
    loose = m.tempered_shares(docs, keep_entropy=0.9, total_tokens=budget, max_repeats=1e9).collect()
    assert {r.source: r.tempered_share for r in loose} == pytest.approx({r.source: r.tempered_share for r in m.tempered_shares(docs, keep_entropy=0.9).collect()})
    natural = m.tempered_shares(docs, keep_entropy=0.99, total_tokens=budget, max_repeats=0.1).collect()
    assert all(r.tempered_share == pytest.approx(r.natural_share, rel=1e-6) for r in natural)
