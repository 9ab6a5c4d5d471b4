import re

import numpy as np

from ledgerloom.llm import truncation as t

SMALL = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_cuts(spark):
    """Fitted on half of the texts, tested on artificial cuts and intact ends of the other half."""
    docs = spark.read.parquet(SMALL).where("text is not null").select("doc_id", "text").orderBy("doc_id").toPandas()
    texts = [x for x in docs.text if len(x) > 60]
    rng, s = np.random.default_rng(3), t.Settings()
    w = t.train([t.example(x, False, rng, s) for x in texts[::2]], s)
    intact = [x for x in texts[1::2] if x.rstrip().endswith((".", "।"))]
    cut = [c for x in texts[1::2] for _ in range(3) if (c := t.artificial_cut(x, rng))]
    flagged = lambda x, at: w[t.hashed(t.features(x, at), s.buckets)].sum() > 0
    assert np.mean([flagged(*c) for c in cut]) > 0.93 and np.mean([flagged(x, False) for x in intact if not x.rstrip().endswith("...")]) < 0.03


def test_limits_scores_and_rates(spark):
    rng = np.random.default_rng(1)
    words = "revenue grew because of better demand in the home market and margins were steady".split()
    text = lambda n: " ".join(" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(n))
    rows = [(i, text(int(rng.integers(2, 40))), "free") for i in range(150)] + [(1000 + i, (text(12))[:300], "short") for i in range(12)] + [(2000 + i, text(2)[:200], "short") for i in range(20)]
    rows += [(5000, None, "free"), (5001, "", "free"), (5002, " \n", "free"), (5003, text(3), None), (0, rows[0][1], "free"), (5004, text(900), "free")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as p", "2 as chars")
    assert {(r.source, r.unit, r.limit) for r in t.field_limits(docs).collect()} == {("short", "chars", 300), ("short", "bytes", 300)}
    scores = t.truncation_scores(docs)
    found = {r.doc_id for r in t.truncated(scores).collect()}
    cut = {r[0] for r in rows if r[2] == "short" and not r[1].rstrip().endswith(".")}
    assert len(found & cut) >= 0.9 * len(cut) and len(found - cut) <= 3
    rates = {r.source: r for r in t.truncation_rates(scores).collect()}
    assert rates["free"].documents == 151 and rates["short"].rate > 0.3 and 5000 not in {r.doc_id for r in scores.collect()}
    assert t.truncation_scores(docs.limit(0)).count() == 0


def test_no_text_is_shuffled_or_collected(spark, capsys):
    """Neither plan has a text below an exchange, and what the fit collects doesn't grow with the texts."""
    docs = spark.range(60).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat(concat('Revenue grew in market ', id, '. '), 5) as text")
    t.truncation_scores(docs).explain("formatted")
    exchanged = re.findall(r"\) Exchange\n(?:Input|Output)[^\n]*", capsys.readouterr().out)
    assert exchanged and not any("text#" in x for x in exchanged)
    sizes = []
    for times in (1, 10):
        longer = docs.selectExpr("doc_id", "source", f"repeat(text, {times}) as text")
        text = longer.first().text
        e = t.example(text, False, np.random.default_rng(1), t.Settings())
        sizes.append(len(e.intact) + sum(map(len, e.cuts)))
    assert sizes[1] < 1.5 * sizes[0]
