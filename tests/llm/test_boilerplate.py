from ledgerloom.llm import boilerplate as b


def test_repeated_lines(spark):
    line = "Share  this | page"
    rows = [(f"c{i}", " Acme " if i % 2 else "ACME", f"[Section: x]\nOwn text {i}.\n {line.upper() if i % 3 else line}\n\n{line}") for i in range(6)]
    rows += [("c0", "ACME", rows[0][2]), ("d", "other", line), ("e", None, line), ("f", "acme", None), ("g", "acme", ""), (None, "acme", line)]
    chunks = spark.createDataFrame(rows, "chunk_id string, symbol string, text string").selectExpr("*", "1 as line_no", "text as source")
    got = {tuple(r) for r in b.repeated_lines(chunks).collect()}
    assert got == {(f"c{i}", n) for i in range(6) for n in (3, 5)}
    assert b.repeated_lines(chunks, min_chunks=7).count() == 0 and b.repeated_lines(chunks, min_share=0.9).count() == 12 and b.repeated_lines(chunks.limit(0)).count() == 0
    clean = {(r.chunk_id, r.text, r.removed) for r in b.without_lines(chunks, b.repeated_lines(chunks)).collect()}
    assert ("c1", "[Section: x]\nOwn text 1.\n", 2) in clean and ("d", line, 0) in clean and ("f", None, 0) in clean


def test_hashes_are_independent(spark):
    """A salt after the text would only map the first hash to the second; h2 is none of such maps."""
    chunks = spark.createDataFrame([("c", "a", f"line {i}") for i in range(50)], "chunk_id string, symbol string, text string")
    chained = {r.h: r.c for r in spark.range(50).selectExpr("xxhash64(concat('line ', id)) as h", "xxhash64(concat('line ', id), 7) as c").collect()}
    hashes = {r.h1: r.h2 for r in b._lines(chunks).collect()}
    assert set(hashes) == set(chained) and not any(hashes[h] == chained[h] for h in hashes) and len(set(hashes.values())) == 50
