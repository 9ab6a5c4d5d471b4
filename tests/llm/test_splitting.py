from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import splitting as s


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "clause,", "\n", "\n\n", "- item", "HEADING LINE\n", "a | b\n", "Name: said"]), max_size=160), st.integers(2, 30), st.integers(0, 40))
def test_pieces_hold_limit_overlap_and_text(parts, limit, overlap):
    text = " ".join(parts)
    words = text.split()
    out = s.pieces(text, limit, overlap)
    if len(words) <= limit:
        assert out == [(0, len(words), 0, len(text))]
        return
    keep = min(overlap, limit - 1)
    rebuilt, before = [], None
    for first, end, a, b in out:
        own = text[a:b].split()
        assert len(own) == end - first <= limit
        if before is None:
            assert first == 0
            rebuilt += own
        else:
            again = before[1] - first
            assert again == min(keep, before[1] - before[0])
            rebuilt += own[again:]
        before = (first, end)
    assert rebuilt == words


def test_cuts_at_the_highest_boundary():
    text = "\n\n".join(f"Sentence one of part {i}. Sentence two of part {i}." for i in range(6))
    ends = [text[a:b] for *_, a, b in s.pieces(text, 22, 2)]
    assert all(e.endswith(".") and e.split()[-2] == "part" for e in ends)
    assert s._pages(0, 10, 100, 3, 4) == (3, 3) and s._pages(90, 100, 100, 3, 4) == (4, 4) and s._pages(0, 1, 1, None, float("nan")) == (None, None)


def test_rows(spark):
    long = "word " * 25
    rows = [("a", "Annual_Report ", "prose", long, 1, 2, 5), ("a", "Annual_Report ", "prose", long, 1, 2, 5), ("b", "annual_report", "prose", "short", 1, 1, 999), ("c", "annual_report", "prose", None, 1, 1, 1), ("d", "annual_report", "prose", "", 1, 1, 1), ("e", "annual_report", "other", long, None, None, 1), ("f", "annual_report", "prose", "x" * 300_000, None, None, 1), ("g", "annual_report", "prose", "w " * 50_000, None, None, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_type string, chunk_type string, text string, page_start int, page_end int, max_words int")
    limits = spark.createDataFrame([("annual_report", "prose", 10, 3), ("annual_report", "table", None, 3)], "doc_type string, chunk_type string, max_words int, overlap_words int")
    assert {r.chunk_id for r in s.oversized(chunks, limits).collect()} == {"a", "g"}
    got = s.split_oversized(chunks, limits).where("chunk_id = 'a'").orderBy("piece_no").collect()
    assert [r.word_count for r in got] == [6, 9, 10, 9][: len(got)] or sum(r.word_count for r in got) == 25 + 3 * (len(got) - 1)
    assert got[0].page_start == 1 and got[-1].page_end == 2 and max(r.word_count for r in got) <= 10
    assert s.split_oversized(chunks.limit(0), limits).count() == 0 == s.split_oversized(chunks, limits.limit(0)).count()


def test_depth_of_headings_and_items():
    depth = s.heading_depth
    assert [depth(x) for x in ("# One", "### Three", "[Section: x]", "RISK FACTORS", "2.1 Credit risk", "2.1.3 Credit risk of groups", "1. first item", "Plain text", "2.1 This is a sentence that ends here.", "A | B")] == [1, 3, 1, 1, 2, 3, None, None, None, None]
    part = lambda n: " ".join(["word"] * n) + ".\n"
    text = "# A\n" + part(5) + "## A1\n" + part(8) + "## A2\n" + part(8) + "# B\n" + part(12)
    starts = [text[a:b].split("\n")[0] for *_, a, b in s.pieces(text, 20, 0)]
    assert starts == ["# A", "## A2", "# B"]  # the oversized section is cut at its subsections, the other stays whole
    items = "\n".join(["- one two three four", "  - five six seven", "  - eight nine ten", "- eleven twelve thirteen", "  - fourteen fifteen sixteen"])
    assert [items[a:b].split()[1] for *_, a, b in s.pieces(items, 14, 0)] == ["one", "eleven"]
    deep = [r for _, r in zip(*s.boundaries(items)) if r >= s.LINE]
    assert deep == [s.ITEM - 1, s.ITEM - 1, s.ITEM, s.ITEM - 1]


def test_first_piece_may_be_full():
    text = " ".join(f"w{i}." for i in range(25))
    sizes = [end - first for first, end, *_ in s.pieces(text, 10, 3)]
    assert sizes[0] == 10 and max(sizes) <= 10 and sum(sizes) == 25 + 3 * (len(sizes) - 1)


def test_pages_are_looked_up(spark):
    """Page 2 is nearly empty: an even spread would put the middle of the text there."""
    blocks = spark.createDataFrame([(1, 0, 1, "w " * 10), (1, 0, 1, "w " * 10), (1, 1, 2, "w"), (1, 2, 3, "w " * 9), (1, 3, 0, "x"), (None, 4, 1, "x"), (1, 5, 1, None)], "doc_id int, block_index int, page_num int, text string")
    assert {tuple(r) for r in s.page_words(blocks).collect()} == {(1, 1, 10), (1, 2, 1), (1, 3, 9)}
    chunks = spark.createDataFrame([("a", 1, "annual_report", "prose", "w. " * 20, 1, 3), ("b", 9, "annual_report", "prose", "w. " * 20, 1, 3), ("c", None, "annual_report", "prose", "w. " * 20, None, 3)], "chunk_id string, doc_id int, doc_type string, chunk_type string, text string, page_start int, page_end int")
    limits = spark.createDataFrame([("annual_report", "prose", 10, 0)], "doc_type string, chunk_type string, max_words int, overlap_words int")
    got = {(r.chunk_id, r.piece_no): (r.page_start, r.page_end) for r in s.split_oversized(chunks, limits, s.page_words(blocks)).collect()}
    assert got == {("a", 0): (1, 1), ("a", 1): (2, 3), ("b", 0): (1, 2), ("b", 1): (2, 3), ("c", 0): (3, 3), ("c", 1): (3, 3)}
