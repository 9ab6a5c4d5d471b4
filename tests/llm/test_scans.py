import re

from ledgerloom.llm import scancodec as c
from ledgerloom.llm import scans

SENTENCES = [
    "The committee reviewed the company report and the board approved the payment.", "Revenue moved because of higher demand in the market, and growth was steady.", "The treasury policy was audited by the risk committee within twenty days.",
    "Long-term supply terms were renewed, although import competition hurt the region.", "Receivables improved while inventory was held for fourteen days against twelve.",
]


def counts():
    found = {}
    for s in SENTENCES:
        for w in c.TOKEN.findall(s):
            found[c.key(w)] = found.get(c.key(w), 0) + 300
        for w in re.findall("[a-z]+(?:-[a-z]+)+", s.lower()):
            found[w] = found.get(w, 0) + 300
    return found | {"9999": 500, "99,999": 500, "FY99": 300, "9.9": 300, "zorvathi": 1, "felondasov": 2}


def editor():
    n = counts()
    plain = sorted((k for k in n if "-" not in k), key=lambda k: (-n[k], k))
    known = c.Examples(plain, [k for k in reversed(plain) if k.isalpha() and len(k) > 2], [k for k in n if "-" in k])
    return c.train_editor(c.Lexicon.of(n), known, [p for s in SENTENCES * 20 for p in c.neighbours(s)])


def test_editor():
    e = editor()
    for bad, good in {"c0mmittee": "committee", "rnarket": "market", "growtli": "growth", "pol|cy": "policy", "steacly": "steady", "12,B45": "12,845", "2O24": "2024", "market": "market", "FY24": "FY24", "Zorvathi": "Zorvathi", "felondasov": "felondasov"}.items():
        assert e.word(bad) == good, bad
    assert e.joined("com", "", "mittee") and e.joined("receiv", "-", "ables") and e.joined("pay", "¬", "ment") and not e.joined("Long", "-", "term") and not e.joined("the", "", "board")
    assert e.left_open("compe", "-", "Zorvathi") and e.left_open("treas", "¬", "") and not e.left_open("Long", "-", "term") and not e.left_open("board", "", "approved")


def test_misreadings_on_no_list_are_repaired():
    """The confusions are what the editor learns from, not all it can do: any character may be replaced, deleted or inserted."""
    e = editor()
    assert not any({("k", "h"), ("ii", "n"), ("w", "v")} & {x} for x in c.CONFUSIONS)
    for bad, good in {"compaiiy": "company", "committoe": "committee", "inventkry": "inventory", "receivabls": "receivables", "treasuxry": "treasury", "twelwe": "twelve"}.items():
        assert e.word(bad) == good, bad


def test_lexicon_counts():
    n = counts()
    packed = c.Lexicon.of(n)
    assert all(packed.get(k) == v for k, v in n.items()) and list(packed.many([*n, "absent"])) == [*n.values(), 0]
    assert packed.get("") == c.Lexicon.of({}).get("a") == 0 and list(c.Lexicon.of({}).many(["a"])) == [0]


def test_lines_of_any_length():
    """Skeletons don't depend on case, numbers and likely misreadings, and no line is too long for one."""
    long = "Acme Industries Limited and all its subsidiaries " * 40
    assert c.form_of("Page 3 of 74").form == "number" and c.form_of("xiv").form == "roman" and c.form_of("ACME LIMITED").form == "caps"
    assert scans.skeleton(long + "| Annual Report 2024-25") == scans.skeleton(long.upper() + "| Annua1 Report 2023-24") != scans.skeleton(long)
    for f in (c.form_of("Acme Ltd | Annual Report 2024"), c.form_of("")):
        assert c.Form.from_text(f.text) == f


BLOCKS = "doc_id int, doc_type string, block_index int, page_num int, block_type string, section string, text string, page string"


def rows():
    out = []
    for doc in (1, 2):
        at = 0
        for page in range(5, 13):
            out.append((doc, "annual_report", at, page, "prose", "General", f"Acme Industries Ltd | Annual Report 2024-{doc}", ""))
            for k in range(4):
                at += 1
                out.append((doc, "annual_report", at, page, "prose", "General", "\n".join(SENTENCES[(k + j) % 5] for j in range(3)), ""))
            at += 1
            out.append((doc, "annual_report", at, page, "section_header", "General", str(page), ""))
            at += 1
    out += [(3, "concall", i, 1, "prose", None, s, "") for i, s in enumerate(SENTENCES * 4)]
    noisy = [
        (4, "annual_report", 0, 1, "prose", None, "The c0mmittee reviewed the company report and the board\napproved the pay-\nment.", ""), (4, "annual_report", 1, 1, "prose", None, "Long-\nterm supply terms were renewed, although import compe-", ""), (4, "annual_report", 2, 2, "prose", None, "17", ""),
        (4, "annual_report", 3, 2, "prose", None, "tition hurt the region.", ""), (4, "annual_report", 3, 2, "prose", None, "tition hurt the region.", ""), (4, "annual_report", 4, 2, "prose", None, None, ""), (4, "annual_report", 5, 2, "prose", None, "", ""), (None, "annual_report", 6, 2, "prose", None, "x", ""),
        (4, "annual_report", 7, None, "table", None, "Item | FY24\nRevenue | 5", ""),
    ]
    return out + noisy


def test_blocks(spark):
    blocks = spark.createDataFrame(rows(), BLOCKS)
    got = {tuple(r) for r in scans.noise_found(blocks).where("doc_id = 4").collect()}
    assert got == {(4, 0, "char"), (4, 0, "hyphen"), (4, 1, "hyphen"), (4, 2, "furniture")}
    heads = {r.block_index for r in scans.noise_found(blocks).where("doc_id = 1").collect()}
    assert heads == {r[2] for r in rows() if r[0] == 1 and ("Annual Report" in r[6] or r[6].isdigit())}
    text = {(r.page_num, r.paragraph): r.text for r in scans.paragraphs(blocks).where("doc_id = 4").collect()}
    assert text[(1, 0)] == "The committee reviewed the company report and the board approved the payment." and text[(1, 1)] == "Long-term supply terms were renewed, although import competition"
    assert text[(2, 3)] == "hurt the region." and (2, 2) not in text and set(text) == {(1, 0), (1, 1), (2, 3), (0, 7)} and text[(0, 7)] == "Item | FY24\nRevenue | 5"
    assert scans.noise_found(blocks.limit(0)).count() == 0


def test_no_key_is_too_rare(spark):
    filler = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))
    texts = spark.createDataFrame([("Felondasov met twice Marvenqui and marvenqui of the well-tempered.",)], "text string").unionByName(spark.range(25_000).selectExpr(f"'{filler}' as text"))
    blocks = texts.selectExpr("1 as doc_id", "'concall' as doc_type", "1 as block_index", "1 as page_num", "'' as section", "text")
    for flush in (50, 200_000):
        lexicon, _ = scans.lexicon_of(scans.key_counts(scans.facts_of(blocks, scans.Settings(flush=flush))))
        assert [lexicon.get(k) for k in ("felondasov", "marvenqui", "well-tempered", "wordak", "absent")] == [1, 2, 1, 25_000, 0]


def test_rows_that_differ_in_one_place(spark):
    extra = [(9, "annual_report", 0, 1, "prose", None, t, "") for t in ("The board approved the payment.", "Growth was steady.")]
    got = [{tuple(r) for r in scans.repaired(spark.createDataFrame(rows() + x, BLOCKS).repartition(3)).where("doc_id = 9").collect()} for x in (extra, extra[::-1])]
    assert got[0] == got[1] and len(got[0]) == 1


def test_paragraphs_run_over_stretches(spark):
    texts = ["The board reviewed the plan and", "the payment that was made to", "the committee in the market while", "growth was steady.", "Revenue moved because of", "higher demand."]
    blocks = spark.createDataFrame([(7, "annual_report", 4093 + i, 0, "prose", None, t, "") for i, t in enumerate(texts)] + [(8, "annual_report", i, 1, "prose", None, t, "") for i, t in enumerate(texts)], BLOCKS)
    for stretch in (4096, 2, 1):
        got = {(r.doc_id, r.page_num, r.paragraph): r.text for r in scans.paragraphs(blocks, scans.Settings(stretch=stretch)).collect()}
        assert got == {(doc, page, at + k): " ".join(texts[k:end]) for doc, page, at in ((7, 0, 4093), (8, 1, 0)) for k, end in ((0, 4), (4, 6))}
