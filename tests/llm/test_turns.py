from ledgerloom.llm import turns as t

PEOPLE = ((1, "Anita Rao Mehta".replace("Rao ", ""), "management", "Chief Executive Officer", "Acme Limited"), (2, "Vikram Shah", "management", "Chief Financial Officer", "Acme Limited"), (3, "Ravi Kumar", "analyst", "Analyst", "Blue Securities"), (4, "Desk Person", "moderator", "Conference Moderator", "Conference desk"))


def test_labels():
    call = t.Call(PEOPLE)
    cases = {
        "Anita Mehta": 1, "MEHTA, ANITA": 1, "Ms. Mehta": 1, "A. Mehta": 1, "Anita  Mehtta": 1, "Anita Mehta (Chief Executive Officer)": 1, "CEO": 1, "Chief Executive": 1, "CFO": 2, "Analyst - Kumar": 3, "Ravi Kumar - Blue Securities (continued)": 3,
        "Operator": 4, "[00:12:30] moderator": 4, "Unknown": None, "": None, "Chief": None,
    }
    for label, want in cases.items():
        assert call.resolve(label, False) == want, label
    assert call.listed("Anita Mehta, Vikram Shah; Operator / Mr. Kumar") == [1, 2, 4, 3]
    assert call.listed("Mehta, Anita") == [1] and call.listed("Unknown") == [] and call.resolve("As they said", True) is None


def test_ties_name_nobody():
    call = t.Call(((1, "Anita Mehta", "management", "Head", "A"), (2, "Vikram Mehta", "management", "Head", "A")))
    assert call.resolve("Ms. Mehta", False) is None and call.resolve("V. Mehta", False) == 2 and call.resolve("Head", False) is None


def test_clean():
    assert t.clean("[00:06:38] Um, we we grew (06:38) by 5% er... [crosstalk] *coughs* this 9m33s year.") == "we grew by 5% this year."
    assert t.clean("Uh, um.") == t.clean("(phone rings)") == t.clean("") == ""
    assert t.clean("What sort of demand do you know that (unaudited)") == "What sort of demand do you know that (unaudited)"


BLOCKS = "doc_id int, doc_type string, block_index int, page_num int, block_type string, text string, speaker string, speaker_role string, pid string"


def blocks(spark):
    rows = [
        (1, "concall", 0, 1, "section_header", "CALL", None, None, ""), (1, "concall", 1, 1, "prose", "Unlabelled before anyone.", None, None, ""), (1, "concall", 2, 1, "speaker_turn", "Welcome all.", "Operator", "moderator", ""),
        (1, "concall", 3, 1, "speaker_turn", "Er...", "Vikram Shah", None, ""), (1, "concall", 4, 1, "prose", "More from the operator.\nAnita Mehta:\nThank you.", None, None, ""), (1, "concall", 5, 2, "section_header", "Q&A", None, None, ""),
        (1, "concall", 6, 2, "speaker_turn", "Still me.", "MEHTA, ANITA", None, ""), (1, "concall", 6, 2, "speaker_turn", "Still me.", "MEHTA, ANITA", None, ""), (1, "concall", 7, 2, "speaker_turn", "Who am I?", "Stranger Danger", None, ""),
        (1, "concall", 9000, 2, "prose", "[music]", None, None, ""), (1, "concall", 9001, 2, "speaker_turn", "Back again.", "Anita Mehta", None, ""), (1, "concall", None, 2, "prose", "x", None, None, ""), (None, "concall", 1, 1, "prose", "x", None, None, ""),
        (1, "concall", 9002, 2, "prose", None, "Anita Mehta", None, ""), (2, "concall", 1, 1, "prose", "Anita Mehta: no participants", None, None, ""), (1, "annual_report", 9003, 2, "prose", "CFO: none", None, None, ""),
    ]
    return spark.createDataFrame(rows, BLOCKS)


def people(spark):
    rows = [(p[0], 1, *p[1:]) for p in PEOPLE] + [(9, None, "No Doc", "analyst", None, None), (3, 1, "Ravi Kumar", "analyst", "Analyst", "Blue Securities")]
    return spark.createDataFrame(rows, "participant_id bigint, doc_id int, full_name string, role string, designation string, firm string")


def test_turns_and_lists(spark):
    chunks = spark.createDataFrame([(1, 0, "CEO; Ravi Kumar"), (1, 0, "CEO; Ravi Kumar"), (1, 1, None), (1, 2, "  "), (None, 3, "CEO"), (5, 1, "CEO")], "doc_id int, chunk_index int, speaker string")
    got = {tuple(r) for r in t.named_people(blocks(spark), chunks, people(spark)).collect()}
    assert got == {("page_blocks", 1, 2, 4), ("page_blocks", 1, 4, 1), ("page_blocks", 1, 9001, 1), ("chunks", 1, 0, 1), ("chunks", 1, 0, 3)}
    text = {(r.turn_start, r.participant_id): (r.text, r.blocks) for r in t.clean_turns(blocks(spark), people(spark)).where("doc_id = 1").collect()}
    assert text == {(1, None): ("Unlabelled before anyone.", 1), (2, 4): ("Welcome all. More from the operator.", 2), (4, 1): ("Thank you. Still me.", 2), (7, None): ("Who am I?", 1), (9001, 1): ("Back again.", 1)}
    assert t.named_people(blocks(spark).limit(0), chunks.limit(0), people(spark).limit(0)).count() == 0


def test_no_speech_is_lost(spark):
    """Every part that is said is in exactly one turn, whoever says it; documents without participants too."""
    said = sum(len(r.text.split()) for r in t.spoken(blocks(spark), people(spark)).collect())
    turns = t.clean_turns(blocks(spark), people(spark)).collect()
    assert sum(len(r.text.split()) for r in turns) == said and {r.participant_id for r in turns if r.doc_id == 2} == {None}


def test_labels_of_any_length():
    call = t.Call(PEOPLE)
    label = "Anita Mehta, " + "Chief Executive Officer, Acme Limited, " * 8
    assert len(label) > 200 and [who for who, _ in call.segments(None, f"Before.\n{label}: Thank you.\nVikram Shah: Yes.")] == [None, 1, 2]
    assert [who for who, _ in call.segments(None, "As all of us said " * 30 + ": nobody is named.")] == [None]


def test_rows_that_differ_in_one_place(spark):
    rows = [(1, "concall", 1, 1, "speaker_turn", text, who, None, "") for text, who in (("B said.\nAnita Mehta: C said.", "Operator"), ("A said.", "Vikram Shah"))]
    for given in (rows, rows[::-1]):
        got = t.clean_turns(spark.createDataFrame(given, BLOCKS).repartition(2), people(spark)).collect()
        assert [(r.participant_id, r.text) for r in got] == [(2, "A said.")]
