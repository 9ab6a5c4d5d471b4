import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import tokens as t

PATH = f"{t.TOKENIZERS}/byte_bpe_50k.tiktoken"
ENCODER = t.Encoder(t.serialise(t.read_ranks(PATH)))
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
OTHER = tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_agree_and_come_back(text):
    ids = ENCODER.ids(text)
    assert ids == OTHER.encode_ordinary(text) and ENCODER.text(ids) == text


@pytest.mark.parametrize("text", ["<|endoftext|> is text", "  \n\n x ", "aaaa" * 5000, "कंपनी ने ₹9 करोड़", "\x00‍", "it's we'll"])
def test_hard_texts(text):
    assert ENCODER.ids(text) == OTHER.encode_ordinary(text)


def test_column(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "Hello world")], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: list(r.ids) for r in t.encode_documents(docs).collect()}
    assert got == {1: OTHER.encode_ordinary("Hello world"), 2: [], 3: [], 4: OTHER.encode_ordinary("Hello world")}
    assert t.encode_documents(docs).schema["ids"].dataType.simpleString() == "array<int>" and t.encode_documents(docs.limit(0)).count() == 0
