import os

import pytest

from textquarry.llm import tokenize

CASES = [None, "", " ", "  two  blanks\n\n", "hello world", "don't we'll I'D", "<|endoftext|> is plain", "naïve ß é 🙂🏳️‍🌈", "ha" * 5000, "白い橋。ราคา 12.5", "\x00\x01\t\r\n", "é​"]


@pytest.fixture(scope="module")
def enc():
    return tokenize.encoder(tokenize.model_bytes())


def test_ids_equal_the_public_tokenizer(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(tokenize.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text, ids in zip(CASES, enc.encode_batch(CASES), strict=True):
        assert ids == t.encode(text or "", add_special_tokens=False).ids, text


def test_round_trip(enc):
    for text in CASES:
        assert enc.decode(enc.encode(text)) == (text or "")


def test_documents_with_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate([*CASES, "hello world"])], "doc_id long, text string, batch string, ids array<int>")
    out = {r.doc_id: r.ids for r in tokenize.encode_documents(df).collect()}
    assert out[0] == [] and out[1] == [] and len(out) == len(CASES) + 1
    assert out[4] == out[len(CASES)] == tokenize.encoder(tokenize.model_bytes()).encode("hello world")
    back = {r.doc_id: r.text for r in tokenize.decode_documents(tokenize.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate([*CASES, "hello world"])}
    counts = {r.doc_id: r.n_tokens for r in tokenize.token_counts(df, keep=("doc_id",)).collect()}
    assert counts == {k: len(v) for k, v in out.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenize.encode_documents(df).collect() == []


def test_other_vocabulary_round_trip():
    other = tokenize.encoder(tokenize.model_bytes(vocabulary="byte_bpe_multi_50k.tiktoken"))
    assert all(other.decode(other.encode(t)) == (t or "") for t in CASES)


def test_gaps_in_a_vocabulary_are_refused():
    with pytest.raises(ValueError):
        tokenize.serialise_model({b"a": 0, b"b": 2})
