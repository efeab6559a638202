import random

import pytest

from readloom.llm import encode

SCHEMA = "doc_id long, text string, ids string"
TEXTS = [None, "", " ", "\n\n  \n", "Hello  world's <|endoftext|> 123", "ſ ﬁ é é 🙂🙂", "a" * 3000, " " * 2500, "x\t\r\n y" * 400, "12345" * 500, "don't " * 700, "!" * 1500 + " a" * 900, "ab cd " * 300]


def expected(text):
    return encode.encoding(encode.vocabulary()).encode_ordinary(text) if text else []


@pytest.mark.parametrize("spread", [encode.SPREAD, 100])
@pytest.mark.parametrize("chunk,overlap", [(encode.CHUNK, encode.OVERLAP), (200, 40), (64, 16), (37, 9)])
def test_chunks_equal_whole_texts(spark, chunk, overlap, spread):
    rng = random.Random(chunk)
    texts = TEXTS + ["".join(rng.choice(["word", " ", "  ", "\n", "7", "é", "'s", "-", "🙂", "ﬁn "]) for _ in range(rng.randrange(900))) for _ in range(25)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df, chunk=chunk, overlap=overlap, spread=spread).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    n = {r["doc_id"]: r["n_tokens"] for r in encode.count_tokens(df, "doc_id", chunk=chunk, overlap=overlap, spread=spread).collect()}
    assert n == {i: len(x) for i, x in got.items()}


def test_pieces_of_mixed_text():
    rng = random.Random(3)
    enc = encode.encoding(encode.vocabulary())
    for _ in range(300):
        text = "".join(rng.choice(["ab", "'s", "'", "''", "l", " ", "  ", "\n", "7", "44", "é", "-", "…", "🙂", "字", "'re", "d"]) for _ in range(rng.randrange(120)))
        got = encode.pieces(text, 11, 7)
        assert "".join(got) == text and [i for x in got for i in enc.encode_ordinary(x)] == enc.encode_ordinary(text)


def test_a_million_characters_without_white_space(spark):
    """Such a text has stitches where kinds of characters meet, and its pieces are encoded in several tasks."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/字") for _ in range(1_100_000))
    assert len(encode.pieces(text, encode.CHUNK, encode.OVERLAP)) > 200
    got = encode.encode(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"))
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {1: expected(text), 2: expected("short")}


def test_agrees_with_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in TEXTS[1:]:
        assert t.encode(text, add_special_tokens=False).ids == expected(text)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in encode.decode(encode.encode(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty(spark):
    assert encode.encode(spark.createDataFrame([], SCHEMA)).collect() == []
