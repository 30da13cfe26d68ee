import random

import pytest

from tidemark.llm import tokenizer as tk

PATH = f"{tk.TOKENIZERS}/{tk.BYTE_BPE_50K}"
ODD = ["", " ", "a" * 5000, "<|endoftext|>x", "don't we'll'S 'ſ \x1c\x1d x\x85y\u3000z  \n\n  t", "१२३ Ⅷ ½ 㐀一 é \U0001f600\U00020000", " " * 50 + "x", "\r\n\t \r", "naïve Ünïcode—dash…", "x" * 70 + " " + "9" * 80]


@pytest.fixture(scope="module")
def encoder():
    return tk.PrefixEncoder(tk.read_ranks(open(PATH, "rb").read()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(f"{tk.TOKENIZERS}/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


def test_odd_texts(encoder, library):
    for text in ODD:
        assert tk.EncodedText(encoder, text).ids() == library(text), text[:20]


def test_edits_and_appends(encoder, library):
    rng, text = random.Random(2), tk.EncodedText(encoder, "The quick brown fox's 12 jumps\n\nover. " * 20)
    before = text.encoded
    for _ in range(150):
        i = rng.randrange(len(text.text))
        text.edit(i, min(len(text.text), i + rng.randrange(5)), rng.choice(["a", " ", "\n  ", "'s", "", "12", " the end ", "é"]))
        assert text.ids() == library(text.text)
    assert text.encoded - before < 150 * 8
    text.append(" and more")
    assert text.ids() == library(text.text)


def test_long_pieces_are_linear(encoder):
    tokens = {i: t for t, i in encoder.ranks.items()}
    text = ("ab" * 60_000 + "x" * 60_000).encode()
    assert b"".join(tokens[i] for i in encoder.encode(text)) == text


def test_corpus(spark, library, rows):
    texts = [*ODD, None, *(f"doc {i} \\alpha_{i}" for i in range(50))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, "twice", "x")], "doc_id bigint, text string, ids string")
    got = rows(tk.encode_corpus(docs))
    assert got == sorted([(i, library(t) if t else []) for i, t in enumerate(texts)] + [(0, library("twice"))], key=repr)
    assert tk.encode_corpus(docs.limit(0)).count() == 0


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in tk.encode_corpus(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert list(r.ids) == (library(r.text) if r.text else [])
