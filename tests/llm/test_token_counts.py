"""Counts equal the tokenizer library's on texts and on small random vocabularies full of ties."""

import random

import pytest

from maskbench.llm import token_counts
from maskbench.llm.catalog import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def library(pieces, fallback):
    return tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=fallback))


def marked(t):
    return token_counts.MARK + t.replace(" ", token_counts.MARK) if t else ""


def test_file_vocabulary():
    pieces = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    count, lib = token_counts.Counter(pieces), library(pieces, True)
    for t in ["", " ", "  ", "a  b", " x ", "The tokens of a text.\nNext é ü 日本語 𝕏 🙂", "word " * 2000, "\t\n", "a" * 300]:
        assert count(t) == len(lib.encode(marked(t)).ids), t


@pytest.mark.parametrize("fallback", [False, True])
def test_ties(fallback):
    rng = random.Random(3)
    for _ in range(300):
        own = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)} | {token_counts.MARK}
        if rng.random() < 0.3:
            own.add("a" + token_counts.MARK + "b")
        pieces = [("<unk>", 0.0)] + ([(f"<0x{i:02X}>", 0.0) for i in range(256)] if fallback else []) + [(p, -float(rng.randint(1, 3))) for p in sorted(own)]
        t = "".join(rng.choice("abé ") for _ in range(rng.randint(1, 15)))
        assert token_counts.Counter(pieces)(t) == len(library(pieces, fallback).encode(marked(t)).ids), (pieces[-8:], t)


def test_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "x y"), (2, "x y")], "doc_id long, text string").selectExpr("*", "9 as n_chars", "8 as n_tokens")
    got = token_counts.count(docs, tokenizer_path("piece_bpe_32k.model"))
    assert sorted(map(tuple, got.fillna(-1).collect())) == [(-1, 3, 2), (1, 0, 0), (1, 0, 0), (2, 3, 2), (2, 3, 2)]
    assert token_counts.count(docs.where("false"), tokenizer_path("piece_bpe_32k.model")).count() == 0
