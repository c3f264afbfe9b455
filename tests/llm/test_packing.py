"""Packing: ids equal the tokenizer's, pieces follow the rule, sequences are gapless and few."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from maskbench.llm import packing
from maskbench.llm.catalog import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["", "a", "  two  spaces ", "line\n\nend ", "tab\tand nbsp  x", "<|endoftext|> inside <|endoftext|>", "é ü 日本語 🙂 x",
         "don't we'll I'M", "a \n b\n  c", " lead", "trail ", "x" * 50, "1234 5 6.7", "word " * 3000]


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_ids_equal_the_tokenizers(whole):
    encode = packing.tokens_from(tokenizer_path())
    for t in TEXTS:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab C.é'\n\t  <|>1", max_size=30))
def test_ids_of_odd_spacing(text):
    encode = packing.tokens_from(tokenizer_path())
    whole = tokenizers.Tokenizer.from_file(tokenizer_path()) if not hasattr(packing, "_w") else packing._w
    packing._w = whole
    assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_best_fit_places_every_rank_once(counts):
    runs = packing.best_fit(counts, 64)
    used, places = {}, {}
    for length, lo, hi, seq, each, base in runs:
        for r in range(lo, hi):
            assert (length, r) not in places
            places[length, r] = True
            s = seq + (r - lo) // each
            used.setdefault(s, []).append((base + (r - lo) % each * length, length))
    assert len(places) == sum(counts.values())
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    # one document at a time into the tightest gap, longest first, opens as many
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = [g for g in gaps if g >= length]
        g = min(fit) if fit else 64
        if fit:
            gaps.remove(g)
        gaps.append(g - length)
    assert len(used) == len(gaps)


def test_pack_whole(spark, whole):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "no id"), (7, TEXTS[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as offset", "'x' as `a.b`")
    got = packing.pack(docs, tokenizer_path(), capacity=64, keep_ids=True).toPandas()
    want = {}
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(-1 if i is None else i, ids)
    for (doc), g in got.fillna({"doc_id": -1}).groupby("doc_id"):
        ids = want[int(doc)]
        copies = 2 if doc == 7 else 1
        assert g.length.sum() == copies * len(ids)
        g = g.drop_duplicates("piece").sort_values("piece")
        assert g.piece.tolist() == list(range(len(g)))
        assert (g.length.iloc[1:] == 64).all() and g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        for r in g.itertuples():
            part = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert bytes(r.ids) == part and zlib.crc32(part) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_a_worker_loads_the_whole_tokenizer_only_for_special_tokens(whole):
    """What every worker keeps counts against its executor."""
    t = packing.ByteTokens(tokenizer_path())
    t("plain text")
    assert "whole" not in vars(t)
    text = f"a {t.special[0]} b"
    assert np.frombuffer(t(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids and "whole" in vars(t)
