"""The pipeline's stages, each against a plain version on what its predecessor kept."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from maskbench.llm import catalog, quality
from test_jaccard import plain as plain_groups

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "er", "st", "ou", "ti", "re"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(240):
        t = [word() for _ in range(rng.randint(8, 90))]
        bad = i % 5 == 0
        clean = [r[1] for r in rows if r[0] % 5]
        if clean and not bad and rng.random() < 0.25:
            t = rng.choice(clean).split()
        text = " ".join(t).upper().replace(" ", "!! ") if bad else " ".join(t)
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [rows[3], (300, "", "en", "a", 0), (301, None, None, "b", None), (None, "some text without an id", None, None, 3)]
    for i in range(0, 240, 10):
        labels.append((i, 0, 0))
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def multiset(df):
    return Counter(tuple(None if x is None or x != x else x for x in r) for r in df.itertuples(index=False))


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, before = [], docs
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        out = fn(spark, before, folder)
        out.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert before.columns == corpus_pipeline.COLUMNS
        kept.append(before.toPandas().astype(object))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]

    judged = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = judged.where("predicted = 1").select(*corpus_pipeline.COLUMNS).toPandas().astype(object)
    assert multiset(kept[0]) == multiset(want)
    assert all(i is None or i != i or i % 5 or i >= 240 for i in kept[0].doc_id)       # shouting is rejected, the rest stays
    assert len(set(kept[0].doc_id.dropna())) >= 190

    rows = [(None if r[0] != r[0] or r[0] is None else int(r[0]), r[1] if isinstance(r[1], str) else None) for r in kept[0][["doc_id", "text"]].itertuples(index=False)]
    group = {d: c for d, _, c in plain_groups(rows) if d >= 0}
    left = [None if d != d or d is None else int(d) for d in kept[1].doc_id]
    assert sorted(d for d in left if d is not None) == sorted(d for d, c in group.items() if d == c) and left.count(None) == 1

    con = duckdb.connect()
    stage2 = kept[1].assign(doc_id=pd.array([None if d != d or d is None else int(d) for d in kept[1].doc_id], dtype="Int64"))
    con.register("documents", stage2)
    taken = con.execute(catalog.ORACLES["op9_source_mixing"]).df()
    copies = {None if pd.isna(r.doc_id) else int(r.doc_id): int(r.taken // r.size_) for r in taken.rename(columns={"size": "size_"}).itertuples() if r.size_}
    mixed = Counter(None if d != d or d is None else int(d) for d, t in kept[2][["doc_id", "text"]].itertuples(index=False) if isinstance(t, str) and t.split())
    assert mixed == Counter({d: n for d, n in copies.items() if n})

    lib = tokenizers.Tokenizer.from_file(catalog.tokenizer_path())
    need = sum(len(lib.encode(t if isinstance(t, str) else "", add_special_tokens=False).ids) + 1 for t in kept[2].text)
    p = kept[3]
    assert p.length.sum() == need
    places = defaultdict(list)
    for r in p.itertuples():
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 1024
    assert len(places) <= -(-need // 1024) + max(2, need // 10240)

    whole = corpus_pipeline.run(spark, folder).toPandas().astype(object)
    assert multiset(whole.drop(columns=["sequence_id", "offset"])) == multiset(p.drop(columns=["sequence_id", "offset"]))


def test_one_of_each_group_by_rows(spark, folder):
    """Groups of null ids, ids with two texts, and rows without words."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = ([(None, f"{a} {x}") for x in "pqrs"] + [(None, f"{a} p")] * 2          # near copies without ids: one stays
            + [(None, f"{b} {x}") for x in "pq"] + [(7, f"{b} r")]                 # one of them has an id: it stays
            + [(5, c), (9, f"{c} p"), (9, d)]                                      # 9 is a copy in one of its two texts only
            + [(4, f"{e} p"), (4, f"{e} q"), (4, f"{e} q")]                        # near copies of one id
            + [(None, text()), (None, ""), (None, ""), (6, None), (6, None)])
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        left = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs.repartition(parts), folder).collect())
        assert sum(n for (i, t), n in left.items() if i is None and t.startswith(a)) == 1
        assert [k for k in left if k[1] and k[1].startswith(b)] == [(7, f"{b} r")]
        assert [k for k in left if k[1] and k[1].startswith(c)] == [(5, c)] and left[9, d] == 1
        assert sum(n for (i, t), n in left.items() if i == 4) == 1
        assert left[None, ""] == 2 and left[6, None] == 2 and left[None, rows[-5][1]] == 1
