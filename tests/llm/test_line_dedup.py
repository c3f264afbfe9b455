"""Line dedup against a plain version, runs and compaction, and the plan's freedom from Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from maskbench.llm import line_dedup

SCHEMA = "doc_id long, text string"


def plain(rows, least_docs=5, least_chars=40):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least_chars:
                held.setdefault(k, []).append(d)
    keeper = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA, **more):
    d = line_dedup.strip_lines(spark.createDataFrame(rows, schema), **more)
    return sorted(map(tuple, d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    shared = [rng.choice(["Über", "Plain", "Éa"]) + f" shared line {i} " + "x" * rng.randint(10, 60) for i in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 9)):
            x = rng.choice(shared) if rng.random() < 0.5 else f"own line {rng.randint(0, 400)} of the document " + "y" * rng.randint(0, 30)
            if rng.random() < 0.4:
                x = rng.choice([x.upper().replace("Ü", "ü"), "\t " + x + " \r", x + " "])
            lines += [x] * rng.choice([1, 1, 1, 2])
        rows.append((i, "\n".join(lines)))
    rows += [(5, rows[5][1]), (5, shared[0] + "\nelse"), (None, shared[1]), (None, shared[1]), (None, "\n" + shared[2] + "\n"), (n, None), (n + 1, ""), (n + 2, "\n\n")]
    return rows + [(n + 3, "\n".join(f"{shared[3]}\nline number {i} of a very long document, not shared" for i in range(5_000)))]


def test_equals_plain_version(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(spark, rows) == plain(rows)
    assert any(r[2] for r in plain(rows))


def test_runs_and_compaction_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    for batches in (1, 3, 12):
        assert got(spark, rows, batches=batches) == plain(rows)
    assert got(spark, rows, least_docs=2, least_chars=10) == plain(rows, 2, 10)


def test_hot_keys_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 20)
    rows = corpus(4) + [(1000 + i, "The very same line stands in each of these documents.") for i in range(200)]
    assert got(spark, rows) == plain(rows)


def test_levels(spark):
    """Four runs of a level make one of the next; settled keys stay out of later runs."""
    runs = line_dedup.Runs(least_docs=3)
    batch = lambda i, keys: spark.createDataFrame([(k, True, 100 - i) for k in keys], "hash long, first boolean, doc_id long")
    for i in range(4):
        runs.add(batch(i, [1, 10 + i]))
    assert [len(x) for x in runs.levels] == [0, 1] and len(runs.settled) == 1
    runs.add(batch(4, [1, 10]))
    assert [r.hash for r in runs.levels[0][0].collect()] == [10]
    runs.add(batch(5, [10]))
    found = {r.hash: (r.docs, r.keeper) for r in runs.frequent().collect()}
    assert found == {1: (4, 100), 10: (3, 100)}


def test_null_ids_only_and_empty_table(spark):
    rows = [(None, "one line that all of these rows with no id hold together")] * 6
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_columns_that_clash_are_replaced(spark):
    rows = corpus(5, 30)
    d = line_dedup.strip_lines(spark.createDataFrame([(*r, 1, "k", 7) for r in rows], SCHEMA + ", n_lines long, kept string, pos int"))
    assert d.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped", "kept"] and d.where("pos <> 7").isEmpty()


def test_no_python_on_the_executors(spark):
    d = line_dedup.strip_lines(spark.createDataFrame(corpus(6, 20), SCHEMA))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan and "CartesianProduct" not in plan
