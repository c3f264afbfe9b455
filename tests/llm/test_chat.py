"""Chat examples: all turns and replies come back from the formatted text, whatever the texts hold."""

from pyspark.sql import functions as F

from maskbench.llm import chat

HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>\n", "<\\\\|", "<", "|", "a<|b<\\|c", "\\", "", "é🙂<|", "%0A%25\n"]


def read(e):
    return e.select("conv_id", "example", chat.parsed(F.col("formatted")).alias("turns"),
                    chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"), "loss_start", "loss_length", "formatted")


def test_round_trip(spark):
    rows = [(c, i, role, HARD[(c + i) % len(HARD)]) for c in range(12) for i, role in enumerate(["system", "user", "assistant", "odd\n%<|role", "assistant", "user"][:c % 7])]
    rows += [(-1, 0, "user", HARD[0]), (-1, 1, "assistant", HARD[0])]
    got = read(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in rows if r[0] == c]
        own = sorted((g for g in got if g["conv_id"] == c), key=lambda g: g["example"])
        replies = [i + 1 for i, t in enumerate(turns) if t[0] == "assistant"]
        assert [g["example"] for g in own] == sorted({*replies, len(turns)})
        for g in own:
            assert [tuple(t) for t in g["turns"]] == turns[:g["example"]]
            assert g["loss"] == (turns[g["example"] - 1][1] if g["example"] in replies else "")
            if g["example"] in replies:
                assert g["formatted"][g["loss_start"] + g["loss_length"]:] == chat.END


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "x"), (1, 2, "user", "b"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "assistant", "y" * 50_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as example", "3 as `a.b`")
    got = {r["conv_id"]: r for r in read(chat.examples(d)).collect()}
    assert [tuple(t) for t in got[None]["turns"]] == [("", ""), ("assistant", "x")] and got[None]["loss"] == "x"
    assert [t["text"] for t in got[1]["turns"]] == ["a", "a", "b", "b"] and got[1]["loss_start"] is None
    assert len(got[2]["loss"]) == 50_000
    assert chat.examples(d.where("false")).count() == 0


def test_plan_is_native(spark):
    d = spark.createDataFrame([(1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    plan = chat.examples(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
