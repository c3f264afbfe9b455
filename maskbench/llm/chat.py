"""Chat formatting: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, REPLY = "<|im_start|>", "<|im_end|>\n", "assistant"


def escaped(c: Column) -> Column:
    """Put a backslash into everything that looks like the opening of a control string."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def role_out(c: Column) -> Column:
    """A role on one line: percent signs and line ends are written as codes."""
    return escaped(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def role_in(c: Column) -> Column:
    return F.replace(F.replace(unescaped(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def examples(turns: DataFrame, reply: str = REPLY) -> DataFrame:
    """Prefix-target expansion of the rows (conv_id, turn, role, text).

    Returns one row for each turn of ``reply``, holding all turns up to it, and one row without a target
    for a conversation that ends otherwise, so that no turn is lost: conv_id, example (turns it holds),
    formatted, loss_start and loss_length (code points of ``formatted`` that are trained, just the reply's
    text). Context is repeated in each example of a conversation, as the method asks; a conversation is
    gathered as one row, and is the unit that has to fit in memory.

    Rows of a conversation go by turn, then role, then text, so that repeated turns have an order; null
    turns come first, null roles and texts are empty, rows without a conversation form one; other columns
    are left out; an empty table gives an empty result.
    """
    t = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    conv = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: escaped(x["text"])).alias("texts"))
    pieces = F.zip_with("roles", "texts", lambda r, x: F.concat(F.lit(START), role_out(r), F.lit("\n"), x, F.lit(END)))
    n = F.size("roles")
    last = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("roles", i) == reply) | (i == n))
    each = conv.withColumn("pieces", pieces).withColumn("example", F.explode(last))
    body = F.element_at("texts", F.col("example"))
    is_reply = F.element_at("roles", F.col("example")) == reply
    return (each.withColumn("formatted", F.array_join(F.slice("pieces", F.lit(1), F.col("example")), ""))
            .select("conv_id", "example", "formatted",
                    F.when(is_reply, F.length("formatted") - F.lit(len(END)) - F.length(body)).alias("loss_start"),
                    F.when(is_reply, F.length(body)).otherwise(0).alias("loss_length")))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    cut = F.split(formatted, r"<\|im_end\|>\n", -1)
    whole = F.slice(cut, F.lit(1), F.size(cut) - 1)
    rest = F.transform(whole, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(rest, lambda p: F.struct(
        role_in(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """What the mask of an example covers, as it was before escaping."""
    return F.when(start.isNull(), F.lit("")).otherwise(unescaped(F.substring(formatted, start + 1, length)))
