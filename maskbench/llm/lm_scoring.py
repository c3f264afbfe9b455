"""Scoring of documents by a byte model: prediction by partial matching with exclusion."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import bytes_of, parts_for, staged, word_codes

ORDER = 4
BLOCK = 16 << 20                 # bytes of text that one task holds
SLICE = 2 << 20                  # positions that are worked on at once
SYMBOLS = 255                    # the bytes of UTF-8 and the end of the text; 0xFE stands before a text
BEFORE, END = b"\xfe", b"\xff"


def grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of (context of ``order`` bytes, next symbol) of all texts, with the number of the text, in slices.

    Texts are joined a slice at a time; only a longer text is joined, and then cut, by itself.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < SLICE):
            size, last = size + len(texts[last]) + order + 1, last + 1
        for code, of in _joined_grams(texts[first:last], order):
            yield code, of + first
        first = last


def _joined_grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ends = np.cumsum([len(t) + order + 1 for t in texts])
    buf = np.frombuffer(b"".join([BEFORE * order + t + END for t in texts]), np.uint8)
    for lo in range(0, len(buf), SLICE):
        part = buf[max(0, lo - order):lo + SLICE]
        if len(part) <= order:
            continue
        code = np.zeros(len(part) - order, np.int64)
        for i in range(order + 1):
            code = (code << 8) | part[i:len(part) - order + i]
        at = np.arange(max(0, lo - order) + order, lo + len(part) - (lo - max(0, lo - order)))
        real = part[order:] != BEFORE[0]
        at = at[real]
        yield code[real], np.searchsorted(ends, at, side="right")


def _counted(t: pa.Table, order: int) -> pa.Table:
    """Distinct words and grams of a block with their counts in its training texts."""
    block, texts, held = t.column("block")[0].as_py(), bytes_of(t.column("text")), t.column("held_out").to_pylist()
    out = []
    for kind in (0, 1):
        found: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        for side in (False, True):
            own = [x for x, h in zip(texts, held) if h == side]
            if kind == 0:
                lists = (word_codes(x.lower().split()).view(np.int64) for x in own)
                parts = _chunks(lists)
            else:
                parts = (c for c, _ in grams(own, order))
            keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
            for p in parts:
                k, m = np.unique(p, return_counts=True)
                both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
                keys = both
            found[side] = keys, n
        extra = np.setdiff1d(found[True][0], found[False][0], assume_unique=True)
        key = np.concatenate([found[False][0], extra])
        out.append(pa.table({"block": pa.array(np.full(len(key), block, np.int32)), "kind": pa.array(np.full(len(key), kind, np.int32)),
                             "key": pa.array(key), "n": pa.array(np.concatenate([found[False][1], np.zeros(len(extra), np.int64)]))}))
    return pa.concat_tables(out)


def _chunks(lists: Iterator[np.ndarray], most: int = SLICE) -> Iterator[np.ndarray]:
    held, n = [], 0
    for x in lists:
        held.append(x)
        n += len(x)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _step(n: Column) -> Column:
    """Counts to classes: up to 3 as they are, then one class for each power of two, the last from 512 on."""
    return F.when(n < 4, n).otherwise(F.least(F.lit(10), F.length(F.bin(n)) + 1)).cast("int")


def escapes(level: DataFrame) -> DataFrame:
    """(c_tot, c_kinds, esc): the chance of a new symbol in a context of so many symbols, so many of them distinct.

    Estimated by leaving out each occurrence of the level in turn: an occurrence of a symbol that a context
    saw once would have been new to it, any other not. There are 121 classes at most.
    """
    n = F.col("n")
    per = level.groupBy(F.shiftright("code", 8).alias("context")).agg(
        F.sum("n").alias("tot"), F.count(F.when(n > 0, 1)).alias("kinds"), F.count(F.when(n == 1, 1)).alias("once")).where("tot > 1")
    tot, kinds, once = F.col("tot"), F.col("kinds"), F.col("once")
    events = per.select(F.explode(F.array(
        F.struct(_step(tot - 1).alias("c_tot"), _step(kinds - 1).alias("c_kinds"), once.alias("new"), once.alias("of")),
        F.struct(_step(tot - 1).alias("c_tot"), _step(kinds).alias("c_kinds"), F.lit(0).cast("long").alias("new"), (tot - once).alias("of")))).alias("e"))
    return events.groupBy("e.c_tot", "e.c_kinds").agg(F.greatest(F.lit(1e-6), F.least(F.lit(0.98), (F.sum("e.new") + 0.5) / (F.sum("e.of") + 1.0))).alias("esc"))


def trie(grams_n: DataFrame, order: int) -> DataFrame:
    """(code, lp): log10 probability of the last byte of each code after the bytes before it.

    ``grams_n`` has every gram that occurs in any text, with its count in the training texts (0 if it has
    none). A shorter context counts, for each symbol, the longer contexts that saw it (update exclusion).
    A context escapes to the one that is a byte shorter with the chance that :func:`escapes` gives for its
    counts; else a symbol gets its share of the context's counts. After an escape the symbols that the
    longer context has seen are excluded. As the symbols of a context also follow its shorter ones, these
    are exactly the longer context's symbols. After the empty context the symbols never seen share alike.

    Groups are the symbols of one context, or the contexts that differ in one byte: 256 at most.
    """
    levels = [staged(grams_n)]
    for k in range(order, 0, -1):
        short = F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels.append(staged(levels[-1].groupBy(short.alias("code")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"))))
    levels.reverse()                                          # levels[k]: contexts of k bytes

    def ln(c: Column) -> Column:                              # every use is of a count of at least 1
        return F.log(F.greatest(c, F.lit(1)).cast("double"))

    def with_escape(df: DataFrame, k: int, tot: Column, kinds: Column) -> DataFrame:
        e = F.broadcast(escapes(levels[k]))
        x = df.withColumn("_t", _step(tot)).withColumn("_k", _step(kinds))
        return (x.join(e, (F.col("_t") == F.col("c_tot")) & (F.col("_k") == F.col("c_kinds")), "left")
                .withColumn("esc", F.coalesce("esc", F.greatest(kinds, F.lit(1)) / F.greatest(tot + kinds, F.lit(2))))
                .drop("_t", "_k", "c_tot", "c_kinds"))

    context = Window.partitionBy(F.shiftright("code", 8))     # at level 0 the whole level: one row per symbol
    tot, kinds = F.sum("n").over(context).alias("tot"), F.count(F.when(F.col("n") > 0, 1)).over(context).alias("kinds")
    at = levels[0].select("code", "n", tot, kinds).withColumn("lq", -ln(F.lit(SYMBOLS) - F.col("kinds")))
    for k in range(1, order + 1):
        up = at.select(F.col("code").alias("up"), *[F.col(c).alias(f"up_{c}") for c in ("n", "tot", "kinds", "lq")])
        x = levels[k].join(up, F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("up")).select(
            "*", tot, kinds, F.sum(F.when(F.col("n") > 0, F.col("up_n")).otherwise(0)).over(context).alias("gone"))
        rest, left = F.col("up_kinds") - F.col("kinds"), F.col("up_tot") - F.col("gone")
        at = with_escape(x, k - 1, left, rest).select("code", "n", "tot", "kinds", F.when(rest <= 0, F.col("up_lq"))
                                                      .when(F.col("up_n") > 0, F.log(1 - F.col("esc")) + ln(F.col("up_n")) - ln(left))
                                                      .otherwise(F.log("esc") + F.col("up_lq")).alias("lq"))
    lp = (F.when(F.col("n") > 0, F.log(1 - F.col("esc")) + ln(F.col("n")) - ln(F.col("tot")))
          .when(F.col("tot") > 0, F.log("esc") + F.col("lq")).otherwise(F.col("lq")))
    return with_escape(at, order, F.col("tot"), F.col("kinds")).select("code", (lp / F.log(F.lit(10.0))).alias("lp"))


def score(docs: DataFrame, held_out: Column, order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """Score whole texts by models learnt from the rows that are not held out.

    ``score`` is log10 of the probability that the byte model gives to the text and its end; ``base_score``
    the same of a model of single words with add-one smoothing. Texts are dealt by id and text into blocks of about
    ``block`` bytes. A block sends each of its distinct words and grams once, with its counts; counts are summed
    over all blocks and the probabilities are worked out per gram; each block gets back the rows it asked for
    and scores its texts. So no task holds the model, only what its block needs, and nothing is broadcast.
    Words travel as 64-bit codes.

    Null text is empty: one token, the end, and the byte model's probability of ending at once. A null id is
    hashed as empty text and kept; repeated rows count each; other columns are left out; an empty table
    gives an empty result; without training texts every known count is 0 and bytes share alike.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    size = d.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.when(~F.col("held_out"), 1)).alias("train")).first()
    blocks = parts_for(size["b"], block)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    items = staged(d.groupBy("block").applyInArrow(lambda t: _counted(t, order), "block int, kind int, key long, n long"))
    words = staged(items.where("kind = 0").groupBy("key").agg(F.sum("n").alias("c")))
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train = size["train"] or 0
    total, distinct = seen["n"] + train, seen["v"] + (1 if train else 0)
    lp = trie(items.where("kind = 1").groupBy(F.col("key").alias("code")).agg(F.sum("n").alias("n")), order)
    asked = items.select("block", "kind", "key")
    values = (asked.where("kind = 0").join(words, "key").select("block", "kind", "key", F.col("c").cast("double").alias("value"))
              .unionByName(asked.where("kind = 1").join(lp, F.col("key") == F.col("code")).select("block", "kind", "key", F.col("lp").alias("value"))))

    def run(t: pa.Table, model: pa.Table) -> pa.Table:
        texts = bytes_of(t.column("text"))
        kind, key, value = (model.column(k).to_numpy() for k in ("kind", "key", "value"))
        table = []
        for k in (0, 1):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own])]
            table.append((key[own], value[own]))
        rows = []
        bottom = total + distinct + 1
        end = np.log10((train + 1) / bottom)
        for x in texts:
            w = x.lower().split()
            c = table[0][1][np.searchsorted(table[0][0], word_codes(w).view(np.int64))] if w else np.empty(0)
            rows.append((len(w) + 1, int(np.count_nonzero(c)) + (train > 0), float(np.log10((c + 1) / bottom).sum() + end)))
        score = np.zeros(len(texts))
        for code, of in grams(texts, order):
            score += np.bincount(of, table[1][1][np.searchsorted(table[1][0], code)], len(texts))
        n, known, base = (np.array(x) for x in zip(*rows)) if rows else (np.empty(0),) * 3
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(n, pa.int64()),
                         "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(texts), total), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return d.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
