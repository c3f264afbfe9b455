"""Token counts of texts under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"                   # fixed value: the sign that stands for a space
UNKNOWN_PENALTY = 10.0            # fixed value: an unknown character scores so much less than the worst piece


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, byte and control pieces included, in id order."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    """Number of pieces of the best segmentation, the largest sum of scores.

    Aho-Corasick finds all pieces that end at each character; the dynamic program keeps the best score and
    its piece count at each character. Of equal scores the one whose last piece is longest stays, which is
    the tokenizer's rule: it extends from left to right and replaces only what is strictly worse. A character
    that is no piece scores UNKNOWN_PENALTY less than the worst piece and counts as its bytes if the vocabulary
    has byte pieces, else as one; unknown characters that follow one another then count once.

    If the mark occurs in pieces only before other characters, a segmentation always breaks before a run of
    marks, so that the runs are counted one by one and remembered up to a bound.
    """

    LIMIT = 400_000

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes = all(f"<0x{i:02X}>" in {p for p, _ in pieces} for i in range(256))
        special = {"<unk>", "<s>", "</s>", "<pad>"} | ({f"<0x{i:02X}>" for i in range(256)} if self.bytes else set())
        own = [(p, s) for p, s in pieces if p and p not in special]
        for p, s in own:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p, _ in own if len(p) == 1}
        self.unknown = min([s for _, s in pieces], default=0.0) - UNKNOWN_PENALTY
        self.cut = all(MARK not in p.lstrip(MARK) for p, _ in own)
        self.known: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces of one text, as it is."""
        n = len(text)
        if not n:
            return 0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(text):
            ends[end].append(hit)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            for length, s in sorted(ends[end - 1], reverse=True):
                x = score[end - length] + s
                if top is None or x > top:
                    top, step, miss = x, length, False
            if text[end - 1] not in self.single:
                x = score[end - 1] + self.unknown
                if top is None or x > top:
                    top, step, miss = x, 1, True
            score[end], unknown[end] = top, miss
            count[end] = count[end - step] + (1 if not miss else len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes
                                              else 0 if unknown[end - 1] else 1)
        return count[n]

    def __call__(self, text: str) -> int:
        """Pieces of a text whose spaces become marks, with a mark before it."""
        if not text:
            return 0
        if not self.cut or MARK in text or "  " in text or text[0] == " ":
            return self._runs(MARK + text.replace(" ", MARK))
        known, total = self.known, 0
        for w in text.split(" "):
            n = known.get(w)
            if n is None:
                if len(known) >= self.LIMIT:
                    known.clear()
                n = known[w] = self.best(MARK + w)
            total += n
        return total

    def _runs(self, text: str) -> int:
        if not self.cut:
            return self.best(text)
        total, at = 0, 0
        for i in range(1, len(text)):
            if text[i] == MARK and text[i - 1] != MARK:
                total, at = total + self.best(text[at:i]), i
        return total + self.best(text[at:])


_LOADED: dict[str, Counter] = {}


def count(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens) for every whole text, by the vocabulary in the file ``tokenizer``.

    Null text is empty and has no tokens; a null id is kept; repeated rows are counted each; other columns
    are left out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = Counter(vocabulary(tokenizer))
        counter = _LOADED[tokenizer]
        for b in batches:
            n = [counter(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"),
                    F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
