"""The registered queries of these operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (chat, divergence, jaccard, licenses, line_dedup, lm_scoring, media, mixing, neardup_vectors, packing, quality, search,
               token_counts)
from .base import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the byte model and by the word model."""
    return lm_scoring.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, the group that its links reach, and the number of its links."""
    return jaccard.near_links(table(spark, sf_dir, "documents"))


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op9_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (CAST('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (
  SELECT *, most / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER o - most))
      / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level,
    row_number() OVER o AS place
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
f AS (SELECT *, min(CASE WHEN level * weight <= most THEN place END) OVER () AS free FROM l),
t AS (SELECT source, source_size, n,
        CASE WHEN place < free OR free IS NULL THEN most::DOUBLE
             ELSE weight * max(CASE WHEN place = free THEN level END) OVER () END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS rate FROM t),
k AS (SELECT d.doc_id, d.source, d.size, r.n, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS part, d.u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(1e6::DOUBLE * (size::DOUBLE * n) / (size::DOUBLE * n + source_size)) ELSE 0 END::BIGINT AS h FROM k),
i AS (SELECT *, part + (h - sum(size * h) OVER (PARTITION BY source)::DOUBLE / source_size) / 1e6::DOUBLE * least(part, 1 - part) AS p FROM h),
q AS (SELECT *, CASE WHEN part > 0 AND p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM i),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM q)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN odds IS NOT NULL AND middle <= part * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM m
"""


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document; rows whose remainder is 0 never teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under a unigram vocabulary."""
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as training examples, read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    e = chat.examples(turns.unionByName(more))
    read = e.select("conv_id", "example", "formatted", chat.loss_text("formatted", F.col("loss_start"), F.col("loss_length")).alias("loss"))
    conv = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.sum(F.length("formatted")).alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    back = conv.withColumn("turns", chat.parsed(F.col("whole")))
    line = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))


ORACLES["op5_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (
  SELECT *, 12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11 AS chars,
         row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM p)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector and the group that they reach."""
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Matroska audio, read back, and measured."""
    c = media.columns(media.store(table(spark, sf_dir, "documents")))
    last = F.element_at("packets", -1)
    feature = F.concat_ws(";", F.concat(F.lit("packets="), F.size("packets")), F.concat(F.lit("clusters="), last["cluster"] + 1),
                          F.concat(F.lit("cues="), F.size("cues")), F.concat(F.lit("last_ms="), F.floor(last["timestamp_ns"] / 1_000_000)),
                          F.concat(F.lit("laced="), F.size(F.filter("packets", lambda p: p["lacing"] > 0))), F.concat(F.lit("error="), F.coalesce("error", F.lit("none"))))
    return c.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                    F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
                    F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of every language, and the terms that set each source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*)::BIGINT AS v, sum(total)::BIGINT AS whole FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::BIGINT AS size FROM n GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(s.size, 0) + 5 * v.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.total + 5)) // (v.whole + 5 * v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN s USING (lang, source)),
pr AS (
  SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
ps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pr LEFT JOIN ps USING (lang, source, item)),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
t AS (SELECT r, doc_id, len(words)::BIGINT AS size, unnest(words) AS term FROM d),
f AS (SELECT r, doc_id, size, term, count(*)::BIGINT AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, c.n),
s AS (
  SELECT q.i, q.item_id, f.r, f.doc_id,
         sum(q.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * f.size * c.n) // c.l))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those dropped because many documents share them, and a digest of the rest."""
    return line_dedup.strip_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op13_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
