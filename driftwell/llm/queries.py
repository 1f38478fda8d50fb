"""One query per operator over its whole table; the digest columns of a query are derived from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import bpe, collisions, collocations, debruijn, forest, mixing, quality, sharding, simhash, suffixes, toxicity, trie, warc
from driftwell.llm.common import table
from driftwell.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs, ["doc_id", "text_crc32", "size"], 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    laid, pieces, placement = mixing.mix(table(spark, sf, "documents"))
    return mixing.words_taken(laid, pieces, placement).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_debruijn(spark: SparkSession, sf: str) -> DataFrame:
    cut = debruijn.remove_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: str) -> Column:
    """Rows from which no label is learned; a null id has no label and counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    weights, bias = toxicity.train(docs, labels.where(~held_out("doc_id")))
    scored = toxicity.score(docs, weights, bias)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark, "archives")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_forest(spark: SparkSession, sf: str) -> DataFrame:
    return forest.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op10_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return collisions.near_duplicates(table(spark, sf, "embeddings"))


@query
def op11_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    found = collocations.best(collocations.collocations(table(spark, sf, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf, "conversations")).drop("a", "b")


ORACLES["op3_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
same AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1),
j AS (SELECT d.*, CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM d LEFT JOIN same USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j"""

ORACLES["op8_debruijn"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS source FROM g GROUP BY win),
gone AS (SELECT DISTINCT g.doc_id, g.i + j AS pos FROM g JOIN f USING (win), (SELECT unnest(range(13)) AS j) WHERE source < g.doc_id),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM e ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ORACLES["op10_collisions"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

ORACLES["op12_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
cuts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, n.n, ((1000::HUGEINT * cuts.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN n USING (lang) JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a
  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000"""

ORACLES["op13_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, own, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
  lambda acc, byte: list_reduce(range(8), lambda v, step: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(acc, byte)),
  4294967295), 4294967295) % 4 AS h FROM t),
s AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM crc c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, seq, d AS depth, seq[1:d] AS prefix FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
v AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
j AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (depth, prefix)),
u AS (SELECT a.depth, a.prefix, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves,
  sum(CASE WHEN y.depth = 0 THEN 0 ELSE (y.n_convs - 1) * len(list_filter(string_split_regex(y.prefix[-1].x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END)::BIGINT AS saved_tokens
  FROM j a JOIN j y ON y.prefix[1:a.depth] = a.prefix AND y.depth >= a.depth GROUP BY ALL)
SELECT j.conv_id, j.depth, o.conv_id AS parent_conv_id, j.n_convs, j.n_children, n_leaves, saved_tokens, j.ends_sha256
FROM j JOIN u USING (depth, prefix) LEFT JOIN v o ON o.depth = j.depth - 1 AND o.prefix = j.prefix[1:j.depth - 1]"""
