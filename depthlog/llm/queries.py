"""The registered queries of this subpackage, over the whole tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from depthlog.llm import (chunk_pieces, classifier, hard_negatives, line_dedup, neighbours, packing, quotes, simhash, suffix_dedup,
                          treap_search, tree_bpe, warc, weak_rules)
from depthlog.operators.staging import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    return classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_weak_supervision")
def op5(spark, sf_dir):
    return weak_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_tree_bpe")
def op7(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tree_bpe.digest(tree_bpe.encode(table(spark, sf_dir, "documents"), path), path)


@query("op8_pattern_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


@query("op3_nn_descent")
def op3(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query("op4_warc_chunks")
def op4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(pages, folder)
    return warc.read_archive(spark, folder).select(
        F.col("page").cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.col("refers").cast(pages.schema["page_id"].dataType).alias("refers_to"))


@query("op9_winnowed_lines", r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM cut),
c AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(regexp_extract_all(t, '[^\s\x0B]+')) AS words FROM c WHERE t <> ''),
n AS (SELECT *, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(words, 1) OVER d AS words1 FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, 2 AS more, t || chr(10) || t1 || chr(10) || t2 AS run FROM n
      UNION ALL SELECT doc_id, k, 1, CASE WHEN words + words1 >= 50 THEN t || chr(10) || t1 END FROM n
      UNION ALL SELECT doc_id, k, 0, CASE WHEN words >= 50 THEN t END FROM n),
r AS (SELECT doc_id, k, more, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS n FROM w WHERE run IS NOT NULL),
gone AS (SELECT DISTINCT k.doc_id, k.i FROM r JOIN k ON k.doc_id = r.doc_id AND k.k BETWEEN r.k AND r.k + r.more WHERE r.n > 1)
SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       md5(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_md5
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id""")
def op9(spark, sf_dir):
    out = line_dedup.marked(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
                      F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
                      F.md5(F.coalesce(line_dedup.without_lines("text", "__gone"), F.lit(""))).alias("kept_md5"))


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


#: The mails made of the conversations (quotes.as_answers): a passage's origin is the first message that has it as a whole,
#: as a paragraph or as a line.
@query("op1_quotation_links", r"""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
parts AS (SELECT conv_id, pos, unnest(list_concat([text], list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n\s*\n')))) AS part FROM n),
here AS (SELECT conv_id, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS t, min(pos) AS pos FROM parts GROUP BY ALL HAVING t <> ''),
q AS (SELECT c.conv_id, c.pos, 1 AS level, CASE WHEN c.turn % 3 = 0 THEN string_split(u.text, chr(10))[1] ELSE u.text END AS part
      FROM n c JOIN n u ON u.conv_id = c.conv_id AND u.turn = c.turn // 2 WHERE c.turn > 0
      UNION ALL SELECT c.conv_id, c.pos, 2, u.text FROM n c JOIN n u ON u.conv_id = c.conv_id AND u.turn = c.turn // 4 WHERE c.turn > 1),
o AS (SELECT q.conv_id, q.pos, level, h.pos AS origin FROM q JOIN here h ON h.conv_id = q.conv_id
      AND h.t = trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AND h.pos < q.pos),
p AS (SELECT n.*, (SELECT count(*) FROM q WHERE q.conv_id = n.conv_id AND q.pos = n.pos AND trim(regexp_replace(part, '\s+', ' ', 'g')) <> '') AS n_quotes,
        (SELECT count(*) FROM o WHERE o.conv_id = n.conv_id AND o.pos = n.pos) AS n_origins,
        (SELECT arg_min(origin, level) FROM o WHERE o.conv_id = n.conv_id AND o.pos = n.pos) AS origin FROM n),
l AS (SELECT *, CASE WHEN pos > 0 THEN coalesce(origin, pos - 1) END AS up FROM p),
r AS (SELECT conv_id, pos, pos AS root, 0 AS depth FROM l WHERE up IS NULL
      UNION ALL SELECT l.conv_id, l.pos, r.root, r.depth + 1 FROM l JOIN r ON r.conv_id = l.conv_id AND r.pos = l.up)
SELECT l.conv_id, l.turn, l.role, u.turn AS parent_turn, h.turn AS thread_turn, r.depth,
       row_number() OVER (PARTITION BY l.conv_id ORDER BY r.root, r.depth, l.pos) - 1 AS place, md5(l.text) AS own_md5,
       CAST(l.n_quotes AS INT) AS n_quotes, CAST(l.n_origins AS INT) AS n_origins, l.origin IS NOT NULL AS linked
FROM l JOIN r ON r.conv_id = l.conv_id AND r.pos = l.pos JOIN n h ON h.conv_id = l.conv_id AND h.pos = r.root
LEFT JOIN n u ON u.conv_id = l.conv_id AND u.pos = l.up""")
def op1(spark, sf_dir):
    mails = quotes.as_answers(table(spark, sf_dir, "conversations"))
    return quotes.threads(mails).select(
        "conv_id", "turn", "role", "parent_turn", "thread_turn", "depth", "place", F.md5("own").alias("own_md5"), "n_quotes", "n_origins", "linked")


@query("op11_four_russians", """
WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT vec_id, label, list_transform(v, lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM whole
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        CAST(list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""")
def op11(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.turned_labels(table(spark, sf_dir, "embeddings")))


@query("op12_chunk_pieces")
def op12(spark, sf_dir):
    return chunk_pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_treap_search", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
g AS (SELECT f.doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS part
      FROM f JOIN d USING (doc_id) JOIN w USING (term), a),
s AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN g USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""")
def op13(spark, sf_dir):
    return treap_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
