"""The registered queries of the subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from functools import wraps

from tillscope.llm import (exact_dedup, hard_negatives, hash_search, licenses, line_quality, lm_score, ngram_join, packing,
                           piece_fst, secrets, shards, spelling, token_orc)
from tillscope.llm.common import bounded_batches, visible_to_workers


def _ready(query):
    @wraps(query)
    def run(spark, sf_dir):
        visible_to_workers(spark)
        bounded_batches(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {name: _ready(query) for name, query in {
    "op1_piece_fst": piece_fst.op1,
    "op2_ngram_jaccard": ngram_join.op2,
    "op3_license_scan": licenses.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_sampled_shards": shards.op5,
    "op6_token_orc": token_orc.op6,
    "op7_lattice_lm": lm_score.op7,
    "op8_line_quality": line_quality.op8,
    "op9_tier_packing": packing.op9,
    "op10_secret_novelty": secrets.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_hash_search": hash_search.op12,
    "op13_spelling_variants": spelling.op13,
}.items()}

_SPACE = r"[\x20\x09-\x0D]"

SQL = {
    "op4_exact_dedup": rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS text_sha256,
                  doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AS from_snapshot FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256, from_snapshot
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10""",
}
