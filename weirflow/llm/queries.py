"""The queries of this subpackage: thin ``opN_<name>`` functions of (spark, sf_dir) over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; WEIRFLOW_TOKENIZERS names another folder."""
    folder = os.environ.get("WEIRFLOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), n AS (SELECT doc_id, words, len(words) AS n FROM w),
s AS (SELECT doc_id, n, words, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS lo FROM g GROUP BY k HAVING min(doc_id) <> max(doc_id)),
d AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT g.doc_id, g.i FROM g JOIN m USING (k) WHERE g.doc_id > m.lo), range(0, 50) r(j)),
r AS (SELECT doc_id, list(p) AS gone FROM d GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM n LEFT JOIN r ON n.doc_id = r.doc_id
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op3_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(table(spark, sf_dir, "documents"))


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from .edit_counts import count_edited

    return count_edited(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), PATTERN)


def op5_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op7_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each vector's picture is the media column, with edited copies of every fiftieth."""
    from .media import groups, pictures

    return groups(pictures(table(spark, sf_dir, "embeddings")))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_cover_anchors, op2_source_mixing, op3_bayes_jaccard, op4_edit_counts, op5_ftrl_language, op6_exact_topk, op7_local_descriptors, op8_prefix_bpe, op9_fourier_quality, op10_line_blocks)}
ORACLE: dict[str, str] = {"op1_cover_anchors": OP1_SQL, "op6_exact_topk": OP6_SQL}
