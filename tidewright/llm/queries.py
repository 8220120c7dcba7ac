"""The queries opN_<name> of this package, and the SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import crf_quality, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, prefix_trie, sentencepiece_codec, simhash_join, suffix_dedup, topk_search, warc, whitening
from tidewright.llm.common import documents, shared_folder, write_table

#: Where the public vocabulary files are; a parameter of the operators.
TOKENIZERS = os.environ.get("TIDEWRIGHT_TOKENIZERS") or "/opt/tokenizers"


def piece_model() -> str:
    return f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return crf_quality.score_quality(docs, crf_quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(documents(spark, sf_dir).select("doc_id", "text"), piece_model()).drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir)).drop("node")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = warc.assemble(write_table(warc.read_warc(spark, path, blocks=False), "records"))
    response = F.col("response")
    return captures.select("page_id", response["payload_bytes"].alias("payload_bytes"), response["payload_digest"].alias("payload_digest"), response["type"].alias("record_type"), F.col("of_page_id").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.search(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 of the decimal digits of an id: a byte is mixed in, then eight times one bit leaves.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
OP11_SQL = f"""
WITH f AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(role)), ':', role, text))) AS turns FROM f GROUP BY conv_id),
g AS (SELECT conv_id, turns, {_CRC} % 6 AS h FROM o),
r AS (SELECT g.conv_id, CASE WHEN h = 0 THEN g.turns ELSE coalesce(b.turns[1:h], []) || g.turns[h + 1:] END AS s
      FROM g LEFT JOIN o b ON b.conv_id = g.conv_id - g.conv_id % 100),
p AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS k, len(s) = d AS ended FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended) AS ends FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, CASE WHEN d = 1 THEN [] ELSE k[1:d - 1] END AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, coalesce((n.n_convs - 1) * length(n.k[n.d].text), 0) AS own FROM n LEFT JOIN c ON n.d = c.d AND n.k = c.k),
s AS (SELECT a AS d, CASE WHEN a = 0 THEN [] ELSE k[1:a] END AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s ON m.d = s.d AND m.k = s.k LEFT JOIN n u ON u.d = m.d - 1 AND u.k = CASE WHEN m.d <= 1 THEN [] ELSE m.k[1:m.d - 1] END
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.simhash_join(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_crf_quality": op1_crf_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_topk_search": op10_topk_search,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_simhash_join": op13_simhash_join,
}
ORACLE_SQL = {"op5_exact_dedup": OP5_SQL, "op8_warc": OP8_SQL, "op10_topk_search": OP10_SQL, "op11_prefix_trie": OP11_SQL}
