"""The queries of this folder: operator number and name to (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purseflow.llm import align, bpe, decontam, html_blocks, langid, licenses, linededup, phrases, quality, simhash, tokenfile, topk, urlfilter
from purseflow.llm.common import fold, table
from purseflow.storage import materialize

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "n_equal")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (fold("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out")
    score = F.col("quality_score")
    return quality.score(docs, model).select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(topk.quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP5_SQL = """
WITH clean AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (fold("doc_id", langid.FOLDS) == langid.HELD_OUT).alias("held_out")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), whole=True).select("doc_id", "text", "n_lines", "n_removed")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-]')) AS piece FROM texts)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), grams AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m))
  ) GROUP BY lang, m, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT lang, m, phrase, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM grams WHERE m > 1)
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score, c.k
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.first JOIN grams r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM grams g WHERE g.lang = s.lang AND g.m > s.m AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.f >= 100 * s.a)
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
) WHERE rank <= 2000
"""

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
  SELECT row_number() OVER () AS u, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY u ORDER BY length(h || p) DESC) = 1
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_main_text": op4_main_text,
    "op5_top_k": op5_top_k,
    "op6_language": op6_language,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_file": op8_token_file,
    "op9_bpe": op9_bpe,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_collocations": op12_collocations,
    "op13_url_filter": op13_url_filter,
}
ORACLE_SQL: dict[str, str] = {"op5_top_k": OP5_SQL, "op12_collocations": OP12_SQL, "op13_url_filter": OP13_SQL}
