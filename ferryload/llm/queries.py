"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryload.llm import exactdup, licensescan, mixing, neardup, packing, phrases, quality, secretscan, tokencount, tokenfiles, toxicity, urls, whitening
from ferryload.llm.common import Workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_table(spark, folder, "documents"), how=mixing.Mix(least_keep=0.0, most_miss=0.001))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups(_table(spark, folder, "documents"), size=2, percent=80)


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.secrets(_table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.exact_groups(_table(spark, folder, "documents"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licensescan.licenses(_table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = Workspace(spark, "tokenfiles").path + "/files"
    tokenfiles.write(_table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_toxicity, op4_near_copies, op5_url_filter, op6_secrets, op7_token_counts,
                                   op8_exact_copies, op9_licenses, op10_quality, op11_phrases, op12_token_files, op13_whitening, pipeline)}

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_RULE_CASES = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
_URL_PARTS = r"""
    WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)"""

ORACLE = {
    "op5_url_filter": _URL_PARTS + f"""
        SELECT page_id, host, path,
               CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for _, h, p in _RULE_CASES)} END AS rule,
               CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for v, h, p in _RULE_CASES)}
                    WHEN regexp_matches(host, '(^|[.-])({"|".join(urls.LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
        FROM parts""",
    "op4_near_copies": r"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
        each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id
                  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a, b FROM ends UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
        FROM sets LEFT JOIN least ON doc_id = a""",
    "op8_exact_copies": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY body)""",
    "op11_phrases": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang HAVING sum(len(w)) > 0),
        grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
                  FROM split, (VALUES (1), (2), (3), (4)) AS lengths(k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
        cuts AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        scored AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score FROM cuts c
                   JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
                   JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        held AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
                 FROM (SELECT lang, w, a, k, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT lang, w, a, k, unnest(range(2, k)) AS s FROM cuts WHERE cut = 1)) GROUP BY ALL),
        alone AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN words USING (lang) WHERE rank <= 2000""",
}
