"""The registered query of each operator and, where SQL can express it, the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .curve_search import nearest
from .decontamination import contamination
from .language_id import fifth, identify
from .language_model import score_texts, tenth
from .license_scan import license_labels
from .main_text import extract
from .packing import pack_documents
from .simhash import hexadecimal, near_duplicates
from .token_counts import new_cache, token_counts
from .token_records import token_records
from .url_rules import judge, rule
from .vector_codes import compress
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return token_records(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


URL_RULES = [
    rule("org/", "allow"), rule("example.org/es/", "block"), rule("example.org/en/1", "block"), rule("com/fr/", "allow"),
    rule("com/de/", "block"),
]


@query
def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(table(spark, folder, "pages"), table(spark, folder, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return identify(documents, fifth(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op4_curve_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), shingle=3, radius=2)
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_labels(table(spark, folder, "documents"))


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packed.select(
        "doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return token_counts(documents, public_tokenizers.path("piece_bpe_32k.model"), new_cache(spark), limit=4096)


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=13, share=20)
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated"
    )


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress(table(spark, folder, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


@query
def op12_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"), tenth(F.col("doc_id")))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"), components=4, scale=256)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE["op10_decontamination"] = f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, least(len(w), 13) AS k, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
           FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
    dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
           FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
    hits AS (SELECT r, k, i, item_id FROM dw JOIN bw USING (k, words)),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
    found AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
              FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment and floored means, each round two steps of one long statement."""
    steps = [
        """k AS (SELECT row_number() OVER () AS r, vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        "x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM k, (SELECT unnest(range(4)) AS p))",
        """c0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k
              ORDER BY e LIMIT 256) USING (r))""",
    ]
    for k in range(rounds + 1):
        far = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, m % 256 AS e, m // 256 AS far FROM (
              SELECT r, p, min(({far})::BIGINT * 256 + e) AS m FROM x JOIN c{k} USING (p) GROUP BY r, p))""")
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean, c) AS c FROM c{k} LEFT JOIN (
              SELECT p, e, list(floor(s / n) ORDER BY i) AS mean FROM (
              SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k} JOIN x USING (r, p))
              GROUP BY p, e, i) GROUP BY p, e) USING (p, e))""")
    return f"""WITH {", ".join(steps[:-1])},
    codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY r),
    books AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
              FROM (SELECT p, e, unnest(c) AS c, unnest(range(len(c))) AS i FROM c{rounds}))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM codes JOIN k USING (r), books"""


ORACLE["op11_vector_codes"] = _codes_sql()
