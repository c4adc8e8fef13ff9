"""One registered query per operator, over its whole table, and the DuckDB twins that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm import bpe, chat, crf, dedup, ego, jaccard, output, packing, phrases, pii, pitman, urls, whiten
from veritab.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if twin is not None:
            ORACLE[name] = twin
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op2_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


@query("op5_packed_matrices")
def packed_matrices(spark: SparkSession, folder: str) -> DataFrame:
    sequences = output.packed_sequences(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), padded=True)
    path = scratch_path(spark)
    output.write_matrices(sequences, path)
    return output.matrix_digests(spark, path)


DEDUP_TWIN = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query("op8_exact_dedup", DEDUP_TWIN)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.deduplicate(table(spark, folder, "documents"), batches=2)


#: The rules of the contract.
URL_RULES = [
    ("org", "/", "allow", True),
    ("example.org", "/es/", "block", True),
    ("example.org", "/en/1", "block", True),
    ("com", "/fr/", "allow", True),
    ("com", "/de/", "block", True),
]
#: Sites that the filter's own list holds; a page of theirs is blocked where no rule decides.
LISTED_SITES = [
    "adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net",
    "free-bets.example.net", "spam-farm.example.org",
]

URL_TWIN = r"""
WITH listed AS (
  SELECT * FROM (VALUES ('org', '/', 'allow', true), ('example.org', '/es/', 'block', true),
    ('example.org', '/en/1', 'block', true), ('com', '/fr/', 'allow', true), ('com', '/de/', 'block', true),
    ('adult-x.example.com', '', 'block', false), ('ads-track.example.com', '', 'block', false),
    ('casino-win.example.net', '', 'block', false), ('cheap-pills.example.net', '', 'block', false),
    ('free-bets.example.net', '', 'block', false), ('spam-farm.example.org', '', 'block', false)
  ) AS v(l_host, l_path, l_verdict, is_rule)
), p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), best AS (
  SELECT r, first(l_host || l_path ORDER BY is_rule DESC, length(l_host || l_path) DESC) AS fits,
    first(is_rule ORDER BY is_rule DESC, length(l_host || l_path) DESC) AS is_rule,
    first(l_verdict ORDER BY is_rule DESC, length(l_host || l_path) DESC) AS verdict
  FROM p JOIN listed ON (host = l_host OR ends_with(host, '.' || l_host)) AND starts_with(path, l_path) GROUP BY r
)
SELECT page_id, host, path, CASE WHEN is_rule THEN fits END AS rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN best USING (r)
"""


@query("op9_url_filter", URL_TWIN)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    sites = [(host, "", "block", False) for host in LISTED_SITES]
    return urls.judge(table(spark, folder, "pages"), urls.listed_frame(spark, URL_RULES + sites))


#: The conversation that the contract adds.
ADDED_TEXT = r"\### Assistant: </turn> ok"


@query("op10_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    added = spark.createDataFrame(
        [(-7, 0, "user", ADDED_TEXT), (-7, 1, "assistant", ADDED_TEXT)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    parts = rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.formatting_digests(chat.format_conversations(parts))


@query("op7_disclosure_pii")
def disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, folder, "documents")))


@query("op3_line_crf_quality")
def line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return crf.classify(documents, crf.fit_on(documents, table(spark, folder, "labels")))


@query("op6_ego_near_dedup")
def ego_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return ego.near_duplicates(table(spark, folder, "embeddings"))


@query("op4_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


@query("op11_feast_whitening")
def feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.components_of(table(spark, folder, "embeddings"))


PHRASES_TWIN = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM piece
), gram AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM ws, (VALUES (1), (2), (3)) AS s(k) WHERE len(ws) >= k)
), f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cut AS (
  SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS first_part,
    array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
  FROM f, (VALUES (1), (2)) AS s(c) WHERE k > 1 AND c < k AND f >= 10
), scored AS (
  SELECT cut.lang, cut.k, cut.phrase, a, c, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first_part AND x.k = c
    JOIN f y ON y.lang = cut.lang AND y.phrase = rest AND y.k = cut.k - c
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
  SELECT lang, part, max(a) AS above FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
    FROM best WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND part = phrase
  WHERE k = 3 OR above IS NULL OR 100 * above < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op12_quotient_phrases", PHRASES_TWIN)
def quotient_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op13_pitman_yor_scores")
def pitman_yor_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scores = pitman.score_texts(documents, ~held_out)
    return scores.select(
        F.col("id").alias("doc_id"), (~F.col("counted")).alias("held_out"), *[F.col(c).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")],
        "base_score", "score",
    )
