"""The registered queries opN_<name>: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from llm.audit import failures, interactions
from llm.bpe import digests, encode_documents, read_ranks
from llm.cascade import judge
from llm.edits import contamination
from llm.exact import exact_dedup
from llm.language import identify, remainder
from llm.lines import drop_repeated_lines
from llm.markup import main_text
from llm.orders import similar_sets
from llm.parsing import drop_earlier_passages
from llm.periods import collapse_runs, planted_order, run_digests
from llm.simhash import simhash_components
from llm.suffixes import drop_repeated_bytes

RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranks = read_ranks(spark, public_tokenizers.path(RANKS))
    return digests(encode_documents(docs, ranks, public_tokenizers.PATTERN))


@query()
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query(f"""
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, {NORM} AS norm FROM documents)
WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op5_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_earlier_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query(f"""
WITH rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
urls AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
),
best AS (
  SELECT n, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS place
  FROM urls JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (n)
""")
def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, URL_RULES).drop("url")


@query()
def op9_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select("doc_id", "contaminated", "n_items", "item_ids", "distances")


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op11_dyadic_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return run_digests(collapse_runs(docs, order=planted_order))


@query(r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
failed AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN rank() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) > 1 THEN 16 ELSE 0 END AS mask
  FROM docs
),
said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, mask
),
f(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.c <> a.c JOIN f c ON c.c NOT IN (a.c, b.c) JOIN f d ON d.c NOT IN (a.c, b.c, c.c)
  JOIN f e ON e.c NOT IN (a.c, b.c, c.c, d.c)
),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, list_sum(bits[:s]) - bits[s] AS earlier
  FROM orders, range(1, 6) AS r(s)
),
found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, (SELECT filter_order, step, bit::BIGINT AS bit, earlier::BIGINT AS earlier FROM steps) s
  GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(failures(docs), labels)


@query()
def op13_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
