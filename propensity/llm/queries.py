"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.llm import (align, ann, html, jaccard, langid, linededup, mixing, neardup, packing, runs, suffix, tokens,
                            urls)
from propensity.llm.common import table

BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
            public_tokenizers.PATTERN)

PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          tokens.token_count(F.col("text"), PIECES).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.removal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id").drop("uid")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, n_lines="n_lines", n_removed="n_removed", line_words=linededup.LINE_WORDS)


ORACLE["op6_line_dedup"] = linededup.ORACLE


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(packing.pieces(docs, *BYTE_BPE))
    return packed.withColumnRenamed("id", "doc_id")


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"))


ORACLE["op8_mixing"] = mixing.ORACLE


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "kept")


#: The rules of op11: host (and its subdomains), start of the path, verdict.
URL_RULES = (("org", "/", urls.ALLOW), ("example.org", "/es/", urls.BLOCK), ("example.org", "/en/1", urls.BLOCK),
             ("com", "/fr/", urls.ALLOW), ("com", "/de/", urls.BLOCK))


@query
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.longest_first([urls.host_rule(*r) for r in URL_RULES])
    others = [urls.Rule(g, urls.BLOCK, (g,)) for g in urls.UNWANTED]
    pages = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules + others, name="judged")
    return pages.select("page_id", "judged.host", "judged.path",
                        F.when(F.col("judged.number") < len(rules), F.col("judged.rule")).alias("rule"), "judged.verdict")


def _sql_pattern(glob: str) -> str:
    return re.escape(glob).replace(r"\*\*", "(?s:.*)").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")


ORACLE["op11_url_filters"] = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
r AS (
  SELECT page_id, CASE WHEN mark = 0 THEN '' ELSE substr(url, mark + 3) END AS rest FROM u),
p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^?#]*') AS whole FROM r),
c AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(whole, length(h) + 1) AS path FROM p),
rules(rule_host, rule_path, verdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM c JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_full_match(host || path,
  '{'|'.join(_sql_pattern(g) for g in urls.UNWANTED)}') THEN '{urls.BLOCK}' ELSE '{urls.ALLOW}' END) AS verdict
FROM c LEFT JOIN best ON best.page_id = c.page_id
"""


def with_periodic_tail(text: Column, doc_id: Column) -> Column:
    """Texts of one document in ten, whose words repeat from some word on: with ``h`` the crc32 of
    the id, ``g = floor(h / 10)`` and ``n`` words, word ``i >= a`` becomes word ``a + (i - a) % p``,
    where ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``.  Others stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:  # a lambda's argument: the words are cut out once
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.filter(F.array(F.regexp_extract_all(text, F.lit(runs.WORD), F.lit(0))), lambda w: F.size(w) > 0)
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(words, rewritten), 0), text)).otherwise(text)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", with_periodic_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs, name="found").select("doc_id", "found.runs", "found.collapsed")
    main = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    found = found.withColumn("main", main)
    length, period = F.col("main.length"), -F.col("main.col3")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("main.col2")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(table(spark, sf_dir, "documents"), *BYTE_BPE, PIECES, digest=True)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})
