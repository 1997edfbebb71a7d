"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtext.llm import (alignment, decontaminate, discriminant, language, lines, mixing, quality, quotes, repair,
                           sharding, simhash, substrings, tokens)
from claimtext.llm.common import checkpointed, remove_folder, table
from claimtext.session import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def _documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *columns)


@register("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    items = F.sort_array("items")
    return decontaminate.mark(_documents(spark, sf, "text"), table(spark, sf, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    """A cache of its own for each call: every distinct text is a miss and is encoded."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    cache = f"{ensure_checkpoint_dir(spark)}/token_counts-{uuid.uuid4().hex}"
    return tokens.count_tokens(_documents(spark, sf, "text"), definition, cache).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op3_language")
def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "text", "lang").withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@register("op4_mixing")
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf, "source", "text")).drop("text")


@register("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.dedup(_documents(spark, sf, "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf, "text"), shingle=4, max_bits=4)


@register("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup(_documents(spark, sf, "text")).select(
        "doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines",
        F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op8_quotation")
def op8_quotation(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.conversations(table(spark, sf, "conversations")).select(
        "conv_id", "turn", "role", "parent", "thread", "depth", "n_quoted", F.sha2("chat", 256).alias("chat_sha256"))


def _quality_sql() -> str:
    """The measures and the table of rules over documents, stated for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    tests = []
    for measure, per, low, high, only in quality.RULES:
        parts = [f"{measure} >= {low} * {per}"] * (low is not None) + [f"{measure} <= {high} * {per}"] * (high is not None)
        ok = " AND ".join(parts)
        tests.append(f"({ok})" if only is None else f"({ok} OR NOT ({only[0]} >= {only[2]} * {only[1]}))")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]', '', 'g'))::BIGINT AS n_letters,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_ascii_letters,
             len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop
      FROM w LEFT JOIN p USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(tests)} AS kept FROM m"""


@register("op9_quality", _quality_sql())
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(_documents(spark, sf, "text")).drop("text")


@register("op10_sharding")
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "text")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "text", (F.octet_length(text) + 8).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"))
    return sharding.shard(sized).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf: str, a: str | None = None, b: str | None = None) -> DataFrame:
    if a is None or b is None:
        import public_tokenizers
        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        definition, model = f.read(), g.read()
    return alignment.align(_documents(spark, sf, "text"), definition, model).drop("text")


@register("op12_discriminant")
def op12_discriminant(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf, "text").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = checkpointed(discriminant.with_statistics(docs))
    learnt = discriminant.labelled(rows.where(~F.col("held_out")), table(spark, sf, "labels"), "doc_id", "quality")
    return discriminant.score(rows, discriminant.fit(learnt))


@register("op13_repair")
def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repaired(table(spark, sf, "conversations"))


def repaired(conversations: DataFrame) -> DataFrame:
    """The damage and the repair of each conversation; one whose rows are all dropped has zeros and nothing."""
    spark = conversations.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/repair-{uuid.uuid4().hex}"
    report, rows = repair.repair(repair.damage(conversations), folder)
    out = conversations.select("conv_id").distinct()
    for k, part in enumerate((report, repair.digests(rows))):
        other = part.withColumnRenamed("conv_id", f"_{k}")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col(f"_{k}")), "left").drop(f"_{k}")
    out = checkpointed(out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in repair.REPORT],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
    remove_folder(spark, folder)
    return out
