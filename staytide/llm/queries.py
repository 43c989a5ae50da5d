"""The operators as registered queries over whole tables, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staytide.llm import (filter_audit, hyperminhash, licenses, line_quality, mixing, packing, periodic_runs, rule_quality, simhash, topk, toxicity,
                          trie_tokens, url_filter)
from staytide.llm.text import words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the public vocabularies are installed, on the driver and on every worker."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op2_quality_rules_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality.rule_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@_query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("root", "digest")


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents")).drop("source", "digest", "hot_lines")


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of one document in ten, by the CRC of its id, the words from a drawn place on repeat
    with a drawn period (the registered query's rule). A null id counts as empty text."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", crc.alias("h"), F.floor(crc / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    changed = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's runs and collapsed text as counts, the run of the greatest exponent and digests."""
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    # a / p > b / q is a * q > b * p; of equal exponents the run that comes first stays.
    first = F.get("runs", F.lit(0))
    top = F.aggregate("runs", first, lambda t, r: F.when(r["length"] * t["period"] > t["length"] * r["period"], r).otherwise(t))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return (found.withColumn("top", top)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
                    F.col("top.period").alias("period"), F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
                    digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256")))


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op13_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


SQL["op6_url_filters"] = url_filter.SQL
SQL["op8_exact_topk"] = topk.SQL
SQL["op10_quality_rules"] = line_quality.SQL
SQL["op12_filter_audit"] = filter_audit.SQL
