"""One query per operator on the given tables, with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from voltloom.llm import bpe, counts, lines, lm, mixing, near, periods, quality, tokenfiles, toxicity, vafile, variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


@query("op6_quality_rules")
def op6(spark, sf_dir):
    return quality.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_line_dedup", lines.ORACLE)
def op7(spark, sf_dir):
    return lines.digests(table(spark, sf_dir, "documents"))


@query("op9_source_mix")
def op9(spark, sf_dir):
    return mixing.digests(table(spark, sf_dir, "documents"))


@query("op10_minhash_near_dedup", near.ORACLE)
def op10(spark, sf_dir):
    return near.digests(table(spark, sf_dir, "documents"))


@query("op1_vector_approximation", vafile.ORACLE)
def op1(spark, sf_dir):
    return vafile.top10(table(spark, sf_dir, "embeddings"))


@query("op5_warc", warc.ORACLE)
def op5(spark, sf_dir):
    return warc.digests(table(spark, sf_dir, "pages"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op2_token_files")
def op2(spark, sf_dir):
    return tokenfiles.digests(table(spark, sf_dir, "documents"))


@query("op3_elias_fano_lm")
def op3(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query("op8_viterbi_counts")
def op8(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), white=True)


@query("op11_period_tiles")
def op11(spark, sf_dir):
    return periods.digests(table(spark, sf_dir, "documents"))


@query("op12_reduced_alphabet", variants.ORACLE)
def op12(spark, sf_dir):
    return variants.digests(table(spark, sf_dir, "documents"))


@query("op13_conv_toxicity")
def op13(spark, sf_dir):
    return toxicity.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
