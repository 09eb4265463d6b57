"""Registered queries of the operators, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from casewell.llm import lexical_search as search
from casewell.llm import line_dedup as lines
from casewell.llm import url_filter as urls
from casewell.llm import warc
from casewell.llm.decontaminate import decontaminate
from casewell.llm.importance_sampling import importance_sample
from casewell.llm.language_id import language_id
from casewell.llm.minhash import near_duplicates
from casewell.llm.quality_rules import quality_rules
from casewell.llm.site_bayes import site_quality
from casewell.llm.token_counts import token_counts
from casewell.llm.token_files import token_files
from casewell.llm.word_bpe import bpe_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op5_url_filter": urls.ORACLE, "op9_line_dedup": lines.ORACLE, "op9_maximal_line_dedup": lines.MAXIMAL_ORACLE, "op11_warc": warc.ORACLE, "op12_lexical_search": search.ORACLE}


def _query(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@_query
def op1_quality_rules(table) -> DataFrame:
    return quality_rules(table("documents"), table("labels"))


@_query
def op2_language_id(table) -> DataFrame:
    return language_id(table("documents"))


@_query
def op3_decontaminate(table) -> DataFrame:
    return decontaminate(table("documents"), table("benchmark"))


@_query
def op4_minhash(table) -> DataFrame:
    return near_duplicates(table("documents"), percent=85)


@_query
def op5_url_filter(table) -> DataFrame:
    return urls.url_filter(table("pages"))


@_query
def op6_token_counts(table) -> DataFrame:
    return token_counts(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op7_word_bpe(table) -> DataFrame:
    return bpe_digests(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op8_site_quality(table) -> DataFrame:
    return site_quality(table("documents"), table("labels"))


@_query
def op9_line_dedup(table) -> DataFrame:
    return lines.line_dedup(table("documents"))


@_query
def op9_maximal_line_dedup(table) -> DataFrame:
    return lines.line_dedup(table("documents"), maximal=True)


@_query
def op10_token_files(table) -> DataFrame:
    return token_files(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)


@_query
def op13_importance_sample(table) -> DataFrame:
    return importance_sample(table("documents"), table("benchmark"), percent=5, least_words=20)


@_query
def op12_lexical_search(table) -> DataFrame:
    return search.lexical_search(table("documents"), table("benchmark"), k=50)


@_query
def op11_warc(table) -> DataFrame:
    return warc.warc_records(table("pages"))
