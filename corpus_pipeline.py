"""The corpus pipeline: language, repeated lines, near copies, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last keep the columns of `docs`. A column
`n_chars`, where there is one, follows a changed text.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.llm.decontaminate import with_matches
from casewell.llm.language_id import accepted, held_out, identify
from casewell.llm.line_dedup import drop_repeated_lines, stays
from casewell.llm.minhash import near_duplicates
from casewell.llm.word_bpe import bpe_digests
from casewell.operators.keys import one_per_key
from casewell.session import staging_root

# A fit of numbers and counts: SQL can't express the classifier, MinHash or BPE.
ORACLE_SQL = None


# Columns that stages read or write; any others are only carried along.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _plain_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run a stage with other columns under names that nothing in it has."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in KNOWN else f"carried_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.toDF(*docs.columns) if out.columns == names else out

    return run


def _without_order(kind: T.DataType) -> bool:
    """Whether values of a type can't be compared, as maps can't."""
    if isinstance(kind, T.StructType):
        return any(_without_order(f.dataType) for f in kind.fields)
    return _without_order(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def _one_each(df: DataFrame) -> DataFrame:
    """The least row of each id and text; by its JSON text where a column has no order."""
    if not any(_without_order(f.dataType) for f in df.schema.fields):
        return one_per_key(df, ["doc_id", "text"])
    rest = F.struct(*[c for c in df.columns if c not in ("doc_id", "text")])
    least = df.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("carried"))
    return least.select("doc_id", "text", "carried.*").select(*df.columns)


@_plain_names
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or whose language is a mere guess."""
    train = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return identify(docs, train).filter(accepted()).select(*docs.columns)


@_plain_names
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines, to their last lines, leave the texts; emptied
    documents go."""
    done = drop_repeated_lines(docs, maximal=True).filter(stays("text"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("_runs").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        done = done.withColumn("n_chars", length)
    return done.select(*docs.columns)


@_plain_names
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id, with all its texts; of rows
    that share an id and a text the least one stays. Pairs from a similarity of 0.8 on are linked."""
    found = near_duplicates(docs, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    single = left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(_one_each(left.join(repeated, "doc_id", "left_semi").select(*docs.columns)))


@_plain_names
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go, each row by its own text."""
    found = with_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns, name="_matches")
    return found.filter(F.size("_matches") == 0).select(*docs.columns)


@_plain_names
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and the digests of the ids and of the decoded text of every document; a null
    or empty text has none, repeated rows stay repeated, and other columns are left out."""
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again."""
    folder = f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
