"""A training-corpus pipeline: five stages, each an operator of tessera.llm applied to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, mixing, near_dedup, pieces
from tessera.llm.common import discard, scratch, shared_dir, stash, table

#: A document is rejected if its language is undetermined or holds less than this share of its letters.
MIN_LANGUAGE_SHARE = 0.4
#: The mix is as large as its input, in tokens.
MIX_BUDGET = 1.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined and holds MIN_LANGUAGE_SHARE of their letters, by a model of the table's own
    labelled rows. Null, empty and letterless texts go; rows that repeat stay or go together; an empty table stays empty."""
    marked = language_id.identify(docs, language_id.learn(docs))
    kept = marked.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the one of smallest doc_id; one without an id if none has one."""
    return exact_dedup.keep_distinct(docs, null_ids=True).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of smallest doc_id; one without an id if none has one."""
    return near_dedup.keep_one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights holds them. A null source or language counts as empty text; a
    document without tokens costs nothing and stays where its leaf has a budget."""
    marked = docs.withColumn("_mix_family", mixing.source_family(F.col("source")))
    return mixing.mix(marked, levels=("_mix_family", "lang", "source"), budget=MIX_BUDGET).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces and whether these decode to the text again; null texts have no pieces."""
    return pieces.encoded_with_check(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Models and sketches have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own intermediate files go when its result is written, that result when the
    next one is; what the last stage reads stays."""
    docs, written = table(spark, sf_dir, "documents"), None
    folder = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stash(stage(spark, docs, sf_dir), name, keep=folder)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
