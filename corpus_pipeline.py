"""A training corpus from `documents`, in five stages, each one of the operators of readloom.llm.

toxicity: documents that score 0.5 or more go. near_dedup: one document of each class of near
duplicates stays, the one with the smallest id. decontaminate: documents that hold a whole
benchmark window anywhere go, however long they are, and so do those with shorter items in at
least a twentieth of their words. mix: documents are repeated or left
out by their rates, so that good and poor tokens meet their target shares. tokens: what
is left goes to a token store, and the result is read back from it.

Nulls, empty and repeated documents are treated as each operator says; an empty table
gives an empty result. No SQL expresses the stages: ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import decontam, minhash, mixing, queries, shared, tokens, toxicity

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = queries.toxicity_index(docs, queries.table(spark, sf_dir, "labels"))
    names = tuple(shared.free_name(docs, n) for n in ("score", "evidence"))
    scored = toxicity.score(docs, index, tuple(docs.columns), evidence=False, names=names)
    return scored.filter(F.col(names[0]) < 0.5).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixture, _ = mixing.fit(docs, queries.quality_labels(spark, sf_dir), mixing.TARGETS)
    return mixing.apply(docs, mixture)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "token-store")
    tokens.write_store(docs, path, queries.tokenizer_file())
    return tokens.verify_store(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written before the next reads it, and what a stage wrote on its way
    goes with its predecessor's result."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with shared.scope(spark) as keep:
            docs = keep(stage(spark, before, sf_dir), name)
        shared.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
