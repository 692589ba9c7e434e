"""A corpus pipeline of five stages; each is written and read again before the next.

toxicity: documents predicted to be toxic go. line dedup: frequent lines go. MinHash near-dedup: one
document of each group stays, that with the smallest doc_id. benchmark decontamination: contaminated
documents go. best-fit packing: what is left is packed into sequences of 2048 tokens.

Defined cases are those of the operators; a table that becomes empty flows through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinnabar.llm.decontam import decontaminate
from cinnabar.llm.linededup import line_dedup
from cinnabar.llm.minhash import drop_near_duplicates
from cinnabar.llm.packing import pack
from cinnabar.llm.queries import word_tokenizer
from cinnabar.llm.store import Store, table
from cinnabar.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_tokenizer())


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: The votes of nearest examples (toxicity) and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), str(i))
        if i:
            store.drop(str(i - 1))
    return docs
