"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before it kept; what it returns is written as Parquet and read
again, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskmix.llm.common import free_name, table
from maskmix.llm.decontaminate import find_passages
from maskmix.llm.language import identify_documents
from maskmix.llm.packing import pack_documents
from maskmix.llm.secrets import find_secrets, redact
from maskmix.llm.similar import keep_first_similar
from maskmix.workspace import Workspace

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one that the corpus declares go on; the others go."""
    found = identify_documents(docs)
    return found.where(F.col(found.columns[-1])["accepted"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints at four or fewer differing bits, or by a Jaccard similarity of 0.8
    or more over five words, the one with the smallest id stays."""
    return keep_first_similar(docs, fingerprints=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words lie in benchmark windows go."""
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col(found.columns[-1])["contaminated"]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are blotted out and the length follows; copied examples and all documents stay."""
    found = find_secrets(docs)
    spans, clean = F.col(found.columns[-1]), free_name(found, "clean")
    changed = F.exists(spans, lambda s: s["live"])
    found = found.withColumn(clean, redact(F.col("text"), spans))  # a column of its own before "text" is named anew
    length = F.when(changed, F.length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    new = {"text": F.col(clean).alias("text"), "n_chars": length}
    return found.select(*[new.get(c, F.col(c)) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Fingerprints, language models and tokenizers are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = workspace.save(stage(spark, docs, sf_dir), name)
    return docs
