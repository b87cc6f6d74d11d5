"""A corpus from raw documents to token ids: five stages, each written before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
All but the last return the columns of documents. Nulls, empty texts, ties and empty tables
are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm.catalog import held_out, vocabulary
from hostlens.llm.common import table
from hostlens.llm.deobfuscation import fit_toxicity, score_toxicity
from hostlens.llm.mixing import mix_documents
from hostlens.llm.partenum import one_of_each
from hostlens.llm.piece_codec import encode_documents
from hostlens.llm.template_lines import drop_recurring_lines
from hostlens.session import cut

TOXIC_FROM = 0.5
# with no budget of its own, a mix keeps every document at least once
MIX = {"target_entropy": 0.97, "repetition_limit": 1.5, "seed": 17}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It never learns from held-out labels."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), out_col="_toxicity")
    return scored.filter(F.col("_toxicity") < TOXIC_FROM).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are taken out of the texts; no row goes."""
    return _lengths(drop_recurring_lines(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every time the mix places it."""
    return mix_documents(docs, **MIX)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, n_tokens): token ids of whole texts."""
    coded = encode_documents(docs.select("doc_id", "source", "lang", "text"), vocabulary())
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").alias("n_tokens"))


def _lengths(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

# the first and last stage have no SQL form; tests compare the run with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
