"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame that is written
and read again before the next stage; all but the last return the columns of documents.

Defined cases, for every stage: a null or empty text has no words, lines or shingles (the first stage drops it, the
others pass it on, but for the mix, which takes nothing of it); a null doc_id or source is a value like any other;
repeated rows are judged each, are one document to the similarity join and share what the mix takes; ties go to the
smallest doc_id, then hash; a very long text is read whole; an empty table gives no rows; other columns, of any name,
are carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import jaccard_join, line_templates, mixing, packing, quality_rules
from marketlens.llm.tables import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but for the first of each; so do documents that were nothing else."""
    out = line_templates.filter_documents(docs)
    if "n_chars" in docs.columns:  # follows the text
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest doc_id (nulls last), then hash."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null or empty text is taken never."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("source mixing", mix), ("best-fit packing", pack)]

#: Line templates, the similarity join and packing have no SQL form; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
