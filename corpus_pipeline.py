"""Corpus pipeline: quality, toxicity, near-duplicates, sanitising, packing, over all of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import vocabulary
from folio.llm.common import table, written
from folio.llm.packing import packed
from folio.llm.pii import without_pii
from folio.llm.quality import quality_scores
from folio.llm.simhash import near_duplicates as near_copies_out
from folio.llm.toxicity import toxicity_scores

#: SQL cannot express the learned stages.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: What a scoring pass carries along beside doc_id, so that each row's own verdict decides and no text is joined.
CARRIED = tuple(c for c in COLUMNS if c != "doc_id")


def chosen(scored: DataFrame, verdict: str) -> DataFrame:
    """The rows of documents with this verdict, of what a scoring pass carried along."""
    return scored.where(verdict).select("doc_id", *[F.col(f"carried_{c}").alias(c) for c in CARRIED])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; rows are judged one by one, also where ids repeat or are null."""
    return chosen(quality_scores(docs, table(spark, sf_dir, "labels"), carry=CARRIED), "predicted = 1")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; rows are judged one by one."""
    return chosen(toxicity_scores(docs, table(spark, sf_dir, "labels"), carry=CARRIED), "predicted = 0")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class linked by five-word shingles with Jaccard similarity of 0.8 or more."""
    return near_copies_out(docs).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it generalised."""
    return without_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences."""
    return packed(docs, vocabulary())


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of documents, each written and read again; columns other than COLUMNS are left out from the start.

    Null texts are empty texts to every stage; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
