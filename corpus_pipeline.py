"""A corpus pipeline of five stages over ``documents``.

Language identification drops what has no language; near dedup keeps one document of each group
linked by a five-word Jaccard similarity of 0.8; suffix-array dedup cuts passages that a smaller doc_id has too; mixing repeats and samples documents to
the sources' targets; packing puts what is left into bins. Each stage is given
the rows that the one before wrote, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, langid, mixing, packing, suffix
from graphloom.workspace import written

def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many bars as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is ``und``: null, empty or without a letter.

    If no document has a lang, nothing is learned and all are ``und``. Long texts
    are read whole; equal texts stay or go together; repeated rows stay repeated.
    """
    langs, p = langid.train(docs)
    lang, score = (free_name(n, docs.columns) for n in ("lang_pred", "score"))
    scored = langid.identify(docs, langs, p, keep=tuple(docs.columns), names=(lang, score))
    return scored.where(F.col(lang) != "und").select(*_all(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each group of similar ones; of repeated rows one.

    A null doc_id is below any other, and so is a null text among rows of one
    doc_id. Null, empty and blank texts are one group; texts below five words are
    one shingle. Rows with one doc_id but unlike texts are told apart.
    """
    groups = jaccard.grouped_rows(docs)
    stays, text = (free_name(n, docs.columns) for n in ("stays", "stays_text"))
    stay = groups.select(F.col("least.doc_id").alias(stays), F.col("least.text_id").alias(text)).distinct()
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col(stays)) & jaccard.text_id().eqNullSafe(F.col(text)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*_all(docs))


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; documents of which nothing but white space is left go, null and empty ones with them.

    Rows with one doc_id don't cut each other; a null doc_id is below any other;
    texts below 50 bytes stay as they are.
    """
    return suffix.deduplicated(docs).where(F.col("text").rlike(r"\S"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents, so that sources come near their targets.

    Null and blank texts have size 0; a null source is one of its own; ties in
    the seeded order go by doc_id, size and text; repeated rows count each.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents; long ones are cut into full pieces and a rest.

    Null and blank texts have size 0 and a place in a bin; a null source
    conflicts with nothing; repeated rows get copy numbers and never share a bin.
    """
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: A trained model, rolling hashes and a sequential fit are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
