"""The corpus pipeline: documents in, tokenized clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the
shared folder and reads it back as the next stage's docs. All stages but the last return
the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, minhash, pii, quality
from kinweave.llm.common import configure, fresh, read
from kinweave.session import Scratch

#: Percent of the union of two documents' five-word shingles that near-duplicates share at least.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules or their host's verdict reject.

    Null and empty texts have too few words and go; rows without a source share one verdict; repeated rows stay or go
    alike; an empty table stays empty; long texts are measured whole; columns beyond those of documents pass through."""
    configure(spark)
    judged = quality.judge(docs)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one of the smallest id. Documents are linked at a similarity of
    SIMILAR percent or more. Rows are numbered in order of their ids, so repeats of one id and rows without an id are grouped like others.

    Rows whose text is null or has no words are linked with nothing and stay; of exact copies the first row stays; an
    empty table stays empty; long texts are compared whole; columns beyond those of documents pass through."""
    configure(spark)
    row = fresh(docs.columns, "row")[0]
    # Rows of one id, or without an id, may be many: they are dealt out by their texts' hashes too.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    sorted_docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = Scratch(spark).save(sorted_docs.withColumn(row, F.monotonically_increasing_id()))
    grouped = minhash.near_duplicates(numbered, row, threshold=SIMILAR)
    return grouped.where(F.col(grouped.columns[-1])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that benchmark items contaminate.

    Null and empty texts have no words and stay; repeated rows stay or go alike; an empty table, of documents or of
    items, drops nothing; long texts are searched whole; columns beyond those of documents pass through."""
    judged = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return judged.where(~F.col(judged.columns[-1])).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by placeholders; n_chars follows.

    A null text stays null, as does its n_chars; empty texts and repeated rows pass through one to one; an empty table
    stays empty; long texts are searched whole; columns beyond those of documents pass through."""
    configure(spark)
    found = pii.detect(docs, redacted=True)
    text = F.col(found.columns[-1])
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row a document.

    Null and empty texts have no tokens; repeated rows stay repeated; an empty table stays empty; long texts are encoded
    whole; only doc_id is kept of the columns."""
    configure(spark)
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("bpe", encode),
]

#: The near-duplicate and personal-data stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, others = read(spark, sf_dir, "documents"), Scratch(spark), {*Scratch.live}
    before = None
    for _, stage in STAGES:
        made = scratch.save(stage(spark, docs, sf_dir))
        # What a finished stage has read and left isn't needed any more.
        Scratch.sweep({scratch.base, *others})
        if before is not None:
            scratch.drop(before)
        docs = before = made
    return docs
