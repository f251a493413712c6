"""A training corpus from the table documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared folder and
reads it back for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import byte_bpe, decontamination, quality_classifier, shared, simhash, substring_dedup


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1 and so on, and what each was called: no column that an operator adds can clash."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject.

    A null text counts as empty, and an empty one has the score of the bias. Rows of equal text have equal scores, so
    they all stay or all go; a null id is no hindrance. Of an empty table nothing is left; without labels all
    scores are 0.5, and all documents stay.
    """
    weights = quality_classifier.train(docs, shared.table(spark, sf_dir, "labels"))
    plain, names = _numbered(docs)
    scored = quality_classifier.classify(plain, weights, plain.columns, text_col=names["text"])
    return scored.where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Null and empty texts are near copies of one another. Rows that share the smallest id of their group all stay. A
    row of null id stays only if its whole group has null ids. An empty table stays empty.
    """
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document of smaller id has. n_chars follows.

    No row goes. Null and short texts, rows of null id and rows that only share passages with rows of their own id stay as
    they are; a text that is wholly repeated becomes empty.
    """
    plain, names = _numbered(docs)
    text, length = names["text"], names["n_chars"]
    found = substring_dedup.substring_dedup(plain, names["doc_id"], text)
    cut = F.col("n_removed") > 0
    changed = {text: F.when(cut, F.col("kept_text")).otherwise(F.col(text)), length: F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(length))}
    return found.withColumns(changed).select(*plain.columns).toDF(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark.

    Null and empty texts contain none, nor does anything contain an item without a word. Rows that share the id of a
    document with an item all go. Without items all documents stay.
    """
    return decontamination.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text, their number, and the digest of the bytes that they decode to.

    A row for each row, repeated or of null id; a null text counts as empty and has no ids.
    """
    coded = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", leaks),
    ("byte-level BPE", tokens),
]

#: The classifier, the components and the removal of passages have no SQL form; the tests hold the rows of run() against a
#: brute-force version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives. Each stage's table goes when the next one's is written; the last one's stays."""
    docs = shared.table(spark, sf_dir, "documents")
    root = f"{shared.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            shared.remove(spark, f"{root}/{k - 1}")
    return docs
