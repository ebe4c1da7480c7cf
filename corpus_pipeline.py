"""A corpus pipeline of the training-data operators. Each stage takes what the one before it kept.

A stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents. Models are learned from the
stage's own input, by the rules of the operators' queries (held-out documents stay held out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm import langid, packing, quality, simhash, suffixes
from clusterlake.llm.common import released, table, without, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts with no letter. Each row is judged by its text alone, repeated rows and rows without an id too; an empty table stays empty."""
    return langid.with_language(docs)


def quality_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is below the threshold of the query. Each row is judged by its text alone, as in language()."""
    return quality.good_rows(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component. Where ids repeat or are null, each row counts as a document, rows without an id last, so that one of repeated rows stays."""
    ids = docs.groupBy("doc_id").count()
    if ids.where("count > 1 OR doc_id IS NULL").isEmpty():
        return without(docs, "doc_id", rejected(docs))
    # A key of each row, in the order of ids.
    row = F.struct(*docs.columns).alias("row")
    ordered = docs.select(row).orderBy(F.col("row.doc_id").asc_nulls_last(), F.xxhash64("row.text"))
    keyed = written(ordered.withColumn("doc_id", F.monotonically_increasing_id()), "keyed")
    return without(keyed, "doc_id", rejected(keyed.select("doc_id", F.col("row.text").alias("text")))).select("row.*")


def rejected(docs: DataFrame) -> DataFrame:
    """(doc_id) of all but the least of each component."""
    return written(simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id"), "rejected")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; what a cut leaves of a character goes with it. Every row stays."""

    def each(row: dict, kept: bytes, n: int, gone: int, spans: int) -> dict:
        row["text"] = None if row["text"] is None else kept.decode("utf-8", "ignore")
        if gone:
            row["n_chars"] = len(row["text"])
        return row

    # The text travels once, as the bytes to cut; of the column itself only whether it is null.
    keep = [F.when(F.col(c).isNotNull(), "").alias(c) if c == "text" else c for c in docs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return suffixes.deduplicated(docs, F.col("text"), keep, each, schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every text into sequences, as op1 does; a null text is an empty one, repeated rows are packed each, and an empty table gives an empty result."""
    import public_tokenizers as tokenizers

    return packing.pack_documents(docs, tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality_), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packed)]

#: SQL can't express the learned stages; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared folder and removed when the next one is."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            released(before)
    return docs
