"""The training-data pipeline: quality rules, line dedup, near-dedup, decontamination, BPE, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import bpe, decontam, lines, nearcopies, quality
from rangeloom.llm.common import Shelf, free_names, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality rules keep; a null or repeated doc_id goes by its row's text like any other."""
    return quality.keep_rows(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows the new text.

    Rows with one id are one document; repeated rows stay repeated; a null text is one empty line.
    """
    out = lines.drop_repeated_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest doc_id, where it is repeated the smallest hash of its text; a null one last.

    Rows equal in both are one row, the least in its columns' order. Texts without words are one group. An empty table gives an empty table.
    """
    # A row is named by doc_id and text, as plain columns, so that rows with null or repeated ids stay apart.
    null, ident, text, row = free_names(docs, "null_id", "some_id", "text_hash", "whole_row")
    keys = {null: F.col("doc_id").isNull(), ident: F.coalesce("doc_id", F.lit(0)), text: F.xxhash64(F.coalesce("text", F.lit("")))}
    named = docs.withColumns(keys)
    groups = nearcopies.near_copies(named.select(F.struct(*keys).alias("doc_id"), "text"))
    chosen = groups.select(F.col("component_id").alias("chosen")).select(*[F.col(f"chosen.{k}") for k in keys]).distinct()
    # Copies with one name are combined before the shuffle, which the join shares.
    once = named.groupBy(*keys).agg(F.min(F.struct(*docs.columns)).alias(row))
    return once.join(chosen, list(keys), "left_semi").select(f"{row}.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark passage, each by its own text; null texts hold none, repeated rows go or stay together."""
    return decontam.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of what is left; a null text has no ids."""
    return bpe.encode_texts(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", one_of_each_group), ("decontamination", drop_contaminated), ("bpe", encode)]

#: Fingerprints, spaced seeds and BPE have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents, each stage's rows written to the shared folder and read again by the next."""
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        new = shelf.keep(out)
        shelf.drop(docs)
        docs = new
