"""A training-corpus pipeline over `documents`: language, toxicity, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet before the next
one reads it. All but the last return the columns of `documents`. SQL can't express the trained stages, so there is no
ORACLE_SQL; tests/llm/test_corpus_pipeline.py holds run() and the stages' decisions against brute force, on texts
that the trained stages tell apart for certain.

Repeated rows and rows with null ids are documents of their own. Null and empty texts, and texts without letters, have no
language and go in the first stage. Empty tables give empty results. Columns named like an operator's results keep their
values, but for the last stage's own: ids, n_tokens, decoded. Without labels no text is toxic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, near_dedup, sentencepiece_fst, toxicity
from tessera.llm.common import drop_path, read_table, write_table

ORACLE_SQL = None
#: A text is rejected if no language is found, or if fewer of its n-grams than this are known to any. Chosen between
#: held-out texts of learned languages and texts of left-out ones (figures in the README).
LEAST_EVIDENCE = 0.4
#: Near-duplicates share 80 % of their 5-word shingles.
SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a known language. The filters are learned from the rows at hand; a row's own language label doesn't
    decide on it."""
    own, back = aside(docs, "lang_pred", "score", "evidence")
    got = language_id.identify(spark, own, language_id.learn(docs))
    return got.where((F.col("lang_pred") != "und") & (F.col("evidence") >= LEAST_EVIDENCE)).select(*back)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic texts."""
    own, back = aside(docs, "score")
    got = toxicity.score(spark, own, toxicity.learn(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels")))
    return got.where("score < 0.5").select(*back)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep exactly one row of each group of near-duplicates, whatever its id: one with the smallest id, or with a null
    id where the group has no other. Rows without words are no duplicates."""
    row = unused("row", docs)
    # written, so that each row has one number in all that follows
    rows, _ = write_table(spark, docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    labels = near_dedup.labelled(spark, rows.select(F.col(row).alias("doc_id"), "text"), SIMILAR)
    groups, groups_path = write_table(spark, labels.select(F.col("doc_id").alias(row), F.col("component_id").alias("group")), "groups")
    best = groups.join(rows.select(row, "doc_id"), row).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    other = best.where(F.col(row) != F.col("group"))  # stays in place of the row that names the group
    rest = groups.where(F.col(row) != F.col("group")).select(row).join(other.select(row), row, "left_anti")
    gone, _ = write_table(spark, rest.union(other.select("group")), "gone")
    drop_path(spark, groups_path)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def unused(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names renamed, out of the way of an operator's results, and the columns as they were."""
    new = {c: unused(f"own_{c}", docs) for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(new), [F.col(new.get(c, c)).alias(c) for c in docs.columns]


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; one of fewer than five words as a run of words anywhere."""
    return decontamination.decontaminate(spark, docs, read_table(spark, sf_dir, "benchmark"), runs=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text that they decode to."""
    return sentencepiece_fst.encode(docs)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("benchmark", uncontaminated), ("tokens", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_table(spark, stage(spark, docs, sf_dir), name)
        if before:  # what the stage has read
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
