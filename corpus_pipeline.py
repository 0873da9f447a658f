"""The corpus pipeline: each stage is one operator over what the stage before it kept."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import bpe, decontaminate, langid, minhash, pii
from rankspark.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: no text, no letter, or far from every learned language."""
    learned = langid.learn(docs.where(docs["doc_id"].isNotNull() & ~langid.held_out(docs["doc_id"])), "text", "lang")
    return docs.where(~langid.predictor(learned)(spark, docs["text"])["rejected"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8) stays: the least id.

    Rows that repeat the id and text of the one that stays are dropped; rows without words stay. An empty table stays empty,
    null ids count as one id, extra columns pass whatever their names. Texts move once, to the ids that go: the same join at
    every size.
    """
    per_id = minhash.near_duplicates(docs).groupBy(F.col("doc_id").alias("id")).agg(F.count_if("kept").alias("n"))
    per_id = written(per_id.where("n <> 1"), "not-once")
    gone, again = per_id.where("n = 0"), per_id.where("n > 1")
    present = docs["doc_id"].isNotNull()
    rest = docs.where(present).join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["id"], "left_anti")
    if gone.where("id is null").isEmpty():  # null ids would meet in one task of the join
        rest = rest.unionByName(docs.where(~present))
    if again.isEmpty():  # the usual case: texts need not be compared
        return rest
    repeated = docs.join(again, docs["doc_id"].eqNullSafe(again["id"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(again, docs["doc_id"].eqNullSafe(again["id"]), "left_anti").unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go.

    Whole texts are searched. Null and empty texts hold nothing and stay; repeated rows are judged alike; null ids and extra
    columns pass; an empty table stays empty, an empty benchmark lets all stay.
    """
    return docs.where(F.size(decontaminate.matches(spark, table(spark, sf_dir, "benchmark"), docs["text"])) == 0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets; ``n_chars`` follows the new text.

    All rows stay, repeated ones and those with null ids too; null and empty texts stay as they are, with their ``n_chars``
    where the text is null; whole texts are masked; extra columns pass; an empty table stays empty.
    """
    mask = pii.masker(spark, pii.fit(docs))
    masked = docs.withColumn("text", mask(docs["text"]))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded bytes of every document kept.

    One row per row, repeated rows and null ids too; null and empty texts have no tokens; whole texts are encoded; other
    columns are not read; an empty table gives no rows.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("encode", encode)]

#: The tagger of personal data and the language model are trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
