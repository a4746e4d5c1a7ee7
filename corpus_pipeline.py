"""The corpus pipeline: stages in order, each working on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the rows are written and read again, so no stage runs twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import byte_bpe, decontaminate, language_id, line_dedup, ngram_join
from tapeworks.llm.base import prepared, table, text_key
from tapeworks.session import staged

#: Least agreement of ranks for a text to count as one of the learned languages.
LEAST_SCORE = 0.2
#: Near copies: words in a shingle, and least similarity in hundredths. Looser than the query of op 10.
SHINGLE, LEAST = 5, 80


def with_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and texts that agree with no language learned from ``docs``."""
    prepared(spark)
    profiles = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, profiles, carry=docs.columns)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.filter(known).select("carried.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that many documents hold; ``n_chars`` follows the text."""
    prepared(spark)
    cut = line_dedup.dedup_lines(docs, carry=docs.columns)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(
        *[made[c].alias(c) if c not in rest else F.col(f"carried.`{c}`").alias(c) for c in docs.columns]
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by near-equal shingle sets, keep the one with the smallest doc_id.

    Rows that share that id: the one with the smallest hash of the text. Rows equal in id and text are
    one document. Texts without words are no copies of each other.
    """
    prepared(spark)
    groups = staged(ngram_join.jaccard_groups(docs, size=SHINGLE, least=LEAST), "groups")
    first = groups.filter("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "key_")).alias("kept")
    )
    chosen = groups.filter("n_shingles = 0").select("doc_id", "key_").distinct()
    chosen = chosen.unionByName(first.select("kept.doc_id", "kept.key_"))
    chosen = chosen.select(F.col("doc_id").alias("kept_id_"), F.col("key_").alias("kept_key_"))
    key = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id_")) & (key == F.col("kept_key_"))
    kept = docs.join(chosen, same, "left_semi")
    again = groups.groupBy("doc_id", "key_").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad_id_"), F.col("key_").alias("bad_key_"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id_")) & text_key().eqNullSafe(F.col("bad_key_"))
    return docs.join(bad.distinct(), same, "left_anti")


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit), with digests of ids and decoded text."""
    prepared(spark)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("language_id", with_known_language),
    ("line_dedup", without_common_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("byte_bpe", as_tokens),
]

#: SQL has no rank profiles and no byte-pair merging: tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
