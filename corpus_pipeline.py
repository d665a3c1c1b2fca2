"""A corpus pipeline over ``documents``: each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``;
``lang`` is then the identified language and ``n_chars`` fits the changed text. Empty
tables pass through; rows with a null id are kept by all filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchtally.llm import language, linedup, mixing, neardup, pieces
from touchtally.llm.common import WORD, last_table_only, read_documents, word_count, written
from touchtally.sources.checkpoints import broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Below this the best language is hardly likelier than the others.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those of no likely language, go."""
    found = language.identify(docs.select(*COLUMNS), language.learn(docs))
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays. A document that loses its last words is a copy of others, and its row goes."""
    kept = linedup.dedup_lines(docs.select(*COLUMNS))
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return kept.filter((F.col("n_removed") == 0) | words).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest id stays, and one row of it."""
    with last_table_only(spark):
        found = written(neardup.near_duplicates(docs), "pipeline-neardup")
    gone = written(found.filter(~F.col("kept")).select("doc_id").distinct(), "pipeline-gone")
    again = written(found.filter("kept").groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "pipeline-again")
    kept = docs.select(*COLUMNS).join(broadcast_if_small(gone, linedup.MAX_BROADCAST_NAMES), "doc_id", "left_anti")
    if again.isEmpty():
        return kept
    repeated = broadcast_if_small(again, linedup.MAX_BROADCAST_NAMES)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").union(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    sized = docs.select(*COLUMNS, word_count().alias("size"))
    plan = mixing.mix_plan(written(sized.select("doc_id", "source", "size"), "pipeline-sizes"))
    mixed = mixing.apply_mix(sized, plan).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, n_byte_tokens, decoded_sha256 and round_trip."""
    return pieces.tokenize(docs.select("doc_id", "lang", "source", "text"), pieces.load_pieces())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
