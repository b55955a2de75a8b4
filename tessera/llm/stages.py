"""The corpus pipeline's stages: (spark, docs, sf_dir) -> DataFrame, each over all rows it is given.

All but the last return the columns of ``docs``, whatever they are and under any names. No stage asks for a doc_id:
rows without one, and different texts under one id, are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import language, toxicity
from tessera.llm.mixing import mix
from tessera.llm.near_dup import near_duplicates
from tessera.llm.packing import pack
from tessera.sources.shared import cut, table

TOXIC_AT = 0.5
NEAR_PERCENT = 80
SURE_LANGUAGE = 0.3


def _new(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_AT`` by models of the labelled rows outside the held-out fold. Null and empty
    texts have no evidence and stay; repeated rows stay or go together; without labels of both classes, or without
    evidence that tells them apart, all have the share of toxic labels as their score."""
    score = _new(docs, "toxicity_score")
    return toxicity.scored(docs, table(spark, sf_dir, "labels"), docs.columns, score).where(F.col(score) < TOXIC_AT).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is one of the learned ones, at ``SURE_LANGUAGE`` at least; every
    document with a letter where no labelled row could be learned from. Null texts and texts without a letter go;
    repeated rows stay or go together; a null lang or doc_id doesn't matter."""
    into = (_new(docs, "language_found"), _new(docs, "language_score"))
    field = language.fit(language.training_sample(docs).toArrow())
    if field is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identified(docs, field, into)
    return found.where((F.col(into[0]) != language.UNDETERMINED) & (F.col(into[1]) >= SURE_LANGUAGE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are linked at ``NEAR_PERCENT`` (five-word shingles): that of the least
    doc_id, null ids last, ties by the text's hash. Rows have a stored key of their own, so different texts of one
    doc_id, and rows without one, all have a group. Null texts and texts without a word link with nothing and stay."""
    key, group = _new(docs, "row_key"), _new(docs, "group_of_row")
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent=NEAR_PERCENT).select(F.col("doc_id").alias(key), F.col("component_id").alias(group))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), key)
    kept = found.join(keyed.select(key, place.alias("place")), key).groupBy(group).agg(F.min("place").alias("place")).select(F.col("place")[key].alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, by a stored key of each row. Sources, null among them, have targets
    by their words; a text without a word is taken by no mix, whatever its id."""
    key, times, copy = (_new(docs, c) for c in ("row_key", "times", "copy"))
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    taken = mix(keyed, keep=[key]).where("copies > 0").select(key, F.col("copies").alias(times))
    return keyed.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; null and empty texts are one piece, repeated rows documents each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
