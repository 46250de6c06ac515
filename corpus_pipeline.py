"""A training-corpus pipeline of five stages over ``documents``.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one reads
it. All but the last return the columns of documents; other columns are dropped at the first. Empty tables give
empty results.

| Stage | Null or empty text, text without letters | Null lang | Null source | Null or repeated doc_id | Repeated rows |
|-|-|-|-|-|-|
| language_id | goes | becomes the predicted language | stays | not asked for | judged alike |
| line_dedup | null becomes empty; what was empty before stays | stays | stays | null comes first in the order, rows of one id are ordered by a hash of their texts | one document: both keep their lines |
| near_dedup | all such texts are one group | stays | stays | rows are told apart by their texts; a null id is the last choice of a group | one stays |
| mix_to_weights | size 0, taken as often as its source | stays | a source of its own | rows of one id and size stay or go together | each is taken as often |
| sentencepiece | no ids | stays | stays | not asked for | encoded alike |
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.common import clear_stored, kept_folders, scratch_dir
from tallybook.llm.language_id import fit, predict_languages
from tallybook.llm.line_dedup import dedup_lines
from tallybook.llm.mixing import mixed_documents
from tallybook.llm.near_dedup import one_of_each, one_of_each_class
from tallybook.llm.pieces import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle of the fingerprints, as in op9.
LINK_WORDS = 3
#: Words that a worker of the last stage remembers; its executor also holds what the stages before left.
REMEMBERED = 250_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (``und`` goes); a missing lang becomes the predicted one."""
    model = fit(docs)
    judged = predict_languages(docs.select(COLUMNS), model, keep=tuple(COLUMNS))
    if not model.languages:  # nothing to learn from, nothing to reject
        return docs.select(COLUMNS)
    return judged.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line chunks; documents that consisted of nothing else go."""
    cleaned = dedup_lines(docs.select(COLUMNS))
    left = (F.col("n_chunks_removed") == 0) | (F.length(F.trim("text")) > 0)
    return cleaned.where(left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash fingerprints, found by the segment-popcount embedding; of those that are left, an exact join on shingles then takes what fingerprints miss (a Jaccard likeness of 0.8 on five words)."""
    return one_of_each(one_of_each_class(docs.select(COLUMNS), LINK_WORDS)).select(COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_pieces."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"), remembered=REMEMBERED)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_to_weights", mix_to_weights),
    ("sentencepiece", sentencepiece),
]

#: The stages compare shingles, walk automata and apply fitted models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path, before = f"{folder}/{i}-{name}", len(kept_folders)
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_stored(spark, before)  # the stage is written, so nothing reads its intermediate tables any more
        docs = spark.read.parquet(path)
    return docs
