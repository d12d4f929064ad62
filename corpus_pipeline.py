"""A corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, sources are mixed, texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, scratch, table
from quantloom.llm.line_dedup import dedup_lines
from quantloom.llm.mixing import mix
from quantloom.llm.near_copies import keep_one
from quantloom.llm.piece_codec import encode_pieces
from quantloom.llm.toxicity import REJECT, score, train

#: Words from which a repeated run of fewer than three lines goes too.
LONG_WORDS = 50
#: Near copies share this part of their shingles of so many words.
NEAR_LEAST = 0.8
NEAR_WORDS = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are more likely toxic than not. All others stay, null and empty texts, null ids and repeated rows
    among them; columns keep their names, but those named like the scores with the prefix __stage_, which are replaced."""
    with scratch(spark):  # the sample goes when the model is trained
        model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, prefix="__stage_")
    return scored.filter(F.col("__stage_p_toxic") < REJECT).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the later copies of runs of three lines and more, and of one and two lines that hold fifty words, and without
    documents of which nothing is left. Null and empty texts stay; of repeated rows the first keeps its lines. n_chars, where
    there is such a column, is counted anew; a column line_dedup_removed goes."""
    out = dedup_lines(docs, drop_emptied=True, long_words=LONG_WORDS).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id, null ids last. All texts without words are one group; columns
    keep their names and values."""
    return keep_one(docs, words=NEAR_WORDS, least=NEAR_LEAST)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: repeated rows count one by one, null sources are a source, texts without words
    of a source are taken at its rate. Columns keep their names, but mix_copies and its like, which go."""
    mixed = mix(docs).filter("mix_copies > 0")
    return mixed.withColumn("__stage_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies").cast("long")))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with piece_ids and piece_parity, which replace columns by these names; null texts have no pieces."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Trained scores and fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on the table that the one before has written. What a stage writes on the way goes when it is done, and the
    stages' own tables when the last but one is written, which the result reads."""
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            with scratch(spark) as keep_stage:
                docs = keep_stage(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
