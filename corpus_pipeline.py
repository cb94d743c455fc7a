"""A training corpus from ``documents``: language ID, line dedup, near-dedup, mixing, BPE coding.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir); all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm import bpe, langid, line_dedup, mixing, simhash
from landloom.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its language stays unclear: no letter, or a runner-up this close in loss.
AMBIGUOUS_BELOW = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a clear language; ``lang`` becomes the predicted one."""
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select(COLUMNS), model, AMBIGUOUS_BELOW).where(~F.col("ambiguous"))
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; ``n_chars`` follows the text."""
    return line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that shares five-word shingles to 0.8 or more."""
    return simhash.drop_near_duplicates(docs.select(COLUMNS), words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks for."""
    return mixing.mix_documents(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digest of the text they decode to."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing", mix),
    ("BPE", tokens),
]

#: The first stage is a trained classifier, which SQL does not express; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "pipeline-" + name.lower().replace(" ", "-"))
    return docs
