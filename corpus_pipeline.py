"""The corpus pipeline: language ID, near-dedup, secret redaction, mixing, tokenisation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last return the columns of ``documents``; further columns of ``docs``
are left out. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import langid, mixing, neardup, pieces, secrets
from quillmesh.llm._common import discard, mark, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Percent of shared 5-word shingles from which the stage takes two documents as near copies (op9 alone is held to 85).
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that some learned language fits.

    Null and empty texts and texts without letters fit none and go. Rows are judged one by one by their text alone, so
    repeated rows and null or repeated doc_ids stay as they are; a tie of languages doesn't matter. Without
    a labelled row to learn from, every document goes.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs.select(*COLUMNS), model).filter(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the least doc_id, of each near-duplicate component.

    Rows whose doc_id is null or stands at several texts count after all others, by a hash; of rows with equal doc_id
    and text one stays. Null and wordless texts are linked with nothing and stay.
    """
    return neardup.keep_one(docs.select(*COLUMNS), NEAR).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets and linked credential parts by a mark, with n_chars that of the new text; documents without any stay as they are.

    Null and empty texts have none. Rows are changed one by one, so repeated rows and null doc_ids stay.
    """
    found = secrets.scan(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.when(F.col("redacted").isNotNull(), F.length("redacted").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.coalesce("redacted", "text")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that every source's words come near its target.

    A null source is one source; null and wordless texts count 0 words and are drawn at their source's rate like others.
    Rows with null or repeated doc_ids are drawn row by row; ties in a source's line stand by doc_id and text.
    """
    return mixing.emit(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, scores): the best segmentation of every document, with the scores of the N best.

    A null or empty text gives no ids and one score of 0. A row for every row, so repeated ones and null doc_ids stay;
    equal texts get equal ids, also where segmentations tie.
    """
    best = pieces.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return best.select("doc_id", "source", F.col("nbest")[0]["ids"].alias("ids"), F.transform("nbest", lambda x: x["score"]).alias("scores"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The stages are not expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        docs = stored(stage(spark, docs, sf_dir), f"stage{k + 1}")
        discard(since - (k > 0), 1)  # the stage's own tables, and the documents that it read
    return docs
