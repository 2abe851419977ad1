"""From raw documents to packed training sequences: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it kept, and returns the columns of
``documents``; the last returns pieces in their sequences. Further columns of ``documents`` aren't carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extentlake.llm import decontaminate, jaccard_join, language_id, packing, substring_dedup
from extentlake.llm._common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is in no language if the probability of that is so high. On the test tables noise of 20 letters and more has
#: 0.91 and above, the first one to six words of clean documents have 0.89 at most, whole clean documents far less.
NO_LANGUAGE = 0.9
#: The hash of its text tells rows apart that repeat an id with different texts.
TEXT_HASH = "xxhash64(text)"
#: Decisions of up to this many rows (64 bytes each in memory) are sent to all tasks; more are joined by a shuffle of the documents.
BROADCAST_ROWS = 250_000


def _decided(decisions: DataFrame) -> DataFrame:
    """The saved decisions, to be broadcast if they are few enough."""
    return F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text or letters (``und``), and those whose probability of being in no language is NO_LANGUAGE or more.

    Rows with a null or repeated id, a null source or a null language are judged by their text like any other, repeated rows
    alike; ties between languages don't matter. Long strings of digits or hexadecimal digits aren't noise here,
    as they stand in clean documents too. Without a labelled row nothing can be learnt and every row is
    dropped; no rows give no rows.
    """
    docs = docs.select(COLUMNS)
    judged = language_id.identify(docs, language_id.train(docs), carry=["text", "lang", "source", "n_chars"])
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("no_language") < NO_LANGUAGE)).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays (of rows that repeat this id, the one whose text
    has the smallest hash). Of rows that repeat id and text, one stays if the text has words.

    Rows without an id, and texts that are null, empty or have no words, are in no group: all of them stay. Rows that repeat
    an id with different texts are judged apart. Whole texts are compared, however long; no rows give no rows.
    """
    docs, scratch = docs.select(COLUMNS), Scratch(spark, "near")
    judged = scratch.save(jaccard_join.jaccard_components(docs).where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "text_hash", "leads"), "judged")
    copies = judged.groupBy("doc_id", "text_hash").agg(F.bool_and("leads").alias("leads"), F.count("*").alias("n")).where("NOT leads OR n > 1")
    copies = _decided(scratch.save(copies.select("doc_id", F.col("text_hash").alias("key"), "leads"), "copies"))
    rows = docs.withColumn("key", F.expr(TEXT_HASH))
    kept = rows.join(copies, ["doc_id", "key"], "left_anti").select(COLUMNS)
    repeated = rows.join(_decided(copies.where("leads").drop("leads")), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).select(COLUMNS)
    return kept.unionByName(repeated)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that a document of smaller id holds as well; other texts stay as they are.

    A row without an id is kept whole and cuts nothing; rows that repeat an id don't cut each other. Null and empty texts stay
    so; a text may become empty. Texts are read whole, however long; no rows give no rows.
    """
    out = substring_dedup.deduplicate(docs, carry=["text", "lang", "source", "n_chars"])
    cut = F.size("spans") > 0
    return out.withColumn("n_chars", F.when(cut, F.length("kept")).otherwise(F.col("n_chars"))).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text"))).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold half or more of a benchmark item's words in runs of three and more.

    Each row is judged by its own text, also if its id is null or repeats; rows that repeat id and text go or stay together.
    Null and empty texts stay; texts are read whole, however long. No items drop nothing; no rows give no rows.
    """
    docs = docs.select(COLUMNS).withColumn("key", F.expr(TEXT_HASH))
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), carry=["key"]).select(F.col("doc_id").alias("found"), F.col("key").alias("found_key")).distinct()
    found = _decided(Scratch(spark, "contaminated").save(found, "found"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("found")) & (F.col("key") == F.col("found_key")), "left_anti").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is the end id alone; a text above 4096 ids, however long, is cut into pieces. Rows with null or
    repeated ids, and repeated rows, are packed each; no rows give no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No stage but the third has an equivalent in SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
