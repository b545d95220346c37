"""The bounded sample of labelled rows on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import texts, unsigned_crc


def in_fold(doc_id, folds: int, fold: int):
    """Whether a document belongs to the fold that is held out: crc32 of its id as text modulo `folds`; a null id doesn't."""
    return F.coalesce(unsigned_crc(doc_id) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id, text, label and place (a hash of the id) of at most `most` labelled documents outside the fold that is held out.

    The sample is that of the smallest hashes, so it is the same for any partitioning. Labels other than 0 and 1
    and null ids are left out; of several labels of one id the largest counts, and of several texts the least.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~in_fold(F.col("doc_id"), folds, fold))
    one = own.groupBy("doc_id").agg(F.max(column).cast("int").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    few = one.orderBy("place", "doc_id").limit(most)
    found = texts(docs).join(F.broadcast(few), "doc_id")  # `most` rows of 20 bytes
    return found.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))  # one row an id, however often it occurs
