"""Labelled documents for the classifiers: all of them, or bounded samples."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def known(labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(_id, label, draw) of the labelled ids outside the held-out fold.

    An id labelled twice takes the larger label; null ids and labels are left out.
    """
    return (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("_id"), folds) != held_out))
        .groupBy("_id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64("_id", F.lit(label)))
    )


def every(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(draw, text, label) of all labelled documents outside the held-out fold, and how many ids are labelled there.

    Ids are broadcast while they are few; texts are read once.
    """
    ids = known(labels, label, folds, held_out, id_col)
    n = ids.count()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(near.few(ids, n), "_id").select("draw", "text", "label"), n


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(draw, text, label) of about ``limit`` labelled documents outside the held-out fold, or all if fewer.

    The drawn ids, at most about ``limit`` of them, are what is broadcast; texts are read once, and only those drawn
    move.
    """
    ids = known(labels, label, folds, held_out, id_col)
    share = min(1.0, limit / max(1, ids.count()))
    drawn = ids.where((F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(drawn), "_id").select("draw", "text", "label")
