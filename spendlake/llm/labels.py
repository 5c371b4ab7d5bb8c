"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """``docs`` rows with a column ``y`` in {0, 1}, at most ``rows`` labelled documents.

    Documents of the held-out fold never take part. Repeated labels of a document are averaged and a tie counts as 1;
    null labels and ids are ignored. The hash of the id decides who is in the sample.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(fold_of(F.col("doc_id"), folds) != held_out)
    known = known.groupBy(F.col("doc_id").alias("known_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    # One hash class of about the wanted size is ordered, so what the last task gets does not grow with the table.
    classes = max(1, known.count() // (rows + 4 * int(rows**0.5)))
    picked = known.where(F.pmod(F.xxhash64("known_id"), F.lit(classes)) == 0).orderBy(F.xxhash64("known_id"), "known_id").limit(rows)
    return docs.join(picked, docs["doc_id"] == picked["known_id"]).drop("known_id")
