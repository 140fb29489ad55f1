"""Bounded training samples for the classifiers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, bound: int) -> tuple[DataFrame, dict[int, int]]:
    """text and label (0, 1) of at most ``bound`` labelled documents of each class for which ``learn`` holds, and how many
    there are of each class. The sample is that of the smallest id hashes; a document's label is the mean of its
    labels, rounded. At most twice ``bound`` ids are broadcast."""
    one = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    ids = None
    for k in (0, 1):
        part = one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        ids = part if ids is None else ids.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label"), counts
