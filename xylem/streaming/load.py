"""Bulk load from a stream: XML documents are shredded as they arrive and appended to a node table.

The table is written batch by batch into a folder of its own for each batch, so a batch that is run again after a
failure replaces its rows instead of adding them twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from xylem.sources.nodes import SCHEMA, NodeStore, node_table


def load_stream(docs: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts loading a streaming DataFrame (doc_id, xml) into ``folder``; ``once``: what is there now, then stop."""

    def put(batch: DataFrame, number: int) -> None:
        node_table(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def loaded(spark: SparkSession, folder: str, name: str) -> NodeStore:
    """The collection that has been loaded so far."""
    nodes = spark.read.schema(SCHEMA + ", path_id long, batch int").parquet(folder).drop("batch")
    return NodeStore(nodes, None, name)
