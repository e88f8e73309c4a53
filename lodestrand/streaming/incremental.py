"""Documents that keep arriving: the index grows by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import graph

GROWING = ("chunks", "sentences", "mentions", "facts")


def grow_index(arriving: DataFrame, path: str, checkpoint: str, config: Config = Config(), once: bool = True) -> StreamingQuery:
    """Append the row-wise index tables of every micro-batch of documents under ``path``, partitioned by corpus.

    Merged tables (entities, edges, nodes) are aggregates over these and are made from them when read. A batch that is
    run again after a failure overwrites its own folder, so no row is ever in twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        chunked = graph.chunks(batch, config)
        split = graph.sentences(chunked)
        made = {"chunks": chunked, "sentences": split, "mentions": graph.mentions(split), "facts": graph.facts(split)}
        for name in GROWING:
            made[name].write.mode("overwrite").partitionBy("corpus_id").parquet(f"{path}/{name}/batch={number}")

    writer = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def grown_index(spark, path: str, config: Config = Config(), encode=None) -> dict[str, DataFrame]:
    """All index tables from the batches so far."""
    t = {n: spark.read.parquet(f"{path}/{n}").drop("batch") for n in GROWING}
    named = graph.entities(t["mentions"])
    edges = graph.all_edges(t["sentences"], t["mentions"], t["facts"], named, config, encode)
    return {**t, "entities": named, "edges": edges, "nodes": graph.nodes(t["chunks"], t["sentences"], named, config.enable_sentence_layer)}
