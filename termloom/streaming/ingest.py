"""Documents that keep arriving: a file stream upserted into the index, batch by batch.

A file stream sees new and changed files, never deletions; a batch run of Engine.index_directory stays the way to
reconcile the index with a directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.engine import Engine
from termloom.operators.index import Delta
from termloom.sources.tables import corpus_from_table


def newest(batch: DataFrame, id_col: str, modified_col: str | None) -> DataFrame:
    """One row per id: the one modified last, else any."""
    if not modified_col:
        return batch.dropDuplicates([id_col])
    order = Window.partitionBy(id_col).orderBy(F.desc_nulls_last(modified_col))
    return batch.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def upsert_stream(
    engine: Engine, stream: DataFrame, id_col: str, text_col: str, checkpoint: str, modified_col: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Starts a query that upserts each micro-batch into the engine's index.

    An upsert of the same batch twice leaves the same index, so a batch that is repeated after a failure does no harm.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        corpus = corpus_from_table(newest(batch, id_col, modified_col), id_col, text_col, modified_col=modified_col)
        engine.update(Delta(corpus, corpus.select("doc_id")))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
