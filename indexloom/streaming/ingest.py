"""Feed a chunk collection from a stream of files.

Extraction needs one file at a time, so the stream keeps no state: each micro-batch is cut, embedded and
upserted like a small batch build. An edited file loses the chunks it has no more. Replaying a batch after
a failure replaces the same ids again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from indexloom.operators.embed import Model
from indexloom.plans.build import add_chunks
from indexloom.schemas import FILES
from indexloom.sources.store import IndexStore


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over a folder that Parquet tables of files are added to."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_chunks(
    files: DataFrame,
    store: IndexStore,
    model: Model,
    collection: str,
    checkpoint: str,
    order: list[str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the ingest. `order`: columns that tell which version of a path in one batch is last. `trigger` is
    passed on, `availableNow=True` by default."""

    def upsert_batch(batch: DataFrame, _: int) -> None:
        add_chunks(store, batch, model, collection, order=order)

    return (
        files.writeStream.foreachBatch(upsert_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
