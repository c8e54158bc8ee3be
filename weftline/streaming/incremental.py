"""Alignment of triples as they arrive: each micro-batch is aligned and written, rows that are finished are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.unmapped import remaining
from weftline.plans.align import identified


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True, finished: DataFrame | None = None) -> StreamingQuery:
    """Starts a query that writes step(new rows) to the Parquet table `output`, partitioned by `batch`.

    The ids of finished rows are the keyed state of the query, in its checkpoint and dealt by key; the output is not read. A batch that
    is repeated after a failure begins with the state before it and replaces what it had written. finished: a table with the triplet_ids
    that were finished elsewhere. The state grows with the ids: for many, choose the RocksDB state store
    (`spark.sql.streaming.stateStore.providerClass`), which keeps it on disk.
    """
    rows = identified(stream)
    if finished is not None:
        rows = remaining(rows, finished)

    def batch(new: DataFrame, number: int) -> None:
        step(new).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = rows.dropDuplicates(["triplet_id"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
