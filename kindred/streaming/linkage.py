"""Stream-static linkage: new references against a fixed index. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import DEFAULT, BlockingConfig
from ..functions.text import normalize_records
from ..operators.blocking import generate_candidates


def link_stream(arrivals: DataFrame, index: DataFrame, path: str, checkpoint: str, config: BlockingConfig = DEFAULT) -> StreamingQuery:
    """Writes the candidates of streamed raw records to path, a folder for each micro-batch.

    A batch that is run again overwrites its own folder, so each arrival counts once.
    """

    def batch(df: DataFrame, number: int) -> None:
        generate_candidates(normalize_records(df), index, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
