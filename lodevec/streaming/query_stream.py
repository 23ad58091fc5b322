"""Queries that arrive as a stream, answered against a static corpus or index (an extension: batch is the model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodevec.operators.search import search


def answer(queries: DataFrame, corpus: DataFrame, sink: str, checkpoint: str, algorithm: str = "groundtruth", k: int = 10, **options) -> StreamingQuery:
    """Each micro-batch of (qid, regex, qvec) is searched as one query batch. Results go to sink/batch=<n>, written
    whole or replaced when a batch is repeated, so each query is answered exactly once."""

    def step(batch: DataFrame, n: int) -> None:
        search(algorithm, corpus, batch, k=k, **options).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

