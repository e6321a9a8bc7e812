"""The pure upserts over a stream: each micro-batch makes a new snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def fold(stream: DataFrame, load: Callable[[], DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame], save: Callable[[DataFrame, int], None]):
    """A writer that applies step(state, batch) to each micro-batch; save must be idempotent by batch id."""
    return stream.writeStream.foreachBatch(lambda batch, n: save(step(load(), batch), n))
