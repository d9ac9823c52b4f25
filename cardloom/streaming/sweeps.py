"""The consolidation sweep again and again, as a stream's batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cardloom.operators import sweep


def start(spark: SparkSession, load: Callable[[], tuple[DataFrame, DataFrame]], save: Callable[[DataFrame, DataFrame], None], now: Callable[[], float], every: str = "300 seconds", cosine: bool = True) -> StreamingQuery:
    """Every so often cards and edges are loaded, swept, and given back with the report. A sweep that fails ends the query, with the store as it was; stop() ends it after the sweep that runs."""

    def run(_: DataFrame, batch: int) -> None:
        cards, edges = load()
        plan = sweep.plan_sweep(cards, edges, now(), cosine=cosine)
        save(sweep.apply_plan(cards, plan), plan.report)

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.trigger(processingTime=every).foreachBatch(run).start()
