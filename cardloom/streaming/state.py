"""Streams with state of their own: a watch that knows the last snapshot of each card, and touches folded into their cards.

Both are order-proof: rows wait in the state of their card until the watermark has passed them, then a timer takes them
in the order of their time and number. So shuffled and repeated micro-batches give what one batch gives; rows that come
after the watermark are dropped. A restart goes on from the checkpoint, with what was waiting. State lies in the RocksDB
store, which keeps it on disk; a card's state is a few numbers, and what waits within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from cardloom.functions import scalars as S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "id string, seq long, ms long, kind string, fact string, superseded_by string"
FOLDED = "id string, access_count long, last_access double, stability double"
FACT_CHARS = 60


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and states of several kinds need this store; takes effect for queries that start later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Waiting(StatefulProcessor):
    """Rows that wait for the watermark, in a map by (time, number); `settle` takes those that it has passed, in order."""

    wait = "seq long, fact string, superseded_by string"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, seq long", self.wait)
        self.done = handle.getValueState("done", "ms long, seq long")

    def hold(self, rows: Iterator[pd.DataFrame]) -> None:
        done = tuple(self.done.get()) if self.done.exists() else None
        for batch in rows:
            for r in batch.itertuples(index=False):
                key = (int(r.ms), int(r.seq))
                if done is None or key > done:  # else repeated: it was taken before
                    self.waiting.updateValue(key, self.kept(r))
                    self.handle.registerTimer(key[0])

    def passed(self, ms: int) -> list[tuple]:
        found = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= ms), key=lambda x: x[0])
        for k, _ in found:
            self.waiting.removeKey(k)
        if found:
            self.done.update(found[-1][0])
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.hold(rows)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.passed(expiredTimerInfo.getExpiryTimeInMs())
        if found:
            yield from self.settle(key[0], found)

    def close(self) -> None:
        pass


class _Watch(_Waiting):
    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "seq long, superseded_by string")

    def kept(self, r) -> tuple:
        return int(r.seq), r.fact, r.superseded_by

    def settle(self, card: str, found: list[tuple]) -> Iterator[pd.DataFrame]:
        last, out = self.last.get() if self.last.exists() else None, []
        for (ms, _), (seq, fact, into) in found:
            if last is None:
                kind = "new" if into is None else "audit"
            elif seq <= last[0] or into == last[1]:
                if seq > last[0]:
                    last = (seq, last[1])
                continue
            else:
                kind = "superseded"
            last = (seq, into)
            out.append((card, seq, ms, kind, None if fact is None else fact[:FACT_CHARS], into))
        if last is not None:
            self.last.update(last)
        if out:
            yield pd.DataFrame(out, columns=["id", "seq", "ms", "kind", "fact", "superseded_by"])


def watch(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of a stream of states of cards (id, seq, at: timestamp, fact, superseded_by): id, seq, at, kind, fact (its beginning), superseded_by.

    new: a card is seen for the first time; audit: for the first time, and already superseded; superseded: it points elsewhere
    than at last. seq numbers the states of a card; other changes are no events.
    """
    use_rocksdb(log.sparkSession)
    rows = log.select("id", "seq", "at", "fact", "superseded_by", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    told = rows.groupBy("id").transformWithStateInPandas(statefulProcessor=_Watch(), outputStructType=T.StructType.fromDDL(EVENTS), outputMode="Append", timeMode="EventTime")
    return told.selectExpr("id", "seq", "timestamp_millis(ms) as at", "kind", "fact", "superseded_by")


def changes(log: DataFrame) -> DataFrame:
    """The events of watch(), of a whole log at once."""
    first = log.groupBy("id", "seq").agg(F.min(F.struct("at", "fact", "superseded_by")).alias("x")).select("id", "seq", "x.*")
    by = Window.partitionBy("id").orderBy("seq")
    seen = first.withColumns({"n": F.row_number().over(by), "was": F.lag("superseded_by").over(by)})
    kind = "case when n = 1 then if(superseded_by is null, 'new', 'audit') when not (superseded_by <=> was) then 'superseded' end"
    return seen.withColumn("kind", F.expr(kind)).where("kind is not null").selectExpr("id", "seq", "at", "kind", f"left(fact, {FACT_CHARS}) as fact", "superseded_by")


class _Fold(_Waiting):
    wait = "n long"

    def init(self, handle) -> None:
        super().init(handle)
        self.card = handle.getValueState("card", "access_count long, last_access double, stability double, importance double")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        self.card.update((int(r.access_count), float(r.last_access), float(r.stability), float(r.importance)))

    def kept(self, r) -> tuple:
        return (1,)

    def settle(self, card: str, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if not self.card.exists():  # touches of a card that isn't there
            return
        count, last, stability, importance = self.card.get()
        stability = S.stability_after(stability, count, importance, len(found))
        count, last = count + len(found), max(last, max(k[0] for k, _ in found) / 1000)
        self.card.update((count, last, stability, importance))
        yield pd.DataFrame([(card, count, last, stability)], columns=["id", "access_count", "last_access", "stability"])


def fold(touches: DataFrame, cards: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Cards after their touches, as a stream: for touches (id, seq: its number, at: timestamp) rows of FOLDED, each time a card has new ones.

    cards (id, access_count, last_access, stability, importance) are what a card starts from; a touch that comes twice counts once.
    """
    use_rocksdb(touches.sparkSession)
    rows = touches.select("id", "seq", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    start = cards.select("id", "access_count", "last_access", "stability", "importance").groupBy("id")
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=_Fold(), outputStructType=T.StructType.fromDDL(FOLDED), outputMode="Append", timeMode="EventTime", initialState=start)
