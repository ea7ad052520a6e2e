"""Streaming ingestion: each micro-batch is a commit group."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import ranked
from ..store import Store, _Files


def stream_id(store: Store, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint; a replaced checkpoint is another stream."""
    return json.loads(_Files(store.spark, checkpoint).read("metadata"))["id"]


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, order: str = "pos", **trigger):
    """Write (batch key ``order``, kind, user_key, value) rows to the store; a replayed batch of the same query changes nothing.

    Rows are ranked by ``order`` over ranges of it; after a batch the store compacts if its level 0 asks for it."""

    def apply(rows: DataFrame, batch_id: int) -> None:
        store.ingest(ranked(rows, [F.col(order)], "seq"), batch_id, stream_id(store, checkpoint))
        if store.options.compact_every:
            store.maintain()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Latest(StatefulProcessor):
    """The newest (seq, kind, value) of a key; rows that arrive late with a smaller (seq, kind) change nothing, deletes stay in state."""

    def __init__(self, value: str) -> None:
        self.value = value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", f"seq long, kind int, value {self.value}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        before = best
        for pdf in rows:
            r = pdf.sort_values(["seq", "kind"]).iloc[-1]
            if best is None or (int(r["seq"]), int(r["kind"])) > (best[0], best[1]):
                best = (int(r["seq"]), int(r["kind"]), None if r["value"] is None or r["value"] is pd.NA else r["value"])
        if best is not None and best != before:
            self.state.update(best)
            yield pd.DataFrame({"user_key": [key[0]], "seq": [best[0]], "kind": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def latest_stream(stream: DataFrame) -> DataFrame:
    """Updates of the latest version per key, values of the stream's own type; needs the RocksDB state store."""
    kinds = dict(stream.dtypes)
    return stream.groupBy("user_key").transformWithStateInPandas(Latest(kinds["value"]), f"user_key {kinds['user_key']}, seq long, kind int, value {kinds['value']}", "Update", "None")


def latest_updates(stream: DataFrame) -> DataFrame:
    """The same by a built-in aggregate: newest row of each key, kept incrementally in JVM state."""
    return stream.groupBy("user_key").agg(F.max_by(F.struct("seq", "kind", "value"), "seq").alias("b")).select("user_key", "b.seq", "b.kind", "b.value")
