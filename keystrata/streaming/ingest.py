"""Streaming ingest into a keyed table, and live latest-state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..table import KVTable


def ingest(changes: DataFrame, table: KVTable, checkpoint: str, **trigger):
    """Flush every micro-batch of a stream of changes as a run; batch ids make a replayed batch a no-op."""
    write = lambda batch, batch_id: table.write(batch, batch_id) and None
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stop(query) -> None:
    """Flush what has arrived, then stop: nothing that the source holds by then is left outside the table."""
    if query.isActive:
        query.processAllAvailable()
    query.stop()


def live_latest(changes: DataFrame) -> DataFrame:
    """Update-mode latest version of each key; late, older versions lose by seq, so no watermark is needed."""
    best = F.max(F.struct("seq", "op", "value"))
    return changes.groupBy("key").agg(best.alias("s")).select("key", "s.seq", "s.op", "s.value")


class LatestProcessor(StatefulProcessor):
    """The same as an explicit state machine: emits a key whenever a newer version arrives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "seq long, op string, value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best = tuple(self.state.get()) if self.state.exists() else None
        changed = False
        for f in rows:
            for seq, op, value in zip(f["seq"], f["op"], f["value"]):
                if best is None or seq > best[0]:
                    best, changed = (int(seq), op, value), True
        if changed:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def stateful_latest(changes: DataFrame) -> DataFrame:
    """``LatestProcessor`` over a stream; needs the RocksDB state store provider."""
    ship(changes.sparkSession)
    return changes.groupBy("key").transformWithStateInPandas(LatestProcessor(), "key binary, seq long, op string, value binary", "Update", "None")
