"""A running number for each message of a conversation, as a stream with keyed state.

Turns come in any order, late and more than once; a conversation's distinct turns are numbered from 1 in their order. State is one
map a conversation, kept by the engine's state store under the query's checkpoint, so a restarted query goes on where the last ended.
A batch gives a row for each turn whose number is new or has changed: of several rows for a turn, the last one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "conv_id long, turn int, n int, role string"


class Numbering(StatefulProcessor):
    """Keeps the turns of each conversation, and gives the numbers that a batch changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn int", "n int, role string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], v[1]) for k, v in self.turns.iterator()} if self.turns.exists() else {}
        roles = {t: r for t, (_, r) in known.items()}
        for part in rows:
            for turn, role in zip(part["turn"].tolist(), part["role"].tolist(), strict=True):
                if turn is not None and turn == turn:
                    # of a turn that is repeated the first role by the alphabet, so that order doesn't matter
                    roles[int(turn)] = min(filter(None, (role, roles.get(int(turn)))), default=None)
        changed = []
        for n, turn in enumerate(sorted(roles), 1):
            if known.get(turn) != (n, roles[turn]):
                self.turns.updateValue((turn,), (n, roles[turn]))
                changed.append((key[0], turn, n, roles[turn]))
        yield pd.DataFrame(changed, columns=["conv_id", "turn", "n", "role"]).astype({"conv_id": "int64", "turn": "int32", "n": "int32"})

    def close(self) -> None:
        pass


def numbered(messages: DataFrame) -> DataFrame:
    """A stream of (conv_id, turn, n, role) of a stream of messages (conv_id, turn, role)."""
    rows = messages.selectExpr("CAST(conv_id AS LONG) AS conv_id", "CAST(turn AS INT) AS turn", "CAST(role AS STRING) AS role")
    return rows.groupBy("conv_id").transformWithStateInPandas(Numbering(), outputStructType=NUMBERED, outputMode="Update", timeMode="None")


def number_files(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Number the messages of the files that no earlier run took; rows go to ``out`` by batch. Settings are put back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)

    def batch(rows: DataFrame, number: int) -> None:
        rows.selectExpr("*", f"CAST({number} AS LONG) AS batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        numbered(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(conv_id, turn, n, role): the last row of each turn under ``out``."""
    rows = spark.read.schema(NUMBERED + ", batch long").parquet(out)
    return rows.groupBy("conv_id", "turn").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch").join(rows, ["conv_id", "turn", "batch"]).select("conv_id", "turn", "n", "role")
