"""Live sessions under control (M5 + M6 + M7): one stateful processor over two
streams, messages and controls.

A control is (conv_id, turn, op, k): ``clear`` drops what stands at or before its
turn, ``delete`` removes the session for good, ``k`` sets the session's own window
(the largest counts).  The state of a session is its newest ``2 * most_k`` messages
behind the last clear, that clear's turn, a tombstone for a deleted session and its
own k.  All of these merge by maximum, so messages and controls may arrive in any
order and any distribution over files: a message behind its clear or its delete
is dropped when it comes, a late turn takes its place by number.  The result equals
``memory.apply_controls`` and then ``memory.last_k_per_session`` on the same input.

A session without input for ``idle_ms`` expires by a processing-time timer: its state is
removed, tombstone included, and a message that comes later begins a new session.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import MEMORY_ROLES
from ..session import ensure_checkpoint_dir
from .memory_state import MSG_SCHEMA, OUT_SCHEMA, batch_limit

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTROL_SCHEMA = "conv_id long, turn long, op string, k int"
#: Both streams as one: op is null for a message.
EVENT_SCHEMA = "conv_id long, turn long, role string, text string, op string, k int"
NEVER = -(1 << 62)     # "not cleared": below every turn


class ControlledMemory(StatefulProcessor):
    def __init__(self, default_k: int, most_k: int, idle_ms: int | None):
        self.default_k, self.most_k, self.idle_ms = default_k, most_k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getListState("window", MSG_SCHEMA)
        self.facts = handle.getValueState("facts", "version long, cleared long, deleted boolean, k int")

    def handleInputRows(self, key, rows, timerValues):
        version, cleared, deleted, k = self.facts.get() or (0, NEVER, False, 0)
        kept = pd.DataFrame(list(self.window.get()), columns=["turn", "role", "text"])
        for pdf in rows:
            op = pdf["op"]
            deleted = bool(deleted or (op == "delete").any())
            cleared = int(max([cleared, *pdf.loc[(op == "clear") & pdf["turn"].notna(), "turn"]]))
            k = int(max([k, *pdf.loc[(op == "k") & pdf["k"].notna(), "k"]]))
            kept = pd.concat([kept, pdf.loc[op.isna(), ["turn", "role", "text"]]], ignore_index=True)
            kept = kept[kept["turn"] > cleared].sort_values("turn", kind="stable").tail(2 * self.most_k)
        if deleted:
            kept = kept.iloc[:0]
        self.window.clear()
        if len(kept):
            self.window.put([(int(t), r, x) for t, r, x in kept.itertuples(index=False)])
        self.facts.update((version + 1, cleared, deleted, k))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._shown(key, version + 1, kept.tail(2 * min(k or self.default_k, self.most_k)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        facts = self.facts.get()
        self.window.clear()
        # the version alone stays, so that what a later session emits counts as newer
        self.facts.update(((facts[0] if facts else 0) + 1, NEVER, False, 0))
        yield self._shown(key, (facts[0] if facts else 0) + 1, pd.DataFrame(columns=["turn", "role", "text"]))

    @staticmethod
    def _shown(key, version: int, kept: pd.DataFrame) -> pd.DataFrame:
        """The window, newest first; an empty one as a row at position 0, so that it replaces the one before."""
        kept = kept.iloc[::-1]
        empty = not len(kept)
        n = 1 if empty else len(kept)
        return pd.DataFrame({"conv_id": [key[0]] * n, "version": [version] * n,
                             "turn": pd.Series([None] if empty else kept["turn"].tolist(), dtype="Int64"),
                             "role": [None] if empty else kept["role"].to_numpy(), "text": [None] if empty else kept["text"].to_numpy(),
                             "pos": [0] if empty else range(1, n + 1)})

    def close(self) -> None:
        pass


def reduce_batch(most_k: int):
    """Batch function: of each session in an Arrow batch the newest ``2 * most_k`` messages, one clear, one
    delete and one k.  What reaches a session's state is small, however much of a stream one session is."""
    def run(batches):
        for pdf in batches:
            control = pdf["op"].notna()
            said = pdf[~control & pdf["role"].isin(MEMORY_ROLES)].sort_values("turn", kind="stable")
            yield said.groupby("conv_id", sort=False).tail(2 * most_k)
            if control.any():
                yield (pdf[control].groupby(["conv_id", "op"], sort=False).agg({"turn": "max", "k": "max"}).reset_index()
                       .assign(role=None, text=None)[pdf.columns])
    return run


def controlled_memory(messages: DataFrame, controls: DataFrame, default_k: int = 5, most_k: int = 20,
                      idle_ms: int | None = None) -> DataFrame:
    """The streaming plan: updates (conv_id, version, turn, role, text, pos) of the sessions' windows.

    ``messages`` (conv_id, turn, role, text) and ``controls`` (``CONTROL_SCHEMA``) are streaming tables; more
    columns are left out.  A k above ``most_k`` counts as ``most_k``, the bound of a session's state."""
    said = messages.select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("op"), F.lit(None).cast("int").alias("k"))
    told = controls.select("conv_id", "turn", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "op", "k")
    events = said.unionByName(told).where("conv_id is not null").mapInPandas(reduce_batch(most_k), EVENT_SCHEMA)
    return events.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=ControlledMemory(default_k, most_k, idle_ms), outputStructType=OUT_SCHEMA, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime")


def current_windows(updates: DataFrame) -> DataFrame:
    """Each session's newest window (at most ``2 * most_k`` rows a version)."""
    last = updates.groupBy("conv_id").agg(F.max("version").alias("version"))
    return updates.join(last, ["conv_id", "version"]).where("pos > 0").select("conv_id", "turn", "role", "text", "pos")


def run_sessions(spark: SparkSession, messages_path: str, controls_path: str, default_k: int = 5, most_k: int = 20,
                 max_files_per_trigger: int | None = None, out_dir: str | None = None) -> DataFrame:
    """Run both file streams to completion (``availableNow``) and return the current windows.

    With the same ``out_dir`` a later call goes on with the files that have come since.  Timers need a stream
    that goes on running (``controlled_memory`` with ``idle_ms``): one that is to end by itself would not, as
    a timer always asks for another batch."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = out_dir or f"{base}/streams/sessions-{uuid.uuid4().hex}"
    said = spark.readStream.schema(spark.read.parquet(messages_path).schema).options(**batch_limit(max_files_per_trigger))
    told = spark.readStream.schema(CONTROL_SCHEMA).options(**batch_limit(max_files_per_trigger))
    out = controlled_memory(said.parquet(messages_path), told.parquet(controls_path), default_k, most_k)
    # the operator needs this state store; the session gets its own setting back
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, ROCKSDB)
    try:
        (out.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/checkpoint")
            .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(key, before)
    return current_windows(spark.read.schema(OUT_SCHEMA).parquet(f"{run}/out"))
