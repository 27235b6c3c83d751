"""Live conversation memory (M7): the last-``2k`` window kept as streaming
state per session.

``groupBy(session).transformWithStateInPandas`` with a list state per key
holding at most ``2k`` (turn, role, text) rows.  Arrival order inside a
micro-batch is not turn order, so new rows are merged with the stored
window by ``turn`` and trimmed; input for one key is consumed batch by
batch and trimmed as it goes, so even a session with a third of all rows
never holds more than ``2k`` rows plus one Arrow batch in memory.  Each
update emits the key's window with a version number; the latest version
per key is the current memory (equal to batch M1 on the same input).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

#: Input of a micro-batch: their number grows with the bytes, not with the files, and each has work for all cores.
BATCH_BYTES = 1 << 29
MSG_SCHEMA = "turn long, role string, text string"
OUT_SCHEMA = "conv_id long, version long, turn long, role string, text string, pos long"


class LastKMemory(StatefulProcessor):
    def __init__(self, k: int = 5):
        self.limit = 2 * k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", MSG_SCHEMA)
        self.version = handle.getValueState("version", "v long")

    def handleInputRows(self, key, rows, timerValues):
        kept = pd.DataFrame(list(self.window.get()), columns=["turn", "role", "text"])
        for pdf in rows:
            pdf = pdf[pdf["role"].isin(["user", "assistant"])][["turn", "role", "text"]]
            kept = pd.concat([kept, pdf], ignore_index=True)
            kept = kept.sort_values("turn", kind="stable").tail(self.limit)
        self.window.clear()
        if len(kept):
            self.window.put([(int(t), r, x) for t, r, x in kept.itertuples(index=False)])
        v = self.version.get()
        ver = (v[0] if v else 0) + 1
        self.version.update((ver,))
        kept = kept.sort_values("turn", ascending=False, kind="stable")
        yield pd.DataFrame({"conv_id": [key[0]] * len(kept), "version": [ver] * len(kept),
                            "turn": kept["turn"].astype("int64").to_numpy(),
                            "role": kept["role"].to_numpy(), "text": kept["text"].to_numpy(),
                            "pos": range(1, len(kept) + 1)})

    def close(self) -> None:
        pass


def trim(k: int):
    """Batch function that keeps the newest ``2k`` messages of each session in
    an Arrow batch: what reaches a session's state is small, however long
    the session is."""
    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["role"].isin(["user", "assistant"])]
            yield pdf.sort_values("turn", kind="stable").groupby("conv_id", sort=False).tail(2 * k)
    return run


def batch_limit(max_files_per_trigger: int | None) -> dict[str, str]:
    """Options of a file stream: so many files a micro-batch, or ``BATCH_BYTES``."""
    return {"maxFilesPerTrigger": str(max_files_per_trigger)} if max_files_per_trigger else {"maxBytesPerTrigger": str(BATCH_BYTES)}


def stream_memory(spark: SparkSession, source_path: str, k: int = 5,
                  max_files_per_trigger: int | None = None, out_dir: str | None = None) -> DataFrame:
    """Run the stateful stream over the parquet files at ``source_path`` to
    completion (``availableNow``) and return the current windows as a
    batch DataFrame (conv_id, turn, role, text, pos)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = out_dir or f"{base}/streams/memory-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source_path).schema
    src = (spark.readStream.schema(schema).options(**batch_limit(max_files_per_trigger))
           .parquet(source_path).select("conv_id", "turn", "role", "text"))
    out = src.mapInPandas(trim(k), src.schema).groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=LastKMemory(k), outputStructType=OUT_SCHEMA,
        outputMode="Append", timeMode="None")
    # the operator needs this state store; the session gets its own setting back
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (out.writeStream.format("parquet").option("path", f"{run}/out")
             .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return latest_windows(spark.read.schema(OUT_SCHEMA).parquet(f"{run}/out"))


def latest_windows(emitted: DataFrame) -> DataFrame:
    """Keep each key's newest emitted version (at most 2k rows per version)."""
    last = emitted.groupBy("conv_id").agg(F.max("version").alias("version"))
    return emitted.join(last, ["conv_id", "version"]).select("conv_id", "turn", "role", "text", "pos")
