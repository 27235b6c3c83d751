"""Live sessions under control: equal to the batch operators whatever order files come in."""

import random

import pandas as pd
import pytest

from tessera.operators import memory
from tessera.streaming import session_state

SCHEMA = "conv_id long, turn long, role string, text string"


def _rows(df):
    return sorted(tuple(r) for r in df.select("conv_id", "turn", "role", "text", "pos").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_batch_in_any_file_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    said = [(s, t, rng.choice(["user", "assistant", "system"]), f"{s}/{t}") for s in range(7) for t in range(rng.randrange(1, 25))]
    told = [(1, 3, "clear", None), (1, 8, "clear", None), (2, 0, "delete", None), (3, 0, "k", 1), (3, 0, "k", 2), (4, 99, "clear", None),
            (5, 4, "clear", None), (5, 0, "k", 3), (77, 1, "delete", None)]
    rng.shuffle(said)
    rng.shuffle(told)
    for i in range(3):     # a message may come before or after the control that concerns it
        spark.createDataFrame(said[i::3], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/said/{i}")
        spark.createDataFrame(told[i::3], session_state.CONTROL_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/told/{i}")
    got = session_state.run_sessions(spark, f"{tmp_path}/said/*", f"{tmp_path}/told/*", default_k=4, most_k=6)
    controls = spark.createDataFrame(told, session_state.CONTROL_SCHEMA)
    left = memory.apply_controls(spark.createDataFrame(said, SCHEMA), controls)
    own = controls.where("op = 'k'").select("conv_id", "k")
    assert _rows(got) == _rows(memory.last_k_per_session(left, own, default_k=4))


def test_goes_on_with_new_files(spark, tmp_path):
    said, told, out = f"{tmp_path}/said", f"{tmp_path}/told", f"{tmp_path}/out"
    run = lambda: {(r["conv_id"], r["turn"]) for r in session_state.run_sessions(spark, said, told, out_dir=out).collect()}
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(said)
    spark.createDataFrame([(1, 1, "clear", None)], session_state.CONTROL_SCHEMA).write.parquet(told)
    write([(1, 1, "user", "a"), (2, 1, "user", "b")])
    assert run() == {(2, 1)}
    write([(2, 2, "assistant", "c"), (1, 2, "user", "d")])
    assert run() == {(2, 1), (2, 2), (1, 2)}


class _State:
    """What the processor sees of a state handle, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getListState(self, name, schema):
        return _State()

    getValueState = getListState

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.value = rows

    def clear(self):
        self.value = []

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return 1_000


def test_idle_session_expires():
    handle, p = _State(), session_state.ControlledMemory(2, 4, 500)
    p.init(handle)
    p.window.clear()
    event = lambda t, op=None: pd.DataFrame({"conv_id": [9], "turn": [t], "role": ["user"], "text": ["x"], "op": [op], "k": [None]})
    first = next(p.handleInputRows((9,), iter([event(5)]), handle))
    assert first["pos"].tolist() == [1] and handle.timers == [1_500]
    next(p.handleInputRows((9,), iter([event(6, "delete")]), handle))
    assert handle.timers == [1_500]                                   # one timer, set anew
    gone = next(p.handleExpiredTimer((9,), handle, None))
    assert gone["pos"].tolist() == [0] and gone["version"].tolist() == [3]
    again = next(p.handleInputRows((9,), iter([event(2)]), handle))   # a session of its own, newer than what was emitted
    assert again["turn"].tolist() == [2] and again["version"].tolist() == [4]


def test_reduced_batches_keep_what_counts():
    pdf = pd.DataFrame({"conv_id": [1] * 60, "turn": range(60), "role": ["user"] * 50 + [None] * 10, "text": ["x"] * 60,
                        "op": [None] * 50 + ["clear"] * 9 + ["delete"], "k": [None] * 60})
    out = pd.concat(session_state.reduce_batch(2)(iter([pdf])))
    assert sorted(out.loc[out["op"].isna(), "turn"]) == [46, 47, 48, 49]
    assert sorted(zip(out["op"].dropna(), out.loc[out["op"].notna(), "turn"])) == [("clear", 58), ("delete", 59)]


@pytest.mark.parametrize("files, batches", [(None, 1), (1, 3)])
def test_batches_go_by_bytes_unless_files_are_given(spark, tmp_path, files, batches):
    from tessera.streaming import memory_state
    said = [(s, t, "user", f"{s}/{t}") for s in range(5) for t in range(9)]
    for i in range(3):
        spark.createDataFrame(said[i::3], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/said/{i}")
        spark.createDataFrame([(i, 2, "clear", None)], session_state.CONTROL_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/told/{i}")
    given = {"max_files_per_trigger": files} if files else {}
    want = [(s, t, "user", f"{s}/{t}", 9 - t) for s in range(5) for t in range(5, 9)]
    assert _rows(memory_state.stream_memory(spark, f"{tmp_path}/said/*", k=2, out_dir=f"{tmp_path}/a", **given)) == want
    assert _rows(session_state.run_sessions(spark, f"{tmp_path}/said/*", f"{tmp_path}/told/*", default_k=2, out_dir=f"{tmp_path}/b", **given)) == want
    assert [len([x for x in (tmp_path / run / "checkpoint/commits").iterdir() if x.name.isdigit()]) for run in "ab"] == [batches] * 2
