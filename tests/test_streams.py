"""Streams that stop and go on, rows that come again, and batches that are taken twice."""

import datetime
import random

import pandas as pd
import pytest

from lotwise.operators import audit
from lotwise.streaming import jobs
from test_jobs import stream

ACTIONS = "id string, job_id string, action_type string, payload string, created_at timestamp"


def actions(n, seed=3):
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    return [(f"{k:05}", f"j{rng.randrange(3)}", "x", f'{{"k": {k}}}', start + datetime.timedelta(minutes=k // 4)) for k in range(n)]


def chained(spark, path):
    rows = jobs.read_batches(spark, path, spark.createDataFrame([], audit.CHAIN).schema)
    return sorted(map(tuple, rows.collect()))


def test_a_chain_goes_on_after_a_stop(spark, tmp_path):
    """Three files, the stream stopped after each; later files repeat rows of earlier ones, shuffled."""
    rows, rng = actions(240), random.Random(1)
    parts = [rows[:100], rows[100:180] + rng.sample(rows[:100], 30), rng.sample(rows, 60) + rows[180:] + rows[200:210]]
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, ACTIONS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        source = spark.readStream.schema(ACTIONS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.run_to_table(jobs.stream_append_chain(source), str(tmp_path / "out"), str(tmp_path / "state"))
    want = sorted(map(tuple, audit.append_chain(spark.createDataFrame(rows, ACTIONS)).collect()))
    assert chained(spark, str(tmp_path / "out")) == want


def test_a_batch_of_many_pieces_is_in_order(spark, tmp_path):
    rows = actions(300)
    shuffled = random.Random(2).sample(rows, len(rows))
    spark.createDataFrame(shuffled, ACTIONS).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        jobs.run_to_table(jobs.stream_append_chain(spark.readStream.schema(ACTIONS).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chained(spark, str(tmp_path / "out")) == sorted(map(tuple, audit.append_chain(spark.createDataFrame(rows, ACTIONS)).collect()))


@pytest.mark.parametrize("mode,want", [("append", {"2024-01-01": 2, "2024-01-02": 1, "2024-01-06": 2}), ("complete", {"2024-01-01": 2, "2024-01-02": 1, "2024-01-06": 2, "2024-01-09": 1})])
def test_days_come_once(spark, tmp_path, mode, want):
    """A late row is dropped in append mode, and a batch that is written twice changes nothing."""
    day = lambda d, h=0: (datetime.datetime(2024, 1, d, h),)
    late = [[day(1, 7)]] if mode == "append" else []
    source = stream(spark, [[day(1), day(1, 5), day(2)], [day(6)], [day(6, 3)], *late, [day(9)]], "created_at timestamp", str(tmp_path / "in"))
    counts, path = jobs.stream_daily_counts(source), str(tmp_path / "out")
    written = []

    def twice(batch, k):
        written.append(k)
        jobs.put_batch(batch, k, path)
        jobs.put_batch(batch, k, path)

    counts.writeStream.outputMode(mode).foreachBatch(twice).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = jobs.read_batches(spark, path, counts.schema, newest=mode == "complete")
    got = [(r.day, r.n) for r in rows.collect()]
    assert sorted(got) == sorted(want.items()) and len(written) >= 4
    jobs.run_to_table(counts, path, str(tmp_path / "state"), mode)
    assert sorted((r.day, r.n) for r in rows.collect()) == sorted(got)


class Held:
    """A state kept in memory that counts its calls."""

    def __init__(self):
        self.all, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: () in self.all, "get": lambda: self.all[()], "update": lambda v: self.all.__setitem__((), v),
            "containsKey": self.all.__contains__, "getValue": self.all.__getitem__, "updateValue": self.all.__setitem__, "removeKey": self.all.__delitem__,
        }[name]


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, Held())

    getMapState = getValueState


def test_state_is_called_for_blocks_not_for_rows(monkeypatch):
    """A batch of many pieces, more than are merged at once, takes few calls of the state, and its rows come in order; blocks are left by none."""
    monkeypatch.setattr(jobs, "FAN_IN", 4, raising=False)
    rows, handle, made = random.Random(5).sample(actions(6000), 6000), Handle(), jobs.ChainProcessor()
    frame = pd.DataFrame(rows, columns=["id", "job_id", "action_type", "payload", "created_at"])
    made.init(handle)
    out = pd.concat(made.handleInputRows(("j",), (frame[k : k + 500] for k in range(0, 6000, 500)), None))
    want = frame.sort_values(["created_at", "id"])
    assert list(out.id) == list(want.id) and list(out.created_at) == list(want.created_at) and list(out.previous_hash)[1:] == list(out.current_hash)[:-1]
    assert sum(s.calls for s in handle.states.values()) < 200 and not handle.states["runs"].all


def test_new_ids_are_the_first_rows_of_their_ids():
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    batch = lambda *rows: iter([pd.DataFrame([(i, "x", p, at(m) if m is not None else pd.NaT) for i, p, m in part], columns=list(jobs.ACTION)) for part in rows])
    made = jobs.NewIds()
    made.init(Handle())
    ids = lambda *rows: [(r.job_id, r.id, r.payload) for f in made.handleInputRows(("j", 0), batch(*rows), None) for r in f.itertuples()]
    assert ids([("a", "late", 5), ("b", "b", 1)], [("a", "early", 2), ("c", "none", None), ("c", "c", 9)]) == [("j", "a", "early"), ("j", "b", "b"), ("j", "c", "c")]
    assert ids([("a", "again", 0), ("d", "d", 3)]) == [("j", "d", "d")] and ids([("d", "d", 3)]) == []
