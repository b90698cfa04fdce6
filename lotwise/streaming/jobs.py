"""Structured Streaming twins of batch operators, and a sink that a repeated batch doesn't change."""

from __future__ import annotations

import heapq
import json
import pickle
from collections import deque
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lotwise.operators.audit import CHAIN, GENESIS, link, payload_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns of an action, and rows of a piece of output.
ACTION, PIECE_ROWS = ("id", "action_type", "payload", "created_at"), 1_000
#: Buckets of a job's ids; rows of a block of a run, and runs merged at once: both bound what a task holds.
ID_BUCKETS, BLOCK_ROWS, FAN_IN = 256, 500, 64
#: Stands for a missing time, after all others.
NO_TIME = (1 << 63) - 1


def stream_daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events per day; in append mode a day comes once, when the watermark has passed it, and rows later than that are dropped."""
    return events.withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 day")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def stream_dedupe_uploads(files: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first upload of a job and checksum within the watermark."""
    return files.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["job_id", "checksum"])


class NewIds(StatefulProcessor):
    """Of a job's ids of one bucket, those that no batch has brought yet, each with its first row. The state is one list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "ids string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = json.loads(self.known.get()[0]) if self.known.exists() else []
        seen, first = set(known), {}
        for piece in rows:
            for row in piece[list(ACTION)].itertuples(index=False, name=None):
                ident, at = row[0], row[3]
                if ident not in seen and (ident not in first or at < first[ident][3] or pd.isna(first[ident][3])):
                    first[ident] = row
        if first:
            self.known.update((json.dumps([*known, *first]),))
            out = pd.DataFrame(list(first.values()), columns=list(ACTION))
            out.insert(0, "job_id", key[0])
            yield out

    def close(self) -> None:
        pass


class ChainProcessor(StatefulProcessor):
    """A job's chain: its tail, and, while a batch lasts, sorted runs of what arrived.

    Rows come in pieces of bounded size. A single piece is sorted in memory; several are kept as runs of blocks in the
    state store and merged from there, at most FAN_IN at once and a block of each, so that a job's batch of any size is never held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "hash string")
        self.runs = handle.getMapState("runs", "run int, place int", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, last = key[0], self.tail.get()[0] if self.tail.exists() else GENESIS
        out = []
        for at, ident, kind, payload in self._in_order(rows):
            now = link(last, payload or "")
            out.append((ident, job, kind, payload, last, now, at))
            last = now
            if len(out) >= PIECE_ROWS:
                yield self._chained(out)
                out = []
        self.tail.update((last,))
        if out:
            yield self._chained(out)

    def _in_order(self, pieces: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        first = next(pieces, None)
        if first is None:
            return
        second = next(pieces, None)
        if second is None:
            yield from self._sorted(first)
            return
        runs, made = deque(), 0
        for piece in chain((first, second), pieces):
            runs.append((made, self._store(made, self._sorted(piece))))
            made += 1
        while len(runs) > FAN_IN:
            few = [runs.popleft() for _ in range(FAN_IN)]
            runs.append((made, self._store(made, self._merged(few))))
            made += 1
        yield from self._merged(runs)

    def _store(self, run: int, rows: Iterator[tuple]) -> int:
        """Keep sorted rows as blocks; how many there are."""
        rows, n = iter(rows), 0
        while block := list(islice(rows, BLOCK_ROWS)):
            self.runs.updateValue((run, n), (pickle.dumps(block),))
            n += 1
        return n

    def _merged(self, runs) -> Iterator[tuple]:
        return heapq.merge(*(self._run(*r) for r in runs), key=lambda r: r[:2])

    def _run(self, run: int, blocks: int) -> Iterator[tuple]:
        for place in range(blocks):
            block = pickle.loads(self.runs.getValue((run, place))[0])
            self.runs.removeKey((run, place))
            yield from block

    @staticmethod
    def _sorted(piece: pd.DataFrame) -> list[tuple]:
        """Rows (time in nanoseconds, missing ones last; id, action_type, payload) in order."""
        at = piece["created_at"].astype("datetime64[ns]")
        rows = piece.assign(created_at=at.astype("int64").where(at.notna(), NO_TIME)).sort_values(["created_at", "id"])
        return list(zip(*(rows[c].tolist() for c in ("created_at", "id", "action_type", "payload"))))

    @staticmethod
    def _chained(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "job_id", "action_type", "payload", "previous_hash", "current_hash", "created_at"])
        at = out["created_at"]
        return out.assign(created_at=pd.to_datetime(at.where(at != NO_TIME, 0), unit="ns").where(at != NO_TIME))

    def close(self) -> None:
        pass


def stream_append_chain(actions: DataFrame) -> DataFrame:
    """Chain rows of arriving actions (id, job_id, action_type, payload, created_at), in order of time and id within a batch.

    An id that its job's chain has already adds nothing: ids are told apart in buckets of their job first, each read and
    written once a batch, then the job's new rows are chained. Payloads of nested types become canonical JSON. The session's
    state store is set to RocksDB, which this state needs.
    """
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = actions.select("id", "job_id", "action_type", payload_text(actions).alias("payload"), "created_at")
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("int")).groupBy("job_id", "bucket")
    new = placed.transformWithStateInPandas(NewIds(), "job_id string, id string, action_type string, payload string, created_at timestamp", "Append", "None")
    return new.groupBy("job_id").transformWithStateInPandas(ChainProcessor(), CHAIN, "Append", "None")


def put_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch under its number, in place of what an earlier attempt at it has written."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all that a stream has and write it batch by batch; run again, it goes on where it was, and no row comes twice."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, k: put_batch(b, k, path)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def read_batches(spark: SparkSession, path: str, schema: T.StructType, newest: bool = False) -> DataFrame:
    """Rows that run_to_table has written; the newest batch's where batches are whole results (complete mode)."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if newest:
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    return rows.select(*schema.fieldNames())
