"""Hash-chained audit trails per job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.canonical import canonical
from lotwise.operators.scratch import Scratch

GENESIS = hashlib.sha256(b"GENESIS").hexdigest()
CHAIN = "id string, job_id string, action_type string, payload string, previous_hash string, current_hash string, created_at timestamp"
#: Rows of a chain that follow each other: from which hash to which (null after a mismatch), how many, where the last fork is.
SEGMENTS = "job_id string, start string, `end` string, n long, fork long"


def link(previous: str, payload: str) -> str:
    """Hash of a row: over the previous hash and the payload's canonical JSON."""
    return hashlib.sha256((previous + payload).encode()).hexdigest()


def chain_tails(chain: DataFrame) -> DataFrame:
    """Per job the current_hash that no row of the job has as its previous one."""
    used = chain.select("job_id", F.col("previous_hash").alias("current_hash")).distinct()
    return chain.join(used, ["job_id", "current_hash"], "left_anti").groupBy("job_id").agg(F.min("current_hash").alias("tail"))


def payload_text(actions: DataFrame) -> Column:
    """The payload of actions as the text that chains hash."""
    return F.col("payload") if actions.schema["payload"].dataType.typeName() == "string" else canonical(actions, "payload")


def append_chain(actions: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """Chain rows of new actions (id, job_id, action_type, payload, created_at), in order, after each job's tail.

    A payload of any nested type is hashed, and kept, as canonical JSON; a text is taken to be that already. A job's rows are hashed as a stream in sorted order, so a job of any length needs no memory.
    """
    rows = actions.select("id", "job_id", "action_type", payload_text(actions).alias("payload"), "created_at")
    rows = rows.withColumn("tail", F.lit(GENESIS)) if chain is None else rows.join(chain_tails(chain), "job_id", "left").withColumn("tail", F.coalesce("tail", F.lit(GENESIS)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, last = None, GENESIS
        for f in frames:
            before, now = [], []
            for own, payload, tail in zip(f["job_id"], f["payload"], f["tail"]):
                if own != job:
                    job, last = own, tail
                before.append(last)
                last = link(last, payload or "")
                now.append(last)
            yield f.assign(previous_hash=before, current_hash=now)[["id", "job_id", "action_type", "payload", "previous_hash", "current_hash", "created_at"]]

    return rows.repartition("job_id").sortWithinPartitions("job_id", "created_at", "id").mapInPandas(run, CHAIN)


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per job: total, chain_valid. Valid where all hashes match, one row starts at GENESIS, none forks and none is orphaned."""
    good = F.sha2(F.concat("previous_hash", F.coalesce("payload", F.lit(""))), 256) == F.col("current_hash")
    jobs = chain.groupBy("job_id").agg(F.count("*").alias("total"), F.bool_and(good).alias("_ok"), F.count_if(F.col("previous_hash") == GENESIS).alias("_starts"))
    forks = chain.groupBy("job_id", "previous_hash").agg(F.count("*").alias("n")).where("n > 1").select("job_id").distinct().withColumn("_fork", F.lit(True))
    heads = chain.select("job_id", F.col("current_hash").alias("previous_hash")).distinct()
    orphans = chain.where(F.col("previous_hash") != GENESIS).join(heads, ["job_id", "previous_hash"], "left_anti").select("job_id").distinct().withColumn("_orphan", F.lit(True))
    out = jobs.join(forks, "job_id", "left").join(orphans, "job_id", "left")
    return out.select("job_id", "total", (F.col("_ok") & (F.col("_starts") == 1) & F.col("_fork").isNull() & F.col("_orphan").isNull()).alias("chain_valid"))


def failure_index(chain: DataFrame) -> DataFrame:
    """(job_id, failure_index) of invalid jobs: the last fork on the walk from GENESIS, else its hash mismatch, else where it ends early.

    Rows that follow each other in time order become one segment as they stream by; segments are then joined to the
    next one in doubling steps, so no task holds a job, whatever order its rows have.
    """
    good = F.sha2(F.concat("previous_hash", F.coalesce("payload", F.lit(""))), 256) == F.col("current_hash")
    rows = chain.select("job_id", "previous_hash", F.struct("id", F.coalesce(good, F.lit(False)).alias("ok"), "current_hash", "created_at").alias("_row"))
    # The walk takes the lowest id of a fork and leaves the others.
    taken = rows.groupBy("job_id", "previous_hash").agg(F.min_by("_row", "_row.id").alias("_row"), F.count("*").alias("n"))
    taken = taken.select("job_id", F.col("previous_hash").alias("start"), F.when(F.col("_row.ok"), F.col("_row.current_hash")).alias("end"),
        (F.col("n") > 1).alias("fork"), F.col("_row.created_at").alias("created_at"), F.col("_row.id").alias("id"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            done = []
            for job, start, end, fork in zip(f["job_id"], f["start"], f["end"], f["fork"]):
                if held is None or held[0] != job or held[2] is None or held[2] != start:
                    if held is not None:
                        done.append(held)
                    held = [job, start, None, 0, None]
                if fork:
                    held[4] = held[3]
                held[2], held[3] = end, held[3] + 1
            if done:
                yield _segments(done)
        if held is not None:
            yield _segments([held])

    ordered = taken.repartitionByRange("job_id", "created_at", "id").sortWithinPartitions("job_id", "created_at", "id")
    scratch = Scratch(chain.sparkSession, "chains")
    segments, k = scratch.save(ordered.select("job_id", "start", "end", "fork").mapInPandas(run, SEGMENTS), "segments0"), 0
    head = (F.col("start") == GENESIS) & F.col("end").isNotNull()
    after = lambda s: s.select("job_id", F.col("start").alias("end"), F.col("end").alias("_end"), F.col("n").alias("_n"), F.col("fork").alias("_fork"))
    # Cycles can't occur: a segment's end is null unless all its hashes match.
    while not segments.where(head).join(after(segments), ["job_id", "end"], "left_semi").isEmpty():
        joined = segments.join(after(segments), ["job_id", "end"], "left")
        more = F.col("_n").isNotNull()
        k += 1
        segments = scratch.save(joined.select("job_id", "start", F.when(more, F.col("_end")).otherwise(F.col("end")).alias("end"), (F.col("n") + F.coalesce("_n",
            F.lit(0))).alias("n"), F.coalesce(F.col("n") + F.col("_fork"), "fork").alias("fork")), f"segments{k}")
        if k > 1:
            scratch.drop(f"segments{k - 2}")
    walked = segments.where(F.col("start") == GENESIS)
    total = chain.groupBy("job_id").agg(F.count("*").alias("total"))
    n = F.coalesce("n", F.lit(0))
    index = F.coalesce(F.col("fork"), F.when(F.col("n").isNotNull() & F.col("end").isNull(), n - 1), F.when(n < F.col("total"), n))
    return total.join(walked, "job_id", "left").select("job_id", index.cast("int").alias("failure_index")).where("failure_index is not null")


def _segments(rows: list) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["job_id", "start", "end", "n", "fork"])
    return f.assign(fork=f["fork"].astype("Int64"))


def chain_stats(chain: DataFrame) -> DataFrame:
    """Entries per job and category of action."""
    kind = F.when(F.lower("action_type").rlike("reject|edit|review|approve"), "review").otherwise("system")
    return chain.groupBy("job_id", kind.alias("category")).agg(F.count("*").alias("entries"))


def audit_action_types(chain: DataFrame, jobs: DataFrame) -> DataFrame:
    """The kinds of action that entries of completed jobs have."""
    return chain.join(jobs.where("status = 'completed'").select("job_id"), "job_id", "left_semi").select("action_type").distinct()


def search_audit(chain: DataFrame, jobs: DataFrame, text: str = "", action_type: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Entries of completed jobs by type, days and text in type, payload or title."""
    rows = chain.join(jobs.where("status = 'completed'").select("job_id", "title"), "job_id")
    low = text.lower()
    rows = rows.where(F.lower("action_type").contains(low) | F.lower("payload").contains(low) | F.lower("title").contains(low))
    if action_type:
        rows = rows.where(F.col("action_type") == action_type)
    if first:
        rows = rows.where(F.col("created_at") >= F.lit(first).cast("timestamp"))
    return rows.where(F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1)) if last else rows
