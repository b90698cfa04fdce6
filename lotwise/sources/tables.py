"""Tables in and out: uploads, relational tables, idempotent replacement, appended results, JSON reports."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.compare import compare_bidders, job_summary, latest_results, rank_bidders
from lotwise.operators.insight import BIDDER, INSIGHT, quality_flags
from lotwise.operators.scratch import Scratch, running

# Accepted kinds and size of uploads.
ACCEPTED = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/png", "image/jpeg", "image/tiff")
MOST_BYTES = 100 * 1024 * 1024
#: Columns of an entry of an audit report, and bytes of entries in a piece of it.
ENTRY, PIECE_BYTES = ("created_at", "id", "action_type", "payload", "current_hash"), 4 << 20

#: Rows of a bucket of a laid-out table, about, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 8


def read_upload_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with size and SHA-256 of their bytes; contents don't leave the scan.

    The scan skips files without bytes; their rows come from its list of files, which is on the driver in any case.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = scan.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("checksum"))
    listed = spark.createDataFrame([(unquote(re.sub("^([a-z0-9]+):///", r"\1:/", f)),) for f in scan.inputFiles()], "path string")
    empty = listed.join(scan.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("size_bytes"), F.sha2(F.lit(b""), 256).alias("checksum"))
    return read.unionByName(empty)


def accept_uploads(files: DataFrame) -> DataFrame:
    """files with a reason: 415 for a kind that isn't accepted, 413 for too large a file, null if accepted."""
    return files.withColumn("reason", F.when(~F.coalesce(F.col("mime_type").isin(*ACCEPTED), F.lit(False)), 415).when(F.col("size_bytes") > MOST_BYTES, 413))


def dedupe_uploads(files: DataFrame) -> DataFrame:
    """files with the surviving file of the same job and checksum: the oldest, then the lowest id."""
    first = files.groupBy("job_id", "checksum").agg(F.min_by("file_id", F.struct("created_at", "file_id")).alias("survivor"))
    return files.join(first, ["job_id", "checksum"]).withColumn("is_duplicate", F.col("file_id") != F.col("survivor"))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def _dealt(df: DataFrame, files: int) -> DataFrame:
    """A bucket's rows in so many parts, each of which is one task's and one file."""
    return df.repartition("bucket", F.pmod(F.xxhash64(*[c for c in df.columns if c != "bucket"], F.lit(1)), F.lit(files)))


def write_table(df: DataFrame, path: str, name: str, bucket_key: str = "job_id", buckets: int = 64, files: int = 4) -> None:
    """Replace a table, partitioned by a bucket of its key, so that later replacement touches few partitions.

    A bucket is written as so many files at most: choose buckets and files so that a part is of a size for one task.
    """
    _dealt(df.withColumn("bucket", F.pmod(F.xxhash64(bucket_key), F.lit(buckets))), files).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def append_results(df: DataFrame, path: str, name: str) -> None:
    """Append rows; existing ones are never changed."""
    df.write.mode("append").parquet(f"{path}/{name}")


def replace_rows(spark: SparkSession, fresh: DataFrame, path: str, name: str, key: str = "file_id", buckets: int = 64, files: int = 4) -> None:
    """Replace the rows of fresh's keys; only partitions that hold such keys are read and written.

    The merged partitions go to a sibling folder first, so a lost executor can't leave a partition half written.
    """
    placed = fresh.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    old = spark.read.parquet(f"{path}/{name}")
    kept = old.join(placed.select("bucket").distinct(), "bucket", "left_semi").join(fresh.select(key).distinct(), key, "left_anti")
    merged = kept.select(*old.columns).unionByName(placed.select(*old.columns))
    merged.write.mode("overwrite").parquet(f"{path}/_{name}_merged")
    again = spark.read.schema(merged.schema).parquet(f"{path}/_{name}_merged")
    _dealt(again, files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")


def write_laid_out(df: DataFrame, name: str, path: str, keys: tuple[str, ...] = ("job_id", "bidder_file_id"), buckets: int | None = None) -> None:
    """Write a catalogued table at a path of the shared folder, bucketed by keys; what groups or joins by those then needs no exchange.

    One task and file a bucket. Where no number of buckets is given, the rows are counted, and a bucket has about BUCKET_ROWS
    of them, so that a task's share doesn't grow with the table. A table of that name is replaced.
    """
    buckets = buckets or max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def read_laid_out(spark: SparkSession, name: str) -> DataFrame:
    """A table of write_laid_out, with its layout known to the optimiser."""
    return spark.table(name)


def reset_jobs(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of other jobs than those given, whose rows are to be made again."""
    return df.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def job_reports(dashboard: DataFrame, jobs: DataFrame) -> DataFrame:
    """One JSON document per job: header, summary, bidders and flags, and criterion insights where the dashboard has them.

    For jobs whose lists may be too long for one value there is dashboard_pieces.
    """
    return jobs.select("job_id", "title").join(dashboard, "job_id").select("job_id", F.to_json(F.struct("title",
        F.struct(*[c for c in dashboard.columns if c not in ("job_id",)]).alias("evaluation"))).alias("report"))


def audit_reports(chain: DataFrame, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """JSON documents (job_id, piece, report): each job's chain in time order, in pieces numbered from 0 of at most most_bytes and one entry."""
    size = F.lit(200) + F.coalesce(F.octet_length("payload"), F.lit(0))
    return pieces(chain, list(ENTRY), ["created_at", "id"], size, "entries", most_bytes).withColumnRenamed("document", "report")


def pieces(rows: DataFrame, entry: list[str], order: list[str], size: Column, name: str, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """JSON documents (job_id, piece, document) with a list `name` of a job's entries in order, in pieces numbered from 0.

    An entry is the columns of that name, of which the first ones decide the order within a piece; size is its bytes. A
    piece has at most most_bytes and one entry, so no job's list is ever one value. Rows are written to the shared folder,
    as their running sums read them several times.
    """
    rows = Scratch(rows.sparkSession, name).save(rows.select("job_id", *dict.fromkeys([*entry, *order]), size.alias("_size")), "entries")
    # An entry counts as one piece at most, so that no number is left out.
    counted = F.least("_size", F.lit(most_bytes)).cast("long")
    placed = running(rows, "job_id", order, counted, "_before").withColumn("piece", F.floor(F.col("_before") / most_bytes))
    return placed.groupBy("job_id", "piece").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*entry))).alias(name))).alias("document"))


def dashboard_pieces(jobs: DataFrame, results: DataFrame, criteria: DataFrame, files: DataFrame, insights: DataFrame, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """The dashboard as documents of bounded size: (job_id, part, piece, document).

    Part `summary` is one document a job with its counts and flags; the lists of parts `bidders` and `criteria` come in
    pieces, which join in order to the lists that dashboard() has in one value. Newest results are found once and written.
    """
    results = Scratch(results.sparkSession, "dashboard").save(latest_results(results), "latest")
    ranked = rank_bidders(compare_bidders(results, criteria, files)).withColumn("position", F.coalesce("rank", F.lit(1 << 30)))
    bytes_of = lambda *columns: sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(4)) + len(c) + 6 for c in columns), F.lit(2))
    lists = []
    for part, rows, entry in (("bidders", ranked, list(BIDDER)), ("criteria", insights, list(INSIGHT))):
        cut = pieces(rows, entry, entry[:3] if part == "bidders" else entry[:2], bytes_of(*entry), part, most_bytes)
        lists.append(cut.select("job_id", F.lit(part).alias("part"), "piece", "document"))
    flags = quality_flags(jobs, results, criteria).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("flag", "severity", "detail"))).alias("flags"))
    summary = job_summary(jobs, results, criteria).join(flags, "job_id", "left")
    said = F.to_json(F.struct(*[c for c in summary.columns if c != "job_id"]))
    head = summary.select("job_id", F.lit("summary").alias("part"), F.lit(0).cast("long").alias("piece"), said.alias("document"))
    return head.unionByName(lists[0]).unionByName(lists[1])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
