"""Checks of data: comparing runs, evidence, duplicates, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.rules import strip
from lotwise.operators.compare import latest_results


#: Buckets by job, and within each by row, that runs are compared in; their product bounds what is broadcast.
JOB_BUCKETS, ROW_BUCKETS = 256, 256


def _bucketed(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    whole = F.xxhash64(*columns)
    return rows.select(*columns, (F.pmod(F.xxhash64(key), F.lit(JOB_BUCKETS)) * ROW_BUCKETS + F.pmod(whole, F.lit(ROW_BUCKETS))).cast("int").alias("_bucket"))


def bucket_digests(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """(_bucket, n, total, mixed) of a run: digests that depend on its rows and how often each comes, and on no order."""
    columns = rows.columns
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return _bucketed(rows, columns, key).groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("total"), F.sum(two.cast("decimal(20,0)")).alias("mixed"))


def diff_runs(a: DataFrame, b: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of only one of two runs (same columns), with the side; repeated rows count.

    Runs are compared by digests of buckets first, by job and row, which combine before their shuffle. Only rows of buckets
    that differ are shuffled, and counted once for both runs: those of the left add one, those of the right take one off.
    A bucket whose digests agree by chance (128 bits) would be taken for equal.
    """
    columns, names = a.columns, ["n", "total", "mixed"]
    left, right = bucket_digests(a, key), bucket_digests(b.select(*columns), key)
    differ = left.join(right.select("_bucket", *(F.col(c).alias(f"_{c}") for c in names)), "_bucket", "full")
    differ = F.broadcast(differ.where(~F.struct(*names).eqNullSafe(F.struct(*(F.col(f"_{c}").alias(c) for c in names)))).select("_bucket"))
    suspects = [_bucketed(rows, columns, key).join(differ, "_bucket", "left_semi").select(*columns, F.lit(sign).cast("long").alias("_sign")) for rows, sign in ((a, 1), (b, -1))]
    counts = suspects[0].unionByName(suspects[1]).groupBy(*columns).agg(F.sum("_sign").alias("_n")).where("_n <> 0")
    repeated = counts.withColumn("_n", F.explode(F.array_repeat(F.when(F.col("_n") > 0, "left").otherwise("right"), F.abs("_n").cast("int"))))
    return repeated.withColumnRenamed("_n", "side")


def run_signature(results: DataFrame, criteria: DataFrame, files: DataFrame) -> DataFrame:
    """Newest results without what differs from job to job: ids become criterion keys and bidder names, times go."""
    rows = latest_results(results).join(criteria.select(F.col("id").alias("criterion_id"), "criterion_key", "label"), "criterion_id", "left")
    rows = rows.join(files.select(F.col("file_id").alias("bidder_file_id"), F.col("original_name").alias("bidder_name")), "bidder_file_id", "left")
    return rows.select("job_id", "criterion_key", "label", "bidder_name", "verdict", "score", "weight", "weighted_score", "explanation")


def _evidence(extractions: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Found extractions with has_snippet, has_page, in_range, and on_page: the start of the snippet is on its page."""
    flat = lambda c: strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    rows = extractions.where(~F.col("not_found")).join(files.select("file_id", "page_count"), "file_id", "left")
    rows = rows.join(pages.select("file_id", "page_number", F.col("text").alias("_t")), ["file_id", "page_number"], "left")
    rows = rows.withColumns({"_s": strip(F.coalesce("source_snippet", F.lit(""))), "_t": F.coalesce("_t", F.lit(""))})
    within = F.coalesce((F.col("page_number") >= 1) & (F.col("page_number") <= F.col("page_count")), F.lit(False))
    probe = F.substring(flat("_s"), 1, 60)
    has_page = F.coalesce(F.col("page_number") != 0, F.lit(False))
    return rows.withColumns({"has_snippet": F.col("_s") != "", "has_page": has_page, "in_range": within, "on_page": within & (probe != "") & flat("_t").contains(probe)})


def audit_evidence(extractions: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Per job, of found rows: how many have a snippet, a page, a page in the document, and a snippet on that page."""
    counts = {"with_snippet": "has_snippet", "with_page": "has_page", "page_in_range": "in_range", "on_page": "on_page"}
    return _evidence(extractions, files, pages).groupBy("job_id").agg(F.count("*").alias("found"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def evidence_mismatches(extractions: DataFrame, files: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """Per job the first rows (by time, then id) whose page is in the document but doesn't hold their snippet."""
    rows = _evidence(extractions, files, pages).where("in_range and not on_page")
    order = Window.partitionBy("job_id").orderBy("created_at", "id")
    rows = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return rows.select("job_id", "position", "id", "file_id", "page_number", F.substring("_s", 1, 50).alias("snippet"))


def duplicate_criteria(criteria: DataFrame) -> DataFrame:
    """Jobs and keys that come more than once."""
    return criteria.groupBy("job_id", "criterion_key").agg(F.count("*").alias("n")).where("n > 1")


def score_bounds(values: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: least and most value, distinct values, and whether all are within 0 and 1."""
    return values.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count_distinct(value).alias("distinct_values"), F.bool_and(F.col(value).between(0, 1)).alias("in_bounds"))
