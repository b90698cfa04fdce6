"""Criterion insights, flags, timelines and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.rules import review_confidence
from lotwise.operators.compare import exact_sum, latest_results, verdict_counts
from lotwise.operators.latest import newest_row, surest_row

#: What a dashboard shows of a bidder and of a judged criterion; the first ones give the order.
BIDDER = ("position", "bidder_name", "bidder_file_id", "total_score", "is_disqualified")
INSIGHT = ("bidder_file_id", "criterion_id", "bidder_name", "label", "verdict", "score", "importance", "review_confidence", "parsed_value", "page_number")


def best_extraction_any(extractions: DataFrame) -> DataFrame:
    """The surest extraction per file and criterion, rows that found nothing included."""
    return surest_row(extractions, ["file_id", "criterion_id"])


def ocr_quality_latest(audit_logs: DataFrame) -> DataFrame:
    """Per file the newest castable ocr_quality of its ingestion events."""
    seen = audit_logs.where("action = 'ingestion_done'").withColumn("_q", F.get_json_object("details", "$.ocr_quality").try_cast("double")).where("_q is not null")
    return seen.groupBy("file_id").agg(F.max_by("_q", F.struct("created_at", "id")).alias("ocr_quality"))


def ingestion_enrichment(files: DataFrame, audit_logs: DataFrame) -> DataFrame:
    """Files with the values of their newest ingestion event, even where those are missing."""
    last = newest_row(audit_logs.where("action = 'ingestion_done'"), ["file_id"])
    return files.select("file_id", "job_id", "original_name").join(last.select("file_id", F.get_json_object("details",
        "$.ocr_quality").try_cast("double").alias("ocr_quality"), F.get_json_object("details", "$.document_kind").alias("document_kind")), "file_id", "left")


def criterion_insights(results: DataFrame, criteria: DataFrame, files: DataFrame, extractions: DataFrame, audit_logs: DataFrame) -> DataFrame:
    """Every newest result with its criterion, bidder, evidence and review confidence."""
    named = criteria.select(F.col("id").alias("criterion_id"), "label", "mandatory", "ambiguous", "threshold_value", F.lit(True).alias("_known"))
    best = best_extraction_any(extractions).select(F.col("file_id").alias("bidder_file_id"), "criterion_id", "extraction_confidence", "not_found", "source_snippet", "page_number", "parsed_value")
    rows = latest_results(results).join(named, "criterion_id", "left").join(files.select(F.col("file_id").alias("bidder_file_id"),
        F.col("original_name").alias("bidder_name")), "bidder_file_id", "left")
    rows = rows.join(best, ["bidder_file_id", "criterion_id"], "left").join(ocr_quality_latest(audit_logs).withColumnRenamed("file_id", "bidder_file_id"), "bidder_file_id", "left")
    importance = F.when(F.col("_known").isNull(), "medium").when(F.col("mandatory"), "high").when(F.col("weight") >= 2, "medium").otherwise("low")
    missing = F.coalesce("not_found", F.lit(True))
    snippet = F.coalesce(F.length("source_snippet") > 0, F.lit(False))
    sure = review_confidence(F.col("verdict"), F.col("score"), F.col("extraction_confidence"), missing, F.col("threshold_value").isNotNull(), F.coalesce("ambiguous",
        F.lit(False)), snippet, F.coalesce("ocr_quality", F.lit(1.0)))
    return rows.select("job_id", "bidder_file_id", F.coalesce("bidder_name", F.lit("")).alias("bidder_name"), "criterion_id", "label", "verdict", "score",
        importance.alias("importance"), missing.alias("not_found"), "extraction_confidence", "parsed_value", "page_number", sure.alias("review_confidence"))


def quality_flags(jobs: DataFrame, results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Flag rows per job: no results, too many unknown, numeric criteria without threshold."""
    latest = latest_results(results)
    empty = jobs.select("job_id").join(latest.select("job_id").distinct(), "job_id", "left_anti").select("job_id", F.lit("empty_evaluation").alias("flag"),
        F.lit("critical").alias("severity"), F.lit("").alias("detail"))
    sums = latest.groupBy("job_id").agg(F.count_if(F.col("verdict") == "unknown").alias("u"), F.count("*").alias("n")).where("2 * u > n")
    many = sums.select("job_id", F.lit("high_unknown_ratio"), F.lit("warning"), F.concat("u", F.lit("/"), "n"))
    unclear = latest.where("verdict = 'unknown'").join(criteria.where("threshold_value is null").select(F.col("id").alias("criterion_id")), "criterion_id", "left_semi")
    none = unclear.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("criterion_id")), ",").alias("detail")).select("job_id", F.lit("missing_numeric_thresholds"), F.lit("info"), "detail")
    return empty.union(many).union(none)


def evaluation_timeline(results: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Results per day for the last days up to today, zero where there are none."""
    if not 1 <= days <= 90:
        raise ValueError("days must be 1 to 90")
    spine = results.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("day"))
    counts = results.where(F.col("created_at") >= F.date_sub(F.lit(today).cast("date"), days - 1)).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("evaluations"))


def verdict_distribution(results: DataFrame) -> DataFrame:
    """Counts of each verdict over all rows; verdicts without rows only where there are none at all."""
    counts = results.groupBy("verdict").agg(F.count("*").alias("n"))
    three = results.sparkSession.createDataFrame([("pass", 1), ("fail", 2), ("unknown", 3)], "verdict string, position int")
    total = F.sum("n").over(Window.partitionBy())
    return three.join(counts, "verdict", "left").select("verdict", "position", F.coalesce("n", F.lit(0)).alias("n")).withColumn("_t", total).where("n > 0 or _t = 0").drop("_t")


def trust_bands(results: DataFrame) -> DataFrame:
    """Newest results per score band and job; bands without rows are left out."""
    return latest_results(results).groupBy("job_id", F.when(F.col("score") >= 0.85, "high").when(F.col("score") >= 0.60, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n"))


def score_histogram(results: DataFrame) -> DataFrame:
    """Newest results in five equal bins of the score, the last closed; empty bins stay."""
    bins = results.sparkSession.range(5).select(F.col("id").cast("int").alias("bin"))
    counts = latest_results(results).groupBy(F.least(F.floor(F.col("score") * 100 / 20), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.concat(F.col("bin") * 20, F.lit("-"), F.col("bin") * 20 + 20).alias("range"), F.coalesce("n", F.lit(0)).alias("n"))


def score_trend(results: DataFrame) -> DataFrame:
    """Running mean of the score of 100 over a bidder's criteria in order, rounded."""
    w = Window.partitionBy("job_id", "bidder_file_id").orderBy("criterion_id").rowsBetween(Window.unboundedPreceding, 0)
    return latest_results(results).select("job_id", "bidder_file_id", "criterion_id", F.count("*").over(w).alias("position"),
        F.round(F.sum(F.col("score").cast("decimal(18,4)")).over(w).cast("double") * 100 / F.count("*").over(w)).cast("long").alias("running_percent"))


def display_extraction(extractions: DataFrame) -> DataFrame:
    """The extraction to show per criterion and file: found ones first, then the surest, then the first."""
    from lotwise.operators.latest import best_row

    return best_row(extractions, ["criterion_id", "file_id"], F.struct("not_found", -F.col("extraction_confidence"), "created_at", "id"))


def dashboard(jobs: DataFrame, results: DataFrame, criteria: DataFrame, files: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """One nested row per job: summary, ranked bidders, flags, and criterion insights where they are given."""
    from lotwise.operators.compare import compare_bidders, job_summary, rank_bidders

    ranked = rank_bidders(compare_bidders(results, criteria, files)).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rank",
        F.lit(1 << 30)).alias("position"), *BIDDER[1:]))).alias("bidders"))
    flags = quality_flags(jobs, results, criteria).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("flag", "severity", "detail"))).alias("flags"))
    out = job_summary(jobs, results, criteria).join(ranked, "job_id", "left").join(flags, "job_id", "left")
    if insights is None:
        return out
    return out.join(insights.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*INSIGHT))).alias("criteria")), "job_id", "left")


def list_jobs(jobs: DataFrame, skip: int, limit: int) -> DataFrame:
    """A page of jobs, newest first."""
    return jobs.orderBy(F.desc("created_at"), "job_id").offset(skip).limit(limit)


def search_jobs(jobs: DataFrame, text: str = "", status: str | None = None, first: str | None = None, last: str | None = None, newest: bool | None = None, page: int = 0,
    size: int | None = None) -> DataFrame:
    """Jobs by title or id, status ("processing": any working state) and day of creation, both ends included.

    newest sorts by creation, the newest or the oldest first; size cuts that into pages, of which page (from 0) is given.
    """
    out = jobs.where(F.lower("title").contains(text.lower()) | F.col("job_id").contains(text.lower()))
    if status:
        out = out.where(F.col("status").isin("ingesting", "extracting", "evaluating") if status == "processing" else F.col("status") == status)
    if first:
        out = out.where(F.col("created_at") >= F.lit(first).cast("timestamp"))
    if last:
        out = out.where(F.col("created_at") < F.date_add(F.lit(last).cast("date"), 1))
    if newest is not None or size is not None:
        out = out.orderBy(F.asc("created_at") if newest is False else F.desc("created_at"), "job_id")
    return out if size is None else out.offset(page * size).limit(size)


def recent_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The n jobs created last, newest first."""
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(n)


def job_duration_stats(jobs: DataFrame) -> DataFrame:
    """Mean seconds from creation to the last change of completed jobs, and how many are active."""
    seconds = F.when(F.col("status") == "completed", F.unix_timestamp("updated_at") - F.unix_timestamp("created_at"))
    return jobs.agg(F.round(F.avg(seconds), 4).alias("mean_seconds"), F.count_if(F.col("status").isin("ingesting", "extracting", "evaluating")).alias("active"), F.count("*").alias("jobs"))


def review_queue(jobs: DataFrame, insights: DataFrame) -> DataFrame:
    """Unknown rows of completed jobs with title, confidence and priority."""
    rows = insights.where("verdict = 'unknown'").join(jobs.where("status = 'completed'").select("job_id", "title"), "job_id")
    priority = F.when(F.col("importance") == "high", "high").when(F.col("importance") == "medium", "normal").otherwise("low")
    return rows.select("job_id", "title", "bidder_file_id", "criterion_id", F.coalesce("review_confidence", "extraction_confidence", "score",
        F.lit(0.0)).alias("confidence"), priority.alias("priority"))


def pending_reviews(results: DataFrame, reviews: DataFrame, n: int = 5) -> DataFrame:
    """Per job the first n unknown criteria that no review action names, and how many there are."""
    rows = latest_results(results).where("verdict = 'unknown'").select("job_id", "criterion_id").distinct().join(reviews.select("job_id", "criterion_id").distinct(),
        ["job_id", "criterion_id"], "left_anti")
    # Only the first n of each job pass the window's shuffle; counts combine before theirs.
    first = rows.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy("criterion_id"))).where(F.col("position") <= n)
    return first.join(rows.groupBy("job_id").agg(F.count("*").alias("pending")), "job_id").select("job_id", "criterion_id", "position", "pending")
