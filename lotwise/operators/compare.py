"""Read models over results: latest rows, comparisons, rankings, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.latest import best_row, newest_row


def exact_sum(c: str | Column) -> Column:
    """A sum that depends on no order: terms have four decimals."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")).cast("double")


def ratio(a: str, b: str) -> Column:
    return F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))


def verdict_counts(prefix: str = "", suffix: str = "_count") -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(f"{prefix}{v}{suffix}") for v in ("pass", "fail", "unknown")]


def latest_results(results: DataFrame) -> DataFrame:
    """Newest result per job, bidder (missing: one group) and criterion."""
    return newest_row(results, ["job_id", "bidder_file_id", "criterion_id"])


def canonical_criteria(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """The earliest of each job's criteria of a key, among those that results name."""
    named = criteria.join(results.select(F.col("criterion_id").alias("id")).distinct(), "id", "left_semi")
    return best_row(named, ["job_id", "criterion_key"], F.struct("created_at", "id"))


def _with_criteria(results: DataFrame, criteria: DataFrame) -> DataFrame:
    named = criteria.select(F.col("id").alias("criterion_id"), "label", "criterion_type", "mandatory", "criterion_key")
    return results.join(named, "criterion_id", "left")


def _names(files: DataFrame) -> DataFrame:
    return files.select(F.col("file_id").alias("bidder_file_id"), F.col("original_name").alias("bidder_name"))


def compare_bidders(results: DataFrame, criteria: DataFrame, files: DataFrame) -> DataFrame:
    """Score, counts and reasons of every bidder from its newest results.

    A failed row disqualifies where its criterion is the canonical one of its key and mandatory.
    """
    rows = _with_criteria(latest_results(results), canonical_criteria(results, criteria))
    failed = (F.col("verdict") == "fail") & F.coalesce("mandatory", F.lit(False))
    sums = rows.groupBy("job_id", "bidder_file_id").agg(exact_sum("weighted_score").alias("_s"), exact_sum("weight").alias("_t"), *verdict_counts(),
        F.count("*").alias("total_count"), F.bool_or(failed).alias("is_disqualified"), F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("label")))),
        ", ").alias("_why"))
    return sums.join(_names(files), "bidder_file_id", "left").select("job_id", "bidder_file_id", F.coalesce("bidder_name", F.lit("Unassigned")).alias("bidder_name"),
        ratio("_s", "_t").alias("total_score"), "pass_count", "fail_count", "unknown_count", "total_count", "is_disqualified", F.nullif("_why",
        F.lit("")).alias("disqualification_reason"))


def rank_bidders(comparison: DataFrame) -> DataFrame:
    """Ranks 1 to n of the eligible bidders of each job; disqualified ones have none."""
    order = Window.partitionBy("job_id", "is_disqualified").orderBy(F.desc("total_score"), "fail_count", F.lower("bidder_name"), "bidder_file_id")
    return comparison.withColumn("_n", F.row_number().over(order)).withColumns({"rank": F.when(~F.col("is_disqualified"), F.col("_n")), "is_eligible": ~F.col("is_disqualified")}).drop("_n")


def verdict_matrix(results: DataFrame) -> DataFrame:
    """Per job and bidder the newest verdicts as an array in criterion order."""
    cell = F.struct("criterion_id", "verdict", "score", "explanation")
    return latest_results(results).groupBy("job_id", "bidder_file_id").agg(F.array_sort(F.collect_list(cell)).alias("verdicts"))


def evaluation_bidders(results: DataFrame, criteria: DataFrame, files: DataFrame) -> DataFrame:
    """Per job and bidder, in order of name and id: status, score, counts, and the failed mandatory criteria's labels, sorted."""
    rows = _with_criteria(latest_results(results), criteria)
    failed = (F.col("verdict") == "fail") & F.coalesce("mandatory", F.lit(False))
    sums = rows.groupBy("job_id", "bidder_file_id").agg(
        exact_sum("weighted_score").alias("total_weighted"), exact_sum("weight").alias("total_weight"), *verdict_counts(),
        F.count("*").alias("total_count"), F.bool_or(failed).alias("_out"), F.array_sort(F.collect_list(F.when(failed, F.col("label")))).alias("reasons"),
    )
    named = sums.join(_names(files), "bidder_file_id", "left")
    order = Window.partitionBy("job_id").orderBy(F.coalesce("bidder_name", F.lit("")), F.coalesce("bidder_file_id", F.lit("")))
    return named.select(
        "job_id", F.row_number().over(order).alias("position"), "bidder_file_id", F.coalesce("bidder_name", F.lit("Unknown")).alias("bidder_name"),
        F.when(F.col("_out"), "DISQUALIFIED").otherwise("QUALIFIED").alias("status"), ratio("total_weighted", "total_weight").alias("score"),
        "pass_count", "fail_count", "unknown_count", "total_count", "reasons", "total_weighted", "total_weight",
    )


def evaluation_view(results: DataFrame, criteria: DataFrame, files: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Per job its score, counts and status: disqualified if all bidders are, to be reviewed if some are.

    Where jobs are given, those without results are pending, with zeros.
    """
    bidders = evaluation_bidders(results, criteria, files)
    sums = bidders.groupBy("job_id").agg(
        exact_sum("total_weighted").alias("_s"), exact_sum("total_weight").alias("_t"), *(F.sum(f"{v}_count").alias(f"{v}_count") for v in ("pass", "fail", "unknown")),
        F.count("*").alias("bidders"), F.count_if(F.col("status") == "DISQUALIFIED").alias("out"),
    )
    status = F.when(F.col("out") == F.col("bidders"), "DISQUALIFIED").when(F.col("out") > 0, "NEEDS_REVIEW").otherwise("QUALIFIED")
    view = sums.select("job_id", ratio("_s", "_t").alias("score"), "pass_count", "fail_count", "unknown_count", "bidders", status.alias("status"))
    if jobs is None:
        return view
    zeros = {c: 0 for c in ("score", "pass_count", "fail_count", "unknown_count", "bidders")}
    return jobs.select("job_id").join(view, "job_id", "left").fillna({**zeros, "status": "PENDING"})


def job_summary(jobs: DataFrame, results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per job: criteria, counts over bidders and criteria, status and whether review is required; zeros while pending."""
    rows = _with_criteria(latest_results(results), canonical_criteria(results, criteria))
    sums = rows.groupBy("job_id").agg(exact_sum("weighted_score").alias("_s"), exact_sum("weight").alias("_t"), *verdict_counts(),
        F.count_distinct("bidder_file_id").alias("_b"), F.bool_or((F.col("verdict") == "fail") & F.coalesce("mandatory", F.lit(False))).alias("_out"))
    keys = criteria.groupBy("job_id").agg(F.count_distinct("criterion_key").alias("_k"))
    all_ = jobs.select("job_id").join(keys, "job_id", "left").join(sums, "job_id", "left").withColumn("_on", F.col("_k").isNotNull() & F.col("_out").isNotNull())
    zero = lambda c: F.when(F.col("_on"), c).otherwise(F.lit(0))
    return all_.select(
        "job_id", zero(F.col("_k")).alias("total_criteria"), *(zero(F.col(f"{v}_count")).alias(f"{v}_count") for v in ("pass", "fail", "unknown")),
            zero(F.when(F.col("_b") > 0, F.col("_b")).otherwise(1)).alias("bidder_count"),
        F.when(~F.col("_on"), 0.0).otherwise(ratio("_s", "_t")).alias("total_score"), F.when(~F.col("_on"), "PENDING").when(F.col("_out"), "DISQUALIFIED").otherwise("QUALIFIED").alias("status"),
        (F.col("_on") & ((F.col("unknown_count") > 0) | (F.col("fail_count") > 0))).alias("review_required"),
    ).fillna({"review_required": False})


def resolved_ratio(summary: DataFrame) -> DataFrame:
    """Decided pairs per criterion, as a rounded percentage and a level."""
    part = F.coalesce(F.try_divide(F.col("pass_count") + F.col("fail_count"), F.col("total_criteria")), F.lit(0.0))
    percent = F.round(part * 100).cast("long")
    return summary.select("job_id", percent.alias("resolved_percent"), F.when(percent >= 70, "High").when(percent >= 40, "Medium").otherwise("Low").alias("level"))


def category_scores(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per job, bidder and kind of criterion: mean score of 100 and counts."""
    rows = _with_criteria(latest_results(results), criteria)
    return rows.groupBy("job_id", "bidder_file_id",
        F.lower("criterion_type").alias("category")).agg(F.round(exact_sum("score") * 100 / F.count("*")).cast("long").alias("score"), *verdict_counts(),
        F.count("*").alias("total_count"))


def bidder_overview(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per bidder: counts, mean score percent, whether nothing failed, and the first three failed labels."""
    rows = _with_criteria(latest_results(results), criteria)
    sums = rows.groupBy("job_id", "bidder_file_id").agg(*verdict_counts(), F.count("*").alias("total_count"),
        F.round(exact_sum("score") * 100 / F.count("*")).cast("long").alias("confidence_percent"), F.array_sort(F.collect_list(F.when(F.col("verdict") == "fail",
        F.struct("criterion_id", "label")))).alias("_f"))
    return sums.select("*", ((F.col("fail_count") == 0) & (F.col("total_count") > 0)).alias("qualified"), F.array_join(F.transform(F.slice("_f", 1, 3),
        lambda x: x["label"]), ", ").alias("failed_labels")).drop("_f")


def job_bidder_counts(comparison: DataFrame) -> DataFrame:
    """Per job: bidders evaluated, qualified, disqualified, and uncertain ones."""
    return comparison.groupBy("job_id").agg(F.count("*").alias("evaluated"), F.count_if(~F.col("is_disqualified")).alias("qualified"),
        F.count_if("is_disqualified").alias("disqualified"), F.count_if(~F.col("is_disqualified") & (F.col("unknown_count") > 0)).alias("uncertain"))


def score_bars(comparison: DataFrame) -> DataFrame:
    """Short bidder names and whole percentages, for bars."""
    name = F.substring(F.regexp_replace("bidder_name", r"(?i)\.(pdf|docx?)$", ""), 1, 16)
    return comparison.select("job_id", "bidder_file_id", name.alias("name"), F.round(F.col("total_score") * 100).cast("long").alias("percent"))
