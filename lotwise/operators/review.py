"""Review actions, decisions after review, and stored queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.canonical import join_texts, python_repr
from lotwise.functions.let import let
from lotwise.functions.rules import DEFAULT_CONFIDENCE, verdict
from lotwise.operators.compare import exact_sum, ratio, verdict_counts
from lotwise.operators.latest import newest_row

# What explanations of reviewed rows say before the reviewer's value, or around it.
REJECTED, OVERRIDDEN, PROVIDED = "Reviewer REJECTED this criterion. Reason: ", "Reviewer override applied with value=", ("Reviewer provided updated value=", ". Re-evaluated: ")


def apply_reviews(actions: DataFrame, results: DataFrame, criteria: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new result rows, error rows) of reviewers' edits and rejections; approvals make no row."""
    work = actions.where("reviewer_action <> 'approve'").select(F.col("id").alias("action_id"), "criterion_id", "evaluation_result_id", "reviewer_action", "updated_value")
    known = results.select(F.col("id").alias("evaluation_result_id"), "job_id", "bidder_file_id", "weight")
    named = criteria.select(F.col("id").alias("criterion_id"), "label", "ambiguous", "threshold_value", "operator", F.lit(True).alias("_c"))
    rows = work.join(known, "evaluation_result_id", "left").join(named, "criterion_id", "left")
    wrong = F.when(F.col("evaluation_result_id").isNull(), "no result id").when(F.col("job_id").isNull(),
        "unknown result").when((F.col("reviewer_action") == "edit") & F.col("_c").isNull(), "unknown criterion")
    given = F.col("updated_value")
    out = lambda kind, score, said: F.struct(F.lit(kind).alias("verdict"), F.lit(score).alias("score"), said.alias("explanation"))
    judged = F.when(F.col("reviewer_action") == "reject", out("fail", 0.0, join_texts(REJECTED, F.coalesce(F.nullif(given, F.lit("")), F.lit("not provided")))))
    judged = judged.when(F.col("threshold_value").isNull(), out("pass", 1.0, join_texts(OVERRIDDEN, F.coalesce(given, F.lit("None")))))
    again = verdict(F.col("label"), F.col("ambiguous"), F.col("threshold_value"), F.col("operator"), given, F.lit(DEFAULT_CONFIDENCE))
    judged = judged.otherwise(let(again, lambda v: v.withField("explanation", join_texts(PROVIDED[0], python_repr(given), PROVIDED[1], v["explanation"]))))
    rows = rows.withColumns({"error": wrong, "_v": judged})
    made = rows.where("error is null").select("action_id", "job_id", "bidder_file_id", "criterion_id", "_v.*", "weight").withColumn("weighted_score", F.round(F.col("score") * F.col("weight"), 4))
    return made, rows.where("error is not null").select("action_id", "error")


def recalculate_decision(jobs: DataFrame, results: DataFrame, criteria: DataFrame) -> DataFrame:
    """Status, score and counts per job from the newest row per criterion, whichever bidder it is of."""
    rows = newest_row(results, ["job_id", "criterion_id"]).join(criteria.select(F.col("id").alias("criterion_id"), "mandatory"), "criterion_id", "left")
    sums = rows.groupBy("job_id").agg(exact_sum("weighted_score").alias("_s"), exact_sum("weight").alias("_t"), *verdict_counts(),
        F.bool_or((F.col("verdict") == "fail") & F.coalesce("mandatory", F.lit(True))).alias("_out"))
    return jobs.select("job_id").join(sums, "job_id", "left").select("job_id", F.when(F.col("_out").isNull(), "PENDING").when(F.col("_out"),
        "DISQUALIFIED").otherwise("QUALIFIED").alias("status"), ratio("_s", "_t").alias("score"), *(F.coalesce(f"{v}_count",
        F.lit(0)).alias(f"{v}_count") for v in ("pass", "fail", "unknown")))


def review_entries_for_chain(actions: DataFrame, made: DataFrame) -> DataFrame:
    """Chain actions (id, job_id, action_type, payload, created_at) of review actions, with what was decided and which new row came of it.

    made: apply_reviews' new rows, whose action_id names the row; columns that actions lack are null in the payload.
    """
    new = made.select(F.col("action_id").alias("id"), F.col("id" if "id" in made.columns else "action_id").alias("new_result_id"))
    known = lambda c: F.col(c) if c in actions.columns else F.lit(None).cast("string").alias(c)
    payload = F.struct(*(known(c) for c in ("actor", "reviewer_action", "criterion_id", "evaluation_result_id")), "new_result_id", *(known(c) for c in ("original_value", "updated_value", "reason")))
    return actions.join(new, "id", "left").select("id", "job_id", F.lit("review_action").alias("action_type"), payload.alias("payload"), "created_at")


def latest_review(actions: DataFrame) -> DataFrame:
    """The newest action per job and criterion."""
    return newest_row(actions, ["job_id", "criterion_id"])


def review_history(actions: DataFrame) -> DataFrame:
    """Every action with its position in the time order of its job's and criterion's actions."""
    order = Window.partitionBy("job_id", "criterion_id").orderBy("created_at", "id")
    return actions.withColumn("position", F.row_number().over(order))


def review_entries(entries: DataFrame, criteria: DataFrame, files: DataFrame, jobs: DataFrame, status: str | None = "pending", skip: int = 0, limit: int | None = None) -> DataFrame:
    """Entries of a status (None: all) with names, and their job's pending and resolved counts.

    With a limit (1000 at most) a page of them, newest first.
    """
    counts = entries.groupBy("job_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "resolved").alias("resolved"))
    if status is not None:
        entries = entries.where(F.col("status") == status)
    if limit is not None:
        entries = entries.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(min(limit, 1000))
    rows = entries.join(criteria.select(F.col("id").alias("criterion_id"), "label", "criterion_key", "mandatory"), "criterion_id", "left")
    rows = rows.join(files.select(F.col("file_id").alias("bidder_file_id"), F.col("original_name").alias("bidder_name")), "bidder_file_id", "left")
    rows = rows.join(jobs.select("job_id", "title", F.col("updated_at").alias("job_updated_at")), "job_id", "left").join(counts, "job_id")
    return rows.select("id", "job_id", "title", "job_updated_at", "criterion_id", "criterion_key", "label", "mandatory", "bidder_name", "status", "created_at", "pending", "resolved")
