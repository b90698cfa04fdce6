"""From extractions to verdicts and decisions, for all jobs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.canonical import canonical, join_texts
from lotwise.functions.rules import DEFAULT_CONFIDENCE, branch, explanation_of, score_of, verdict_of
from lotwise.operators.latest import newest_row, surest_row

# Fixed value: what follows the number of open criteria in a message.
OPEN_MESSAGE = " criterion/criteria could not be evaluated deterministically — human review required."


def best_extraction(extractions: DataFrame) -> DataFrame:
    """The surest found extraction per job, file and criterion."""
    return surest_row(extractions.where(~F.col("not_found")), ["job_id", "file_id", "criterion_id"])


def evaluation_grid(files: DataFrame, criteria: DataFrame, best: DataFrame) -> DataFrame:
    """Every bidder file with every criterion of its job, with its value and confidence where there is one."""
    bidders = files.where("file_type = 'bidder'").select("job_id", F.col("file_id").alias("bidder_file_id"))
    wanted = criteria.select("job_id", F.col("id").alias("criterion_id"), "criterion_key", "label", "mandatory", "ambiguous", "threshold_value", "operator")
    value = best.select("job_id", F.col("file_id").alias("bidder_file_id"), "criterion_id", "parsed_value", F.col("extraction_confidence").alias("confidence"))
    grid = bidders.join(wanted, "job_id").join(value, ["job_id", "bidder_file_id", "criterion_id"], "left")
    return grid.withColumn("confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))


def evaluation_grid_no_bidders(files: DataFrame, criteria: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row per criterion of jobs without bidder files; the value is the surest of the whole job."""
    lone = criteria.join(files.where("file_type = 'bidder'").select("job_id").distinct(), "job_id", "left_anti")
    best = surest_row(extractions.where(~F.col("not_found")).drop("file_id"), ["job_id", "criterion_id"])
    value = best.select("job_id", "criterion_id", "parsed_value", F.col("extraction_confidence").alias("confidence"))
    wanted = lone.select("job_id", F.col("id").alias("criterion_id"), "criterion_key", "label", "mandatory", "ambiguous", "threshold_value", "operator",
        F.lit(None).cast("string").alias("bidder_file_id"))
    return wanted.join(value, ["job_id", "criterion_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))


def evaluate_grid(grid: DataFrame) -> DataFrame:
    """verdict, score, explanation, weight and weighted_score of each grid row. Row-local."""
    said = [F.col(c) for c in ("label", "threshold_value", "operator", "parsed_value")]
    taken = F.col("_branch")
    # Columns of their own, so that what nobody asks for isn't made.
    rows = grid.withColumn("_branch", branch(said[0], F.col("ambiguous"), *said[1:])).withColumns({"verdict": verdict_of(taken), "score": score_of(taken, F.col("confidence")),
        "explanation": explanation_of(taken, *said)})
    return rows.select("job_id", "bidder_file_id", "criterion_id", "criterion_key", "mandatory", "verdict", "score", "explanation", F.lit(1.0).alias("weight"), F.round("score", 4).alias("weighted_score"))


def not_yet_judged(grid: DataFrame, existing: DataFrame) -> DataFrame:
    """Grid rows without a stored result; a missing bidder equals a missing bidder."""
    known = existing.select(F.col("job_id").alias("_j"), F.col("bidder_file_id").alias("_b"), F.col("criterion_id").alias("_c")).distinct()
    return grid.join(known, (grid.job_id == F.col("_j")) & (grid.criterion_id == F.col("_c")) & grid.bidder_file_id.eqNullSafe(F.col("_b")), "left_anti")


def evaluate_jobs(criteria: DataFrame, files: DataFrame, extractions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Judged rows of every bidder and criterion of all jobs, only fresh ones where existing results are given."""
    grid = evaluation_grid(files, criteria, best_extraction(extractions)).unionByName(evaluation_grid_no_bidders(files, criteria, extractions))
    return evaluate_grid(grid if existing is None else not_yet_judged(grid, existing))


def evaluate_with_stored(criteria: DataFrame, files: DataFrame, extractions: DataFrame, stored: DataFrame) -> DataFrame:
    """The verdicts that decisions run over: of bidders and criteria with stored results the newest of those, of all others fresh ones.

    Columns as evaluate_grid's without the key, and `fresh`, which marks the rows that are to be appended.
    """
    grid = evaluation_grid(files, criteria, best_extraction(extractions))
    kept = newest_row(stored.where("bidder_file_id is not null"), ["job_id", "bidder_file_id", "criterion_id"])
    kept = grid.select("job_id", "bidder_file_id", "criterion_id", "mandatory").join(kept.select("job_id", "bidder_file_id", "criterion_id", "verdict", "score", "explanation", "weight",
        "weighted_score"), ["job_id", "bidder_file_id", "criterion_id"])
    fresh = evaluate_grid(not_yet_judged(grid, stored)).drop("criterion_key")
    return kept.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))


def final_decision(results: DataFrame) -> DataFrame:
    """Status, score and counts per job and bidder; a failed mandatory criterion disqualifies (missing: mandatory)."""
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    sums = results.withColumn("_w", weight).groupBy("job_id", "bidder_file_id").agg(
        F.sum((F.col("score") * F.col("_w")).cast("decimal(18,4)")).cast("double").alias("_s"), F.sum(F.col("_w").cast("decimal(18,4)")).cast("double").alias("_t"),
        F.bool_or((F.col("verdict") == "fail") & F.coalesce("mandatory", F.lit(True))).alias("_out"),
        *(F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in ("pass", "fail", "unknown")),
    )
    return sums.select(
        "job_id", "bidder_file_id", F.when(F.col("_out"), "DISQUALIFIED").otherwise("QUALIFIED").alias("status"), F.coalesce(F.round(F.try_divide("_s", "_t"), 4), F.lit(0.0)).alias("score"),
        F.round("_s", 4).alias("total_weighted"), F.round("_t", 4).alias("total_weight"), "pass_count", "fail_count", "unknown_count",
    )


def job_completion(results: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Totals per job with the status that completes it.

    Where jobs (job_id, metadata: a map of texts) are given, their metadata comes too, with the counts in it.
    """
    totals = _completion(results)
    if jobs is None:
        return totals
    counts = F.create_map(
        F.lit("evaluation_complete"), F.lit("true"), F.lit("evaluation_pass"), F.col("pass_total").cast("string"), F.lit("evaluation_fail"), F.col("fail_total").cast("string"),
        F.lit("evaluation_unknown"), F.col("unknown_total").cast("string"),
    )
    known = totals.join(jobs.select("job_id", "metadata"), "job_id", "left").withColumn("_counts", counts)
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("_counts", k))
    return known.withColumn("metadata", F.map_concat(kept, "_counts")).drop("_counts")


def _completion(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id").agg(*(F.count_if(F.col("verdict") == v).alias(f"{v}_total") for v in ("pass", "fail", "unknown")),
        F.count_distinct("bidder_file_id").alias("bidders_evaluated")).withColumns({"status": F.lit("completed"), "review_required": F.col("unknown_total") > 0})


def evaluation_events(totals: DataFrame) -> DataFrame:
    """Audit rows of completed jobs with their details: one that evaluation is done, and one that review is needed where it is.

    The first also names the chain's action and has its payload. Both documents are canonical JSON.
    """
    some = F.col("unknown_total") > 0
    counts = {"total": F.col("pass_total") + F.col("fail_total") + F.col("unknown_total"), "pass": F.col("pass_total"), "fail": F.col("fail_total"), "unknown": F.col("unknown_total"),
        "bidders_evaluated": F.col("bidders_evaluated")}
    counted = [c.alias(name) for name, c in counts.items()]
    rows = totals.withColumns({"_counts": F.struct(*counted), "_open": F.struct("job_id", *counted, F.lit(True).alias("review_required")), "_closed": F.struct("job_id", *counted),
        "_need": F.struct(F.col("unknown_total").alias("unknown_count"), F.lit(True).alias("review_required"), join_texts(F.col("unknown_total").cast("string"), OPEN_MESSAGE).alias("message"))})
    done = rows.select("job_id", F.lit("evaluation_done").alias("action"), F.when(some, "evaluation_complete_review_needed").otherwise("evaluation_complete_finalized").alias("chain_action"),
        "unknown_total", canonical(rows, "_counts").alias("details"), F.when(some, canonical(rows, "_open")).otherwise(canonical(rows, "_closed")).alias("payload"))
    none = F.lit(None).cast("string")
    need = rows.where(some).select("job_id", F.lit("review_needed").alias("action"), none.alias("chain_action"), "unknown_total", canonical(rows, "_need").alias("details"), none.alias("payload"))
    return done.unionByName(need)
