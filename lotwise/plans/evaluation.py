"""Registered queries of the rule engine and read models, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import rules
from lotwise.operators import compare as Q
from lotwise.operators import evaluate as E
from lotwise.operators import insight as I
from lotwise.sources.adapters import frames, with_adapters

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *tables: str, extra: tuple[tuple[str, str], ...] = ()):
    """Register a function of adapter tables under a name, with its SQL."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*frames(spark, sf_dir, *tables))
        if sql:
            SQL[name] = with_adapters(sql, *extra)
        return f

    return add


def _any(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


NUMBER = """case when lower(trim(parsed_value)) in ('none', 'null', 'nan', '') or len(regexp_extract_all(parsed_value, '\\d+\\.?\\d*')) = 0 then null else
    (case when contains(parsed_value, '[') or contains(parsed_value, ',') then list_avg(cast(regexp_extract_all(parsed_value, '\\d+\\.?\\d*') as double[]))
          else cast(regexp_extract(parsed_value, '\\d+\\.?\\d*') as double) end) end"""
BEST = ("best", "select * from extractions where not not_found qualify row_number() over (partition by job_id, file_id, criterion_id order by extraction_confidence desc, created_at, id) = 1")
GRID = (
    "grid",
    """select f.job_id, f.file_id as bidder_file_id, c.id as criterion_id, c.criterion_key, c.label, c.mandatory, c.ambiguous, c.threshold_value, c.operator, b.parsed_value, coalesce(b.extraction_confidence, 0.87) as confidence
    from files f join criteria c on c.job_id = f.job_id left join best b on b.job_id = f.job_id and b.file_id = f.file_id and b.criterion_id = c.id where f.file_type = 'bidder'
    union all select c.job_id, null, c.id, c.criterion_key, c.label, c.mandatory, c.ambiguous, c.threshold_value, c.operator, b.parsed_value, coalesce(b.extraction_confidence, 0.87)
    from criteria c left join (select * from extractions where not not_found qualify row_number() over (partition by job_id, criterion_id order by extraction_confidence desc, created_at, id) = 1) b on b.job_id = c.job_id and b.criterion_id = c.id
    where c.job_id not in (select job_id from files where file_type = 'bidder')""",
)
JUDGED = (
    "judged",
    f"""select *, case verdict when 'pass' then round(confidence, 4) when 'fail' then 0.0 else 0.3 end as score from (
    select *, case when ambiguous then 'unknown' when threshold_value is not null and number is null then 'unknown'
      when threshold_value is not null then (case when (case operator when 'lte' then number <= threshold_value when 'gt' then number > threshold_value when 'lt' then number < threshold_value else number >= threshold_value end) then 'pass' else 'fail' end)
      when parsed_value is null then 'unknown' when (contains(lower(label), 'gst') or contains(lower(label), 'tax')) and regexp_matches(upper(parsed_value), '\\b\\d{{2}}[A-Z]{{5}}\\d{{4}}[A-Z][A-Z\\d]Z[A-Z\\d]\\b') then 'pass'
      when {_any('lower(parsed_value)', rules.CLEAN_PHRASES)} then 'pass' when {_any('lower(parsed_value)', rules.FAIL_PHRASES)} then 'fail' when trim(parsed_value) <> '' then 'pass' else 'unknown' end as verdict
    from (select *, case when contains(parsed_value, 'lakh') then round(raw / 100, 4) else raw end as number from (select *, {NUMBER} as raw from grid)))""",
)
TO_JUDGED = (BEST, GRID, JUDGED)
LATEST = ("latest", "select * from results qualify row_number() over (partition by job_id, bidder_file_id, criterion_id order by created_at desc, id desc) = 1")
CANON = ("canon", "select * from criteria where id in (select criterion_id from results) qualify row_number() over (partition by job_id, criterion_key order by created_at, id) = 1")
COUNTS = "count(*) filter (verdict = 'pass') as pass_count, count(*) filter (verdict = 'fail') as fail_count, count(*) filter (verdict = 'unknown') as unknown_count"
SCORE = "coalesce(round(cast(sum(cast(weighted_score as decimal(18,4))) as double) / cast(sum(cast(weight as decimal(18,4))) as double), 4), 0)"
COMPARED = (
    "compared",
    f"""select job_id, bidder_file_id, coalesce(max(original_name), 'Unassigned') as bidder_name, {SCORE} as total_score, {COUNTS}, count(*) as total_count,
    coalesce(bool_or(verdict = 'fail' and mandatory), false) as is_disqualified, nullif(string_agg(label, ', ' order by label) filter (verdict = 'fail' and mandatory), '') as disqualification_reason
    from (select l.*, c.label, c.mandatory, f.original_name from latest l left join canon c on c.id = l.criterion_id left join files f on f.file_id = l.bidder_file_id) group by job_id, bidder_file_id""",
)
TO_COMPARED = (LATEST, CANON, COMPARED)
RANKED = """select *, case when not is_disqualified then row_number() over (partition by job_id, is_disqualified
      order by total_score desc, fail_count, lower(bidder_name), bidder_file_id nulls first) end as rank, not is_disqualified as is_eligible
      from compared"""

query("evaluate_jobs", "select job_id, bidder_file_id, criterion_id, verdict, score from judged", "criteria", "files", "extractions", extra=TO_JUDGED)(lambda c, f,
    x: E.evaluate_jobs(c, f, x).select("job_id", "bidder_file_id", "criterion_id", "verdict", "score"))
query("evaluation_grid", "select job_id, bidder_file_id, criterion_id, parsed_value, confidence from grid where bidder_file_id is not null", "files", "criteria", "extractions", extra=(BEST, GRID))(
    lambda f, c, x: E.evaluation_grid(f, c, E.best_extraction(x)).select("job_id", "bidder_file_id", "criterion_id", "parsed_value", "confidence"))
query("evaluation_grid_no_bidders", "select job_id, criterion_id, parsed_value, confidence from grid where bidder_file_id is null", "files", "criteria", "extractions", extra=(BEST, GRID))(
    lambda f, c, x: E.evaluation_grid_no_bidders(f, c, x).select("job_id", "criterion_id", "parsed_value", "confidence"))
query("best_extraction", "select * from best", "extractions", extra=(BEST,))(E.best_extraction)
query("to_float", f"""select id, case when contains(parsed_value, 'lakh') then round(raw / 100, 4) else raw end as number
      from (select *, {NUMBER} as raw from extractions)""", "extractions")(lambda x: x.select("id", rules.to_float(F.col("parsed_value")).alias("number")))
query("is_gst", "select id, regexp_matches(upper(parsed_value), '\\b\\d{2}[A-Z]{5}\\d{4}[A-Z][A-Z\\d]Z[A-Z\\d]\\b') as is_gst from extractions",
    "extractions")(lambda x: x.select("id", rules.is_gst(F.col("parsed_value")).alias("is_gst")))
query("explanations", """select job_id, bidder_file_id, criterion_id, concat('[', label, '] ', case when ambiguous then 'Criterion is ambiguous — cannot evaluate deterministically'
    when threshold_value is not null and number is null then 'Value not found or not numeric in bidder document' when threshold_value is not null then concat('extracted=', number, ' ', operator, ' threshold=', threshold_value, ' → ', upper(verdict))
    when parsed_value is null then 'Not found in bidder document' when contains(lower(label), 'gst') and parsed_value = '29AABCI1234F1Z5' then concat('Valid GST number found: ', parsed_value)
    when parsed_value in ('is not blacklisted', 'hereby declare') then concat('Compliant (not blacklisted/debarred): ''', parsed_value, '''') when verdict = 'fail' then concat('Non-compliant: ''', parsed_value, '''')
    when parsed_value in ('valid', 'registered') then concat('Compliant: ''', parsed_value, '''') when parsed_value <> '' then concat('Value present: ''', parsed_value, '''') else 'Could not determine compliance from: ''''' end) as explanation from judged""",
    "criteria", "files", "extractions", extra=TO_JUDGED)(lambda c, f, x: E.evaluate_jobs(c, f, x).select("job_id", "bidder_file_id", "criterion_id", "explanation"))
query("not_yet_judged", """select job_id, bidder_file_id, criterion_id from grid g where not exists (select 1 from results r
      where r.job_id = g.job_id and r.criterion_id = g.criterion_id and r.bidder_file_id is not distinct
      from g.bidder_file_id) and g.bidder_file_id is not null""", "files", "criteria", "extractions", "results", extra=(BEST, GRID))(
    lambda f, c, x, r: E.not_yet_judged(E.evaluation_grid(f, c, E.best_extraction(x)), r).select("job_id", "bidder_file_id", "criterion_id"))
query("final_decision",
    f"""select job_id, bidder_file_id, case when bool_or(verdict = 'fail' and mandatory) then 'DISQUALIFIED' else 'QUALIFIED' end as status, round(cast(sum(cast(score as decimal(18,4))) as double) / count(*), 4) as score,
    round(cast(sum(cast(score as decimal(18,4))) as double), 4) as total_weighted, cast(count(*) as double) as total_weight, {COUNTS} from judged group by job_id, bidder_file_id""",
        "criteria", "files", "extractions", extra=TO_JUDGED)(lambda c, f, x: E.final_decision(E.evaluate_jobs(c, f, x)))
TOTALS = ("totals", """select job_id, count(*) filter (verdict = 'pass') as pass_total, count(*) filter (verdict = 'fail') as fail_total, count(*) filter (verdict = 'unknown') as unknown_total,
      count(distinct bidder_file_id) as bidders_evaluated, 'completed' as status, count(*) filter (verdict = 'unknown') > 0 as review_required
      from judged group by job_id""")
query("job_completion", "select * from totals", "criteria", "files", "extractions", extra=(*TO_JUDGED, TOTALS))(lambda c, f, x: E.job_completion(E.evaluate_jobs(c, f, x)))
query("evaluation_events",
    """select job_id, 'evaluation_done' as action, case when unknown_total > 0 then 'evaluation_complete_review_needed' else 'evaluation_complete_finalized' end as chain_action, unknown_total,
      concat('{"bidders_evaluated": ', bidders_evaluated, ', "fail": ', fail_total, ', "pass": ', pass_total, ', "total": ', pass_total + fail_total + unknown_total, ', "unknown": ', unknown_total, '}') as details,
      concat('{"bidders_evaluated": ', bidders_evaluated, ', "fail": ', fail_total, ', "job_id": "', job_id, '", "pass": ', pass_total, case when unknown_total > 0 then ', "review_required": true' else '' end,
        ', "total": ', pass_total + fail_total + unknown_total, ', "unknown": ', unknown_total, '}') as payload from totals
    union all select job_id, 'review_needed', null, unknown_total, concat('{"message": "', unknown_total, ' criterion/criteria could not be evaluated deterministically \\u2014 human review required.", "review_required": true, "unknown_count": ', unknown_total, '}'), null
      from totals where unknown_total > 0""", "criteria", "files", "extractions", extra=(*TO_JUDGED,
        TOTALS))(lambda c, f, x: E.evaluation_events(E.job_completion(E.evaluate_jobs(c, f, x))))

query("latest_results", "select * from latest", "results", extra=(LATEST,))(Q.latest_results)
query("canonical_criteria", "select * from canon", "results", "criteria", extra=(CANON,))(Q.canonical_criteria)
query("compare_bidders", "select * from compared", "results", "criteria", "files", extra=TO_COMPARED)(Q.compare_bidders)
query("rank_bidders", RANKED, "results", "criteria", "files", extra=TO_COMPARED)(lambda r, c, f: Q.rank_bidders(Q.compare_bidders(r, c, f)))
query("verdict_matrix", """select job_id, bidder_file_id, string_agg(concat(criterion_id, '=', verdict), ',' order by criterion_id) as verdicts
      from latest group by job_id, bidder_file_id""", "results", extra=(LATEST,))(
    lambda r: Q.verdict_matrix(r).select("job_id", "bidder_file_id", F.array_join(F.transform("verdicts", lambda v: F.concat(v["criterion_id"], F.lit("="), v["verdict"])), ",").alias("verdicts")))
query("evaluation_view",
    f"""select job_id, coalesce(round(cast(sum(s) as double) / cast(sum(t) as double), 4), 0) as score, cast(sum(pass_count) as bigint) as pass_count, cast(sum(fail_count) as bigint) as fail_count, cast(sum(unknown_count) as bigint) as unknown_count, count(*) as bidders,
    case when count(*) filter (gone) = count(*) then 'DISQUALIFIED' when count(*) filter (gone) > 0 then 'NEEDS_REVIEW' else 'QUALIFIED' end as status from
    (select l.job_id, l.bidder_file_id, sum(cast(weighted_score as decimal(18,4))) as s, sum(cast(weight as decimal(18,4))) as t, {COUNTS}, coalesce(bool_or(verdict = 'fail' and c.mandatory), false) as gone from latest l left join canon c on c.id = l.criterion_id group by 1, 2) group by job_id""",
    "results", "criteria", "files", extra=(LATEST, CANON))(Q.evaluation_view)
SUMMARY = (
    "summary",
    f"""select j.job_id, case when s.job_id is null or k.job_id is null then 0 else k.n end as total_criteria, coalesce(pass_count, 0) as pass_count, coalesce(fail_count, 0) as fail_count, coalesce(unknown_count, 0) as unknown_count,
    case when s.job_id is null then 0 when b > 0 then b else 1 end as bidder_count, coalesce(total_score, 0.0) as total_score, case when s.job_id is null then 'PENDING' when gone then 'DISQUALIFIED' else 'QUALIFIED' end as status, coalesce(unknown_count > 0 or fail_count > 0, false) as review_required
    from jobs j left join (select job_id, count(distinct criterion_key) as n from criteria group by 1) k on k.job_id = j.job_id
    left join (select l.job_id, {SCORE} as total_score, {COUNTS}, count(distinct bidder_file_id) as b, coalesce(bool_or(verdict = 'fail' and c.mandatory), false) as gone from latest l left join canon c on c.id = l.criterion_id group by 1) s on s.job_id = j.job_id""",
)
query("job_summary", "select * from summary", "jobs", "results", "criteria", extra=(LATEST, CANON, SUMMARY))(Q.job_summary)
query("resolved_ratio", """select job_id, p as resolved_percent, case when p >= 70 then 'High' when p >= 40 then 'Medium' else 'Low' end as level
      from (select job_id, cast(round(case when total_criteria = 0 then 0 else (pass_count + fail_count) / total_criteria end * 100) as bigint) as p
      from summary)""", "jobs", "results", "criteria", extra=(LATEST, CANON, SUMMARY))(
    lambda j, r, c: Q.resolved_ratio(Q.job_summary(j, r, c)))
query("category_scores", f"""select l.job_id, bidder_file_id, lower(criterion_type) as category, cast(round(cast(sum(cast(score as decimal(18,4))) as double) * 100 / count(*)) as bigint) as score,
      {COUNTS}, count(*) as total_count from latest l left join criteria c on c.id = l.criterion_id
      group by 1, 2, 3""", "results", "criteria", extra=(LATEST,))(Q.category_scores)
query("bidder_overview",
    f"""select l.job_id, bidder_file_id, {COUNTS}, count(*) as total_count, cast(round(cast(sum(cast(score as decimal(18,4))) as double) * 100 / count(*)) as bigint) as confidence_percent, count(*) filter (verdict = 'fail') = 0 as qualified,
    coalesce(array_to_string((list(label order by criterion_id) filter (verdict = 'fail'))[1:3], ', '), '') as failed_labels from latest l left join criteria c on c.id = l.criterion_id group by 1, 2""",
        "results", "criteria", extra=(LATEST,))(Q.bidder_overview)
query("job_bidder_counts",
    """select job_id, count(*) as evaluated, count(*) filter (not is_disqualified) as qualified, count(*) filter (is_disqualified) as disqualified, count(*) filter (not is_disqualified and unknown_count > 0) as uncertain
      from compared group by 1""", "results", "criteria", "files", extra=TO_COMPARED)(lambda r, c, f: Q.job_bidder_counts(Q.compare_bidders(r, c, f)))
query("score_bars", """select job_id, bidder_file_id, substr(regexp_replace(bidder_name, '\\.(pdf|docx?)$', '', 'i'), 1, 16) as name, cast(round(total_score * 100) as bigint) as percent
      from compared""", "results", "criteria", "files", extra=TO_COMPARED)(lambda r, c, f: Q.score_bars(Q.compare_bidders(r, c, f)))

ANY = ("anyx", "select * from extractions qualify row_number() over (partition by file_id, criterion_id order by extraction_confidence desc, created_at, id) = 1")
OCR = ("ocr", """select file_id, arg_max(q, (created_at, id)) as ocr_quality from (select *, try_cast(json_extract_string(details, '$.ocr_quality') as double) as q
      from audit_logs where action = 'ingestion_done') where q is not null group by 1""")
CLIP = "least(greatest({}, 0.0), 1.0)"
INSIGHT = (
    "insight",
    f"""select job_id, bidder_file_id, bidder_name, criterion_id, label, verdict, score, case when mandatory is null then 'medium' when mandatory then 'high' when weight >= 2 then 'medium' else 'low' end as importance, nf as not_found, extraction_confidence, parsed_value, page_number,
    round({CLIP.format(f"case when verdict in ('pass', 'fail') then score else coalesce(extraction_confidence, 0.2) + case when coalesce(ambiguous, false) then 0.1 else 0 end - case when threshold_value is not null and nf then 0.1 else 0 end - case when coalesce(length(source_snippet) > 0, false) then 0 else 0.05 end - 0.15 * (1 - {CLIP.format('coalesce(ocr_quality, 1.0)')}) end")}, 4) as review_confidence
    from (select l.*, coalesce(f.original_name, '') as bidder_name, c.label, c.mandatory, c.ambiguous, c.threshold_value, x.extraction_confidence, coalesce(x.not_found, true) as nf, x.source_snippet, x.page_number, x.parsed_value, o.ocr_quality
    from latest l left join criteria c on c.id = l.criterion_id left join files f on f.file_id = l.bidder_file_id left join anyx x on x.file_id = l.bidder_file_id and x.criterion_id = l.criterion_id left join ocr o on o.file_id = l.bidder_file_id)""",
)
TO_INSIGHT = (LATEST, ANY, OCR, INSIGHT)
query("best_extraction_any", "select * from anyx", "extractions", extra=(ANY,))(I.best_extraction_any)
query("ocr_quality_latest", "select * from ocr", "audit_logs", extra=(OCR,))(I.ocr_quality_latest)
query("ingestion_enrichment",
    """select f.file_id, f.job_id, original_name, try_cast(json_extract_string(details, '$.ocr_quality') as double) as ocr_quality, json_extract_string(details, '$.document_kind') as document_kind from files f
    left join (select * from audit_logs where action = 'ingestion_done' qualify row_number() over (partition by file_id order by created_at desc, id desc) = 1) a on a.file_id = f.file_id""",
        "files", "audit_logs")(I.ingestion_enrichment)
query("criterion_insights", "select * from insight", "results", "criteria", "files", "extractions", "audit_logs", extra=TO_INSIGHT)(I.criterion_insights)
query("review_queue",
    """select i.job_id, title, bidder_file_id, criterion_id, coalesce(review_confidence, extraction_confidence, score, 0) as confidence, case importance when 'high' then 'high' when 'medium' then 'normal' else 'low' end as priority
      from insight i join jobs j on j.job_id = i.job_id where verdict = 'unknown' and j.status = 'completed'""",
    "jobs", "results", "criteria", "files", "extractions", "audit_logs", extra=TO_INSIGHT)(lambda j, *t: I.review_queue(j, I.criterion_insights(*t)))
FLAGS = (
    "flags",
    """select job_id, 'empty_evaluation' as flag, 'critical' as severity, '' as detail from jobs where job_id not in (select job_id from latest)
    union all select job_id, 'high_unknown_ratio', 'warning', concat(u, '/', n) from (select job_id, count(*) filter (verdict = 'unknown') as u, count(*) as n from latest group by 1) where 2 * u > n
    union all select l.job_id, 'missing_numeric_thresholds', 'info', string_agg(distinct criterion_id, ',' order by criterion_id) from latest l join criteria c on c.id = l.criterion_id where verdict = 'unknown' and threshold_value is null group by 1""",
)
query("quality_flags", "select * from flags", "jobs", "results", "criteria", extra=(LATEST, FLAGS))(I.quality_flags)
query("dashboard", f"""select s.job_id, status, s.total_score, string_agg(case when r.job_id is not null then concat(coalesce(rank, {1 << 30}), ':', bidder_name) end, ','
      order by coalesce(rank, {1 << 30}), bidder_name, bidder_file_id nulls first) as bidders, (select count(*)
      from flags f where f.job_id = s.job_id) as n_flags from summary s left join ({RANKED}) r on r.job_id = s.job_id
      group by s.job_id, status, s.total_score""", "jobs", "results", "criteria", "files", extra=(*TO_COMPARED, SUMMARY, FLAGS))(
    lambda j, r, c, f: I.dashboard(j, r, c, f).select("job_id", "status", "total_score", F.array_join(F.transform("bidders", lambda b: F.concat(b["position"], F.lit(":"),
        b["bidder_name"])), ",").alias("bidders"), F.coalesce(F.size("flags"), F.lit(0)).cast("long").alias("n_flags")).withColumn("n_flags", F.greatest("n_flags", F.lit(0))))
query("evaluation_timeline", """select strftime(d, '%Y-%m-%d') as day, (select count(*) from results where cast(created_at as date) = d) as evaluations
      from (select cast(unnest(generate_series(date '1998-07-03', date '1998-08-01', interval 1 day)) as date) as d)""", "results")(lambda r: I.evaluation_timeline(r, "1998-08-01", 30))
query("verdict_distribution", "select verdict, case verdict when 'pass' then 1 when 'fail' then 2 else 3 end as position, count(*) as n from results group by 1", "results")(I.verdict_distribution)
query("trust_bands", """select job_id, case when score >= 0.85 then 'high' when score >= 0.6 then 'medium' else 'low' end as band, count(*) as n
      from latest group by 1, 2""", "results", extra=(LATEST,))(I.trust_bands)
query("score_histogram", """select b as bin, concat(b * 20, '-', b * 20 + 20) as range, (select count(*) from latest where least(floor(score * 100 / 20), 4) = b) as n
      from (values (0), (1), (2), (3), (4)) v(b)""", "results", extra=(LATEST,))(I.score_histogram)
query("score_trend",
    """select job_id, bidder_file_id, criterion_id, count(*) over w as position, cast(round(cast(sum(cast(score as decimal(18,4))) over w as double) * 100 / count(*) over w) as bigint) as running_percent
      from latest window w as (partition by job_id, bidder_file_id order by criterion_id rows unbounded preceding)""", "results", extra=(LATEST,))(I.score_trend)
query("display_extraction",
    """select * from extractions qualify row_number() over (partition by criterion_id, file_id order by not_found, extraction_confidence desc, created_at, id) = 1""",
    "extractions")(I.display_extraction)
query("list_jobs", "select * from jobs order by created_at desc, job_id limit 10 offset 5", "jobs")(lambda j: I.list_jobs(j, 5, 10))
query("search_jobs",
    """select * from jobs where contains(lower(title), 'a') and status in ('ingesting', 'extracting', 'evaluating') and created_at >= timestamp '2024-01-02' and created_at < timestamp '2024-01-21'""",
    "jobs")(lambda j: I.search_jobs(j, "A", "processing", "2024-01-02", "2024-01-20"))
query("job_duration_stats", """select round(avg(case when status = 'completed' then epoch(updated_at) - epoch(created_at) end), 4) as mean_seconds, count(*) filter (status in ('ingesting',
      'extracting', 'evaluating')) as active, count(*) as jobs from jobs""", "jobs")(I.job_duration_stats)
query("pending_reviews", """select * from (select job_id, criterion_id, row_number() over (partition by job_id order by criterion_id) as position, count(*) over (partition by job_id) as pending
      from (select distinct job_id, criterion_id from latest l where verdict = 'unknown' and not exists (select 1
      from reviews r where r.job_id = l.job_id and r.criterion_id = l.criterion_id))) where position <= 5""", "results", "reviews", extra=(LATEST,))(I.pending_reviews)
