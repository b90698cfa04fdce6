"""Registered queries of what views, documents, retrieval, reviews and checks show in detail, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import fields, text
from lotwise.operators import audit, compare, criteria, documents, evaluate, insight, quality, retrieval, review
from lotwise.operators.scratch import Scratch
from lotwise.plans.evaluation import CANON, COUNTS, LATEST, RANKED, SCORE, SQL, SUMMARY, TO_COMPARED, TO_INSIGHT, TO_JUDGED, TOTALS, query
from lotwise.plans.texts import CLEANED, DOCS, KINDS, MEANS, MODELLED, NUMBERED_BY_JOB, QUALITY, _chain, _modelled, _numbered
from lotwise.sources import tables
from lotwise.sources.adapters import with_adapters

TRIM = "trim({0}, concat(' ', chr(10)))"

# ---- evaluation views ------------------------------------------------------------------------------------------------

BIDDERS = (
    "bidderview",
    f"""select l.job_id, l.bidder_file_id, max(f.original_name) as name, sum(cast(weighted_score as decimal(18,4))) as s,
      sum(cast(weight as decimal(18,4))) as t, {SCORE} as score, {COUNTS}, count(*) as total_count,
      coalesce(bool_or(verdict = 'fail' and mandatory), false) as gone,
      coalesce(string_agg(label, ';' order by label) filter (verdict = 'fail' and mandatory), '') as reasons
    from latest l left join criteria c on c.id = l.criterion_id left join files f on f.file_id = l.bidder_file_id group by 1, 2""",
)
query(
    "evaluation_bidders",
    """select job_id, row_number() over (partition by job_id order by coalesce(name, ''), coalesce(bidder_file_id, '')) as position, bidder_file_id,
      coalesce(name, 'Unknown') as bidder_name, case when gone then 'DISQUALIFIED' else 'QUALIFIED' end as status, score,
      pass_count, fail_count, unknown_count, total_count, reasons from bidderview""",
    "results", "criteria", "files", extra=(LATEST, BIDDERS),
)(lambda r, c, f: compare.evaluation_bidders(r, c, f).drop("total_weighted", "total_weight").withColumn("reasons", F.array_join("reasons", ";")))
query(
    "evaluation_view_all",
    """select j.job_id, coalesce(score, 0.0) as score, coalesce(pass_count, 0) as pass_count, coalesce(fail_count, 0) as fail_count,
      coalesce(unknown_count, 0) as unknown_count, coalesce(bidders, 0) as bidders, coalesce(v.status, 'PENDING') as status
    from (select * from jobs union all select 'none', '', 'pending', null, null) j left join (select job_id, coalesce(round(cast(sum(s) as double) / cast(sum(t) as double), 4), 0) as score,
      cast(sum(pass_count) as bigint) as pass_count, cast(sum(fail_count) as bigint) as fail_count, cast(sum(unknown_count) as bigint) as unknown_count,
      count(*) as bidders, case when bool_and(gone) then 'DISQUALIFIED' when bool_or(gone) then 'NEEDS_REVIEW' else 'QUALIFIED' end as status
      from bidderview group by 1) v on v.job_id = j.job_id""",
    "results", "criteria", "files", "jobs", extra=(LATEST, BIDDERS),
)(lambda r, c, f, j: compare.evaluation_view(r, c, f, j.select("job_id").unionByName(j.sparkSession.createDataFrame([("none",)], "job_id string"))))
query(
    "dashboard_criteria",
    """select s.job_id, s.status, count(i.job_id) as n, coalesce(string_agg(concat(criterion_id, ':', verdict, ':', importance, ':', cast(review_confidence as decimal(10,4))),
      ',' order by bidder_file_id nulls first, criterion_id) filter (i.job_id is not null), '') as criteria from summary s left join insight i on i.job_id = s.job_id group by 1, 2""",
    "jobs", "results", "criteria", "files", "extractions", "audit_logs", extra=(*TO_INSIGHT, CANON, SUMMARY),
)(
    lambda j, r, c, f, x, a: insight.dashboard(j, r, c, f, insight.criterion_insights(r, c, f, x, a)).select(
        "job_id", "status", F.coalesce(F.array_size("criteria"), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.array_join(F.transform("criteria", lambda x: F.concat_ws(":", x["criterion_id"], x["verdict"], x["importance"],
            x["review_confidence"].cast("decimal(10,4)").cast("string"))), ","), F.lit("")).alias("criteria"),
    )
)
query(
    "job_completion_metadata",
    """select *, concat('evaluation_complete=true,evaluation_fail=', fail_total, ',evaluation_pass=', pass_total, ',evaluation_unknown=', unknown_total, ',title=', job_id) as metadata from totals""",
    "criteria", "files", "extractions", extra=(*TO_JUDGED, TOTALS),
)(
    lambda c, f, x: evaluate.job_completion(
        evaluate.evaluate_jobs(c, f, x), f.select("job_id").distinct().withColumn("metadata", F.create_map(F.lit("title"), F.col("job_id"), F.lit("evaluation_pass"), F.lit("stale")))
    ).withColumn("metadata", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))
)
query("search_jobs_page", "select * from jobs where contains(lower(title), 'a') order by created_at, job_id limit 4 offset 4", "jobs")(lambda j: insight.search_jobs(j,
    "a", newest=False, page=1, size=4))
query("recent_jobs", "select * from jobs order by created_at desc, job_id limit 5", "jobs")(insight.recent_jobs)

# ---- documents -------------------------------------------------------------------------------------------------------

FAILED = "length(text) % 17 = 0"
BROKEN = (
    "broken",
    f"""select file_id, page_number, {FAILED} as failed, case when {FAILED} then '' else text end as text, case when {FAILED} then 0 else ocr_confidence end as ocr_confidence,
      case when {FAILED} then 0 else sharpness end as sharpness, case when {FAILED} then 0 else skew_abs_deg end as skew_abs_deg from pages""",
)


def _failing(p):
    return p.withColumn("failed", F.length("text") % 17 == 0)


query(
    "document_kinds",
    """select u.file_id, case when regexp_matches(original_name, '(?i)[.]png$') then 'image' when regexp_matches(original_name, '(?i)[.]pdf$') then document_kind end as document_kind,
      case when regexp_matches(original_name, '(?i)[.]docx$') then 'UNSUPPORTED_FILE_TYPE' when regexp_matches(original_name, '(?i)[.]pdf$') and document_kind is null then 'PDF_EMPTY' end as error
    from uploads u left join kinds k on k.file_id = u.file_id""",
    "uploads", "pages", extra=(KINDS,),
)(documents.document_kinds)
query(
    "page_warnings",
    f"""select file_id, 'OCR_PAGE_FAILED' as code, page_number from broken where failed
    union all select b.file_id, 'EMPTY_PAGE', page_number from broken b join kinds k on k.file_id = b.file_id where document_kind = 'digital' and not failed and {TRIM.format('text')} = ''
    union all select file_id, 'EMPTY_DOCUMENT', null from broken group by file_id having bool_and({TRIM.format('text')} = '')""",
    "pages", extra=(KINDS, BROKEN),
)(lambda p: documents.ingestion_warnings(_failing(p), documents.document_kind(p)))
query("ocr_quality_failed_pages", "select * from qualities", "pages", extra=(BROKEN, (MEANS[0], MEANS[1].replace("from pages", "from broken")),
    QUALITY))(lambda p: documents.ocr_quality(documents.with_failed_pages(_failing(p))))
query(
    "ocr_quality_by_kind", "select * from qualities", "pages",
    extra=(KINDS, ("allmeans", MEANS[1]), ("means", "select m.* replace (k.document_kind <> 'digital' as scanned) from allmeans m join kinds k on k.file_id = m.file_id"), QUALITY),
)(lambda p: documents.ocr_quality(p, documents.document_kind(p)))
query(
    "table_rows_blank_cells",
    """select file_id, page_number, concat('a |  | ', regexp_replace(substr(text, 1, 3), '^\\s+|\\s+$', '', 'g'), chr(10), ' | ', page_number) as table_text from pages""",
    "pages",
)(
    lambda p: p.select("file_id", "page_number", text.table_rows_text(F.array(
        F.array(F.lit(" a "), F.lit(None).cast("string"), F.substring("text", 1, 3)), F.array(F.lit(" \n"), F.col("page_number").cast("string")))).alias("table_text"))
)
query("chain_categories", "select job_id, case when action in ('click', 'purchase') then 'review' else 'system' end as category, count(*) as entries from audit_logs group by 1, 2", "audit_logs")(
    lambda a: audit.chain_stats(a.withColumn("action_type", F.when(F.col("action") == "click", "Reviewer_APPROVE").when(F.col("action") == "purchase", "rejected").otherwise(F.col("action")))))
query(
    "ingestion_event_counts",
    f"""select d.file_id, page_count as pages, page_count as chunks, coalesce(w.n, 0) as warnings, round(m.density, 4) as density, ocr_quality, k.document_kind
    from docs d join qualities q on q.file_id = d.file_id join means m on m.file_id = d.file_id left join kinds k on k.file_id = d.file_id
    left join (select file_id, count(*) as n from pages where {FAILED} group by 1) w on w.file_id = d.file_id""",
    "pages", extra=(CLEANED, DOCS, MEANS, QUALITY, KINDS),
)(
    lambda p: documents.ingestion_events(
        documents.assemble_documents(p), documents.ocr_quality_breakdown(p), documents.ocr_quality(p), p, _failing(p).where("failed"), documents.document_kind(p)
    ).select(
        "file_id", *(F.get_json_object("details", f"$.{k}").cast(t).alias(name) for k, t, name in (
            ("page_count", "long", "pages"), ("chunk_count", "long", "chunks"), ("warning_count", "long", "warnings"), ("ocr_quality_breakdown.density", "double", "density"),
            ("ocr_quality", "double", "ocr_quality"), ("document_kind", "string", "document_kind"))),
    )
)
SENTENCES = """list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z\\x{0900}-\\x{097F}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"""
SQL["split_sentences"] = with_adapters(f"select file_id, page_number, len({SENTENCES}) as sentences from pages")
query(
    "sentences",
    """select file_id, page_number, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as position from (select file_id, page_number,
      list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z\\x{0900}-\\x{097F}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as s from pages)""",
    "pages",
)(lambda p: p.select("file_id", "page_number", F.posexplode(text.split_sentences(F.col("text"))).alias("position", "sentence")))
query(
    "estimate_text_pages",
    """select p.file_id, p.page_number as chunk_index, coalesce((select min(q.page_number) from pages q where q.file_id = p.file_id and contains(q.text, substr(p.text, 31, 100)) and substr(p.text, 31, 100) <> ''), 1) as page from pages p""",
    "pages",
)(lambda p: documents.estimate_page(p.select("file_id", F.col("page_number").alias("chunk_index"), F.substring("text", 31, 200).alias("text")), p))

# ---- retrieval -------------------------------------------------------------------------------------------------------

DOT = "list_dot_product(cast({0} as double[]), cast({1} as double[]))"
COSINE = f"round({DOT.format('q.embedding', 'c.embedding')} / (sqrt({DOT.format('q.embedding', 'q.embedding')}) * sqrt({DOT.format('c.embedding', 'c.embedding')})), 6)"


def _pairs(chunks: str) -> tuple[str, str]:
    return "scored", f"select q.job_id, q.query_id, c.chunk_id, c.file_id, c.position, {COSINE} as score from questions q join {chunks} c on c.job_id = q.job_id"


def _ranked(k: int) -> tuple[str, str]:
    return "ranked", f"""select *, count(*) over (partition by job_id, query_id) as total_searched from
      (select *, row_number() over (partition by job_id, query_id order by score desc, position) as rank from scored) where rank <= {k}"""


def _worded(c):
    return c.withColumns({"text": F.concat(F.lit("text of "), "chunk_id"), "page": F.col("position") % 9 + 1})


for name, table in (("topk_chunks", "chunks"), ("topk_tied_chunks", "tied_chunks")):
    query(name, "select job_id, query_id, chunk_id, position, rank, total_searched from ranked", "questions", table, extra=(_pairs(table), _ranked(5)))(
        lambda q, c: retrieval.topk_cosine(q, c).select("job_id", "query_id", "chunk_id", "position", "rank", "total_searched"))
query("topk_pruned_chunks", "select job_id, query_id, chunk_id, position, rank, total_searched from ranked", "questions", "chunks", extra=(_pairs("chunks"), _ranked(5)))(
    lambda q, c: retrieval.topk_pruned(q, c).select("job_id", "query_id", "chunk_id", "position", "rank", "total_searched"))
query(
    "retrieve_chunks",
    "select job_id, query_id, chunk_id, rank, total_searched, file_id, concat('text of ', chunk_id) as text, position % 9 + 1 as page from ranked where score >= 0.1 and not ends_with(query_id, '300')",
    "questions", "chunks", extra=(_pairs("chunks"), _ranked(5)),
)(lambda q, c: retrieval.retrieve(q.withColumn("text", F.when(F.col("query_id").endswith("300"), " \n").otherwise("asked")), _worded(c), 5, 0.1).drop("score", "position"))
query("blank_queries", "select job_id, query_id, 'EMPTY_QUERY' as error from questions where ends_with(query_id, '300')", "questions")(
    lambda q: retrieval.blank_queries(q.withColumn("text", F.when(F.col("query_id").endswith("300"), F.lit(None).cast("string")).otherwise("asked"))))
CONTEXTS = (
    "contexts",
    """select job_id, query_id, file_id, string_agg(concat('text of ', chunk_id), concat(chr(10), chr(10), '---', chr(10), chr(10)) order by place) as context from (
      select w.job_id, w.query_id, w.file_id, c.chunk_id, case when h.rank is null then c.position else h.rank end as place, h.rank is not null as hit, bool_or(h.rank is not null) over (partition by w.job_id, w.query_id, w.file_id) as any_hit
      from (select q.job_id, q.query_id, f.file_id from questions q join (select distinct job_id, file_id from chunks) f on f.job_id = q.job_id) w join chunks c on c.job_id = w.job_id and c.file_id = w.file_id
      left join (select * from ranked where score >= 0.15) h on h.job_id = w.job_id and h.query_id = w.query_id and h.chunk_id = c.chunk_id) where hit or not any_hit group by 1, 2, 3""",
)
query("context_texts", "select * from contexts", "questions", "chunks", extra=(_pairs("chunks"), _ranked(15), CONTEXTS))(
    lambda q, c: retrieval.context_texts(retrieval.bidder_context(q, c, c.select("job_id", "file_id").distinct()), _worded(c)))
query(
    "retrieved_prompts",
    """select job_id, file_id, query_id as criterion_id, concat('Field: Criterion ', query_id, case when ends_with(query_id, '200') then concat(chr(10), 'As in part two.') else '' end, chr(10), chr(10), 'Context:', chr(10), context) as prompt from contexts""",
    "questions", "chunks", extra=(_pairs("chunks"), _ranked(15), CONTEXTS),
)(
    lambda q, c: criteria.build_retrieved_prompts(
        retrieval.bidder_context(q, c, c.select("job_id", "file_id").distinct()), _worded(c), q.select("job_id", F.col("query_id").alias("id"), F.lit("bond").alias("criterion_key"),
            F.concat(F.lit("Criterion "), "query_id").alias("label"), F.when(F.col("query_id").endswith("200"), "As in part two.").alias("description"))))

# ---- fields ----------------------------------------------------------------------------------------------------------

query(
    "merge_with_fallback",
    """select id as file_id, m.field_name, case when e.page_number = 1 and e.parsed_value is not null then e.parsed_value when not m.not_found then m.parsed_value when e.page_number = 2 then 'again' end as parsed_value,
      case when e.page_number = 1 and e.parsed_value is not null then 0.9 when not m.not_found then m.confidence when e.page_number = 2 then 0.85 else 0.2 end as confidence,
      not (e.page_number = 1 and e.parsed_value is not null) and m.not_found and e.page_number <> 2 as not_found,
      case when e.page_number = 1 and e.parsed_value is not null then 'regex' when not m.not_found then 'model' when e.page_number = 2 then 'regex-fallback' end as model_used
    from modelled m join extractions e using (id)""",
    "extractions", extra=(MODELLED,),
)(
    lambda x: criteria.merge_field_sources(
        x.select(F.col("id").alias("file_id"), F.col("criterion_id").alias("field_name"), F.when(F.col("page_number") == 1, F.col("parsed_value")).alias("parsed_value"),
            F.lit(0.9).alias("confidence")),
        _modelled(x), x.where("page_number = 2").select(F.col("id").alias("file_id"), F.col("criterion_id").alias("field_name"), F.lit("again").alias("parsed_value"), F.lit(0.85).alias("confidence")))
)

#: Texts in several wordings, so that every pattern of the field families comes to pass: n is 0 to 19, v is the amount.
WORDED = (
    "worded",
    """select id, n, v, case n % 5 when 0 then concat('3-year average: Rs. ', v, '.25 Crore') when 1 then concat('FY 2021-22: Rs. ', v, '.5 Crore, FY 2022-23: Rs. ', v + 2, '.5 Cr.')
        when 2 then concat('The annual turnover was ', v, '.75 crore.') when 3 then concat('About ', v, '50 lakhs a year.') else 'No figures.' end as money,
      case n % 4 when 0 then case n % 8 when 0 then concat(v, ' qualifying similar projects. Qualifying projects: ', v + 1) else concat('Qualifying projects: ', v, ' (in words). Elsewhere ', v + 1, ' qualifying projects.') end when 1 then concat('Total projects completed: ', v) when 2 then concat('Road Rs. 3.', v, ' crore in 2021', chr(10), 'Dam Rs. 3.', v, ' Cr. May', chr(10), 'Well Rs. 1.5 crore 2020', chr(10), 'Fort 7.5 Crore June') else 'none' end as work,
      case n % 5 when 0 then 'ISO 9001 certificate. Status' || chr(10) || 'EXPIRED' when 1 then 'ISO9001 EXPIRED: 2020' when 2 then 'ISO 9001 audit under process; it is not held' when 3 then 'ISO 9001 held' else 'quality manual' end as norm,
      case n % 4 when 0 then 'EPF number KA/123, not yet allotted' when 1 then 'ESI reg 77; application PENDING' when 2 then 'PF code MH/1' else 'none' end as fund,
      case n % 3 when 0 then 'Work is pending since May and not held' when 1 then 'The certificate is Not Yet Issued; it is not held' else 'All in order.' end as denial
    from (select id, cast(round(extraction_confidence * 100) as int) - 80 as n, page_number as v from extractions)""",
)
#: Written out here, apart from the library's own lists.
REGEX_DENIALS = (
    "does not hold", "do not hold", "not held", "not hold", "not yet allotted", "not yet been allotted", "not yet issued", "not yet been issued", "not yet certified",
        "not yet registered", "not currently certified",
    "not currently registered", "not registered", "no valid certificate", "no certification", "status: not held", "status: not registered", "certification status: not",
        "registration status: not", "application pending", "under process",
)
SNIPPET_DENIALS = (
    "does not hold", "do not hold", "not yet allotted", "not yet been allotted", "not yet issued", "not yet been issued", "not yet certified", "not yet registered",
        "not currently certified", "not currently registered", "not held",
    "not hold", "not registered", "no valid certificate", "no certification", "certification status: not", "status: not held", "status: not registered",
        "registration status: not", "application pending", "under process", "pending since",
)


def first_of(column: str, phrases: tuple[str, ...]) -> str:
    """SQL of the first phrase in list order that a column holds."""
    return "case " + " ".join(f"when contains(lower({column}), '{p}') then '{p}'" for p in phrases) + " end"


def _worded_field(column: str, name: str):
    """The field of a name in a column of WORDED, which Spark runs as it stands."""
    def get(x):
        rows = x.sparkSession.sql(WORDED[1].replace("from extractions", "from {extractions}").replace("chr(", "char("), extractions=x)
        return rows.select("id", fields.extract_field(F.lit(name), F.col(column)).alias("f")).select("id", "f.parsed_value", "f.confidence", "f.snippet")

    return get


query(
    "extract_worded_turnover",
    """select id, case n % 5 when 0 then concat(v, '.25') when 1 then concat(v + 1, '.5') when 2 then concat(v, '.75') when 3 then concat(v, '.5') end as parsed_value, case when n % 5 < 4 then 0.85 end as confidence,
      case n % 5 when 0 then money when 1 then concat('FY values: [', v, '.5, ', v + 2, '.5] -> avg ', v + 1, '.5 Crore') when 2 then substr(money, 5) when 3 then money end as snippet from worded""",
    "extractions", extra=(WORDED,),
)(_worded_field("money", "annual_turnover"))
query(
    "extract_worded_projects",
    """select id, case n % 4 when 2 then '2' when 3 then null else cast(v as varchar) end as parsed_value, case n % 4 when 0 then 0.92 when 1 then 0.9 when 2 then 0.8 end as confidence,
      case n % 4 when 0 then concat('Qualifying projects: ', v) when 1 then concat('Total completed projects: ', v) when 2 then concat('Projects >= 2 Cr near dates: [3.', v, ', 7.5]') end as snippet from worded""",
    "extractions", extra=(WORDED,),
)(_worded_field("work", "similar_projects"))
query(
    "extract_worded_iso",
    f"""select id, case when n % 5 < 2 then 'expired' when n % 5 < 4 then coalesce({first_of('norm', REGEX_DENIALS)}, 'valid') end as parsed_value,
      case when n % 5 < 2 then 0.95 when n % 5 = 2 then 0.92 when n % 5 = 3 then 0.9 end as confidence, case n % 5 when 0 then substr(norm, 3) when 4 then null else norm end as snippet from worded""",
    "extractions", extra=(WORDED,),
)(_worded_field("norm", "iso_9001"))
query(
    "extract_worded_epf",
    f"""select id, case when n % 4 < 3 then coalesce({first_of('fund', REGEX_DENIALS)}, 'registered') end as parsed_value, case n % 4 when 0 then 0.92 when 1 then 0.92 when 2 then 0.85 end as confidence,
      case when n % 4 < 3 then fund end as snippet from worded""",
    "extractions", extra=(WORDED,),
)(_worded_field("fund", "epf_esi"))
query("override_worded", f"select id, {first_of('denial', SNIPPET_DENIALS)} as phrase, case when n % 3 < 2 then denial end as evidence from worded", "extractions", extra=(WORDED,))(
    lambda x: x.sparkSession.sql(WORDED[1].replace("from extractions", "from {extractions}").replace("chr(", "char("), extractions=x)
    .select("id", fields.denial_override(F.lit("iso_9001"), F.lit("nothing here"), F.col("denial")).alias("d")).select("id", "d.phrase", "d.evidence"))

# ---- reviews, audit, checks ------------------------------------------------------------------------------------------

query("review_history", "select id, job_id, criterion_id, reviewer_action, row_number() over (partition by job_id, criterion_id order by created_at, id) as position from reviews", "reviews")(
    lambda r: review.review_history(r).select("id", "job_id", "criterion_id", "reviewer_action", "position"))
STATED = ("stated", "select *, case when score >= 0.3 then 'pending' else 'resolved' end as status from latest")
query(
    "review_entries_page",
    """select e.id, e.job_id, j.title, j.updated_at as job_updated_at, e.criterion_id, c.criterion_key, c.label, c.mandatory, f.original_name as bidder_name, e.status, e.created_at, n.pending, n.resolved
    from (select * from stated where status = 'resolved' order by created_at desc, id desc limit 20 offset 10) e left join criteria c on c.id = e.criterion_id left join files f on f.file_id = e.bidder_file_id
    left join jobs j on j.job_id = e.job_id join (select job_id, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'resolved') as resolved from stated group by 1) n on n.job_id = e.job_id""",
    "results", "criteria", "files", "jobs", extra=(LATEST, STATED),
)(
    lambda r, c, f, j: review.review_entries(compare.latest_results(r).withColumn("status", F.when(F.col("score") >= 0.3, "pending").otherwise("resolved")), c, f, j, "resolved", 10, 20)
)
PAYLOADS = (
    "payloads",
    """select a.id, a.job_id, a.created_at, concat('{"actor": null, "criterion_id": "', criterion_id, '", "evaluation_result_id": ', coalesce('"' || evaluation_result_id || '"', 'null'),
      ', "new_result_id": ', case when reviewer_action <> 'approve' and n.rid is not null then concat('"', a.id, '"') else 'null' end, ', "original_value": null, "reason": null, "reviewer_action": "', reviewer_action,
      '", "updated_value": ', coalesce('"' || updated_value || '"', 'null'), '}') as payload from reviews a left join numbered n on n.rid = a.evaluation_result_id""",
)
query(
    "review_chain", "select job_id, id, payload, previous_hash, current_hash from links", "reviews", "results", "criteria",
    extra=(
        LATEST, NUMBERED_BY_JOB, PAYLOADS, ("ordered", "select *, row_number() over (partition by job_id order by created_at, id) as n from payloads"),
        ("links", """select job_id, 1 as n, id, payload, sha256('GENESIS') as previous_hash, sha256(concat(sha256('GENESIS'), payload)) as current_hash from ordered where n = 1
        union all select o.job_id, l.n + 1, o.id, o.payload, l.current_hash, sha256(concat(l.current_hash, o.payload)) from links l join ordered o on o.job_id = l.job_id and o.n = l.n + 1"""),
    ),
)(
    lambda a, r, c: audit.append_chain(review.review_entries_for_chain(a, review.apply_reviews(a, _numbered(r), c)[0])).select("job_id", "id", "payload", "previous_hash", "current_hash")
)
SQL["review_chain"] = SQL["review_chain"].replace("with ", "with recursive ", 1)
query(
    "pending_reviews_open",
    """select * from (select job_id, criterion_id, row_number() over (partition by job_id order by criterion_id) as position, count(*) over (partition by job_id) as pending
      from (select distinct job_id, criterion_id from latest l where verdict = 'unknown' and not exists (select 1 from reviews r
      where r.job_id = l.job_id and r.criterion_id = l.criterion_id and reviewer_action = 'edit' and updated_value is null))) where position <= 5""",
    "results", "reviews", extra=(LATEST,),
)(lambda r, a: insight.pending_reviews(r, a.where("reviewer_action = 'edit' and updated_value is null")))
WITH_STORED = (
    "withstored",
    """select g.job_id, g.bidder_file_id, g.mandatory, coalesce(l.verdict, g.verdict) as verdict, coalesce(l.score, g.score) as score, l.id is null as fresh
    from judged g left join latest l on l.job_id = g.job_id and l.criterion_id = g.criterion_id and l.bidder_file_id = g.bidder_file_id where g.bidder_file_id is not null""",
)
query(
    "decisions_with_stored",
    f"""select d.*, fresh from (select job_id, bidder_file_id, case when bool_or(verdict = 'fail' and mandatory) then 'DISQUALIFIED' else 'QUALIFIED' end as status, round(cast(sum(cast(score as decimal(18,4))) as double) / count(*), 4) as score,
      round(cast(sum(cast(score as decimal(18,4))) as double), 4) as total_weighted, cast(count(*) as double) as total_weight, {COUNTS} from withstored group by 1, 2) d
    join (select job_id, bidder_file_id, count(*) filter (fresh) as fresh from withstored group by 1, 2) using (job_id, bidder_file_id)""",
    "criteria", "files", "extractions", "results", extra=(*TO_JUDGED, LATEST, WITH_STORED),
)(lambda c, f, x, r: _decided(evaluate.evaluate_with_stored(c, f, x, r)))


def _decided(rows):
    keys = ["job_id", "bidder_file_id"]
    return evaluate.final_decision(rows).join(rows.groupBy(*keys).agg(F.count_if("fresh").alias("fresh")), keys)


def _ranks_from_layout(r, c, f):
    """Results laid out by job and bidder first, then ranked as they lie."""
    spark, scratch = r.sparkSession, Scratch(r.sparkSession, "layout")
    name = scratch.root.rsplit("/", 1)[1].replace("-", "_")
    tables.write_laid_out(r, name, f"{scratch.root}/results")
    return compare.rank_bidders(compare.compare_bidders(tables.read_laid_out(spark, name), c, f))


query("ranks_from_layout", RANKED, "results", "criteria", "files", extra=TO_COMPARED)(_ranks_from_layout)
query("dashboard_pieces", None, "jobs", "results", "criteria", "files", "extractions", "audit_logs")(
    lambda j, r, c, f, x, a: tables.dashboard_pieces(j, r, c, f, insight.criterion_insights(r, c, f, x, a)))
query("audit_action_types", "select distinct action as action_type from audit_logs where job_id in (select job_id from jobs where status = 'completed')", "audit_logs", "jobs")(
    lambda a, j: audit.audit_action_types(a.withColumnRenamed("action", "action_type"), j))
query(
    "append_chain_hashes",
    """select job_id, id, previous_hash, current_hash from links""", "audit_logs",
    extra=(
        ("ordered", "select *, row_number() over (partition by job_id order by created_at, id) as n from audit_logs"),
        ("links", """select job_id, 1 as n, id, sha256('GENESIS') as previous_hash, sha256(concat(sha256('GENESIS'), details)) as current_hash from ordered where n = 1
        union all select o.job_id, l.n + 1, o.id, l.current_hash, sha256(concat(l.current_hash, o.details)) from links l join ordered o on o.job_id = l.job_id and o.n = l.n + 1"""),
    ),
)(lambda a: _chain(a).select("job_id", "id", "previous_hash", "current_hash"))
SQL["append_chain_hashes"] = SQL["append_chain_hashes"].replace("with ", "with recursive ", 1)
SQL["append_chain"] = SQL["append_chain_hashes"].replace("select job_id, id, previous_hash, current_hash from links",
    "select id, job_id, action as action_type, details as payload, previous_hash, current_hash, created_at from links join audit_logs using (job_id, id)")
query("verify_broken_chain", "select job_id, count(*) as total, not bool_or(ends_with(id, '00')) as chain_valid from audit_logs group by 1", "audit_logs")(
    lambda a: audit.verify_chain(_chain(a).withColumn("payload", F.when(F.col("id").endswith("00"), F.lit("{}")).otherwise(F.col("payload")))))
query(
    "run_signature",
    """select l.job_id, criterion_key, label, original_name as bidder_name, verdict, score, weight, weighted_score, explanation from latest l left join criteria c on c.id = l.criterion_id left join files f on f.file_id = l.bidder_file_id""",
    "results", "criteria", "files", extra=(LATEST,),
)(quality.run_signature)
query(
    "evidence_mismatches",
    """select * from (select job_id, row_number() over (partition by job_id order by created_at, id) as position, id, file_id, page_number, substr(source_snippet, 1, 50) as snippet
    from extractions where not not_found and page_number between 1 and 2 and not (page_number = 1 and source_snippet <> '')) where position <= 5""",
    "extractions",
)(
    lambda x: quality.evidence_mismatches(
        x, x.select("file_id").distinct().withColumn("page_count", F.lit(2)),
        x.select("file_id").distinct().select("file_id", F.lit(1).cast("long").alias("page_number"), F.concat(F.lit("A Snippet\n"), F.substring("file_id", 2, 20)).alias("text")))
)
