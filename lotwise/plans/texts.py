"""Registered queries of documents, fields, retrieval, criteria, reviews, audit and checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import fields as X
from lotwise.functions import rules, text
from lotwise.operators import audit, criteria, documents, locate, quality, retrieval, review
from lotwise.plans.evaluation import COUNTS, LATEST, QUERIES, SCORE, SQL, query
from lotwise.operators.scratch import Scratch, running
from lotwise.sources import tables
from lotwise.streaming import jobs as streaming

CLEAN = "trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '[\\x{{00A0}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', ' ', 'g'), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: regexp_matches(x, '[A-Za-z0-9\\x{{0900}}-\\x{{097F}}]')), chr(10)), ' {{2,}}', ' ', 'g'))"
CLEANED = ("cleaned", f"select *, {CLEAN.format('text')} as clean from pages")
MEANS = (
    "means",
    """select file_id, count(*) as n_pages, avg(least(greatest(ocr_confidence, 0), 1)) as conf, avg(least(sharpness, 1)) as sharp, avg(least(length(trim(text, concat(' ', chr(10)))) / 1500, 1)) as density, avg(greatest(skew_abs_deg, 0)) as skew,
    avg(case when trim(text, concat(' ', chr(10))) = '' then 1.0 else 0.0 end) as empty, avg(case when length(trim(text, concat(' ', chr(10)))) < 100 then 1.0 else 0.0 end) as low, bool_or(ocr_confidence < 1) as scanned from pages group by 1""",
)
QUALITY = ("qualities",
    """select file_id, cast(round(cast(least(greatest(case when scanned then .5 * conf + .15 * sharp + .15 * density + .1 * (1 - least(skew / 5, 1)) + .05 * (1 - empty) + .05 * (1 - empty) else 1 - .25 * empty - .15 * low - .1 * (1 - density) end,
      0), 1) as decimal(18,10)), 4) as double) as ocr_quality from means""")
KINDS = ("kinds", "select file_id, case when avg(length(trim(text, concat(' ', chr(10))))) >= 50 then 'digital' else 'scanned' end as document_kind from pages where page_number <= 5 group by 1")
DOCS = ("docs", "select file_id, coalesce(string_agg(clean, chr(10) || chr(10) order by page_number) filter (clean <> ''), '') as raw_text, count(*) as page_count from cleaned group by 1")

query("clean_text", "select file_id, page_number, clean from cleaned", "pages", extra=(CLEANED,))(lambda p: p.select("file_id", "page_number", text.clean_text(F.col("text")).alias("clean")))
query("text_density", "select file_id, page_number, least(length(trim(text, concat(' ', chr(10)))) / 1500, 1) as density from pages",
    "pages")(lambda p: p.select("file_id", "page_number", text.text_density(F.col("text")).alias("density")))
query("document_kind", "select * from kinds", "pages", extra=(KINDS,))(documents.document_kind)
query("assemble_documents", "select file_id, raw_text, page_count, length(raw_text) as char_count from docs", "pages", extra=(CLEANED, DOCS))(documents.assemble_documents)
query("ingestion_warnings", """select file_id, 'EMPTY_PAGE' as code, page_number from pages where trim(text, concat(' ', chr(10))) = ''
      union all select file_id, 'EMPTY_DOCUMENT', null from pages group by file_id having bool_and(trim(text, concat(' ', chr(10))) = '')""", "pages")(documents.ingestion_warnings)
query("ocr_quality", "select * from qualities", "pages", extra=(MEANS, QUALITY))(documents.ocr_quality)
query("ocr_quality_breakdown", """select file_id, n_pages, case when scanned then 'scanned' else 'digital' end as branch, round(conf, 4) as conf, round(sharp, 4) as sharp, round(density,
      4) as density, round(skew, 4) as skew, round(empty, 4) as empty, round(low, 4) as low, round(1 - empty, 4) as coverage, 1500 as full_text_chars, 800.0 as sharpness_knee,
      5.0 as skew_saturation from means""", "pages", extra=(MEANS,))(documents.ocr_quality_breakdown)
query("ingestion_events", """select d.file_id, 'ingestion_done' as action, page_count as pages, length(raw_text) as chars, ocr_quality
      from docs d join qualities q on q.file_id = d.file_id""", "pages", extra=(CLEANED, DOCS, MEANS, QUALITY))(
    lambda p: documents.ingestion_events(documents.assemble_documents(p), documents.ocr_quality_breakdown(p), documents.ocr_quality(p)).select("file_id", "action",
        F.get_json_object("details", "$.page_count").cast("long").alias("pages"), F.get_json_object("details", "$.char_count").cast("long").alias("chars"),
        F.get_json_object("details", "$.ocr_quality").cast("double").alias("ocr_quality")))
WORDS = ("words", """select file_id, page_number, i as position, w as text, case when i % 7 = 0 then -1 else 40 + i % 60 end as conf
      from (select file_id, page_number, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as i
      from pages)""")
query("ocr_page_text", """select file_id, page_number, string_agg(text, ' ' order by position) as text, avg(conf / 100) as confidence
      from words where conf <> -1 and trim(text, concat(' ', chr(10))) <> '' group by 1, 2""", "pages", extra=(WORDS,))(
    lambda p: documents.ocr_page_text(p.select("file_id", "page_number", F.posexplode(F.split("text", " ")).alias("position", "text")).withColumn("conf",
        F.when(F.col("position") % 7 == 0, -1).otherwise(40 + F.col("position") % 60))))
query("table_rows_text", "select file_id, string_agg(concat(trim(cast(page_number as varchar)), ' | ', length(text)), chr(10) order by page_number) as table_text from pages group by 1", "pages")(
    lambda p: p.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.length("text").alias("n")))),
        lambda x: F.array(x["page_number"].cast("string"), x["n"].cast("string"))).alias("_r")).select("file_id", text.table_rows_text(F.col("_r")).alias("table_text")))
query("pick_page_text", """select file_id, page_number, case when length(substr(text, 1, 20 + page_number * 8)) < 30 and length(trim(text, concat(' ', chr(10)))) > length(substr(text,
      1, 20 + page_number * 8)) then trim(text, concat(' ', chr(10))) else substr(text, 1, 20 + page_number * 8) end as picked
      from pages""", "pages")(
    lambda p: p.select("file_id", "page_number", text.pick_page_text(F.substring(F.col("text"), F.lit(1), 20 + F.col("page_number") * 8), F.col("text")).alias("picked")))
query("normalize_chars", f"""select file_id, page_number, translate(text, '{text.ODD_CHARACTERS}', '{text.PLAIN_CHARACTERS.replace(chr(39), chr(39) * 2)}') as plain
      from pages""", "pages")(lambda p: p.select("file_id", "page_number", text.normalize_chars(F.col("text")).alias("plain")))
query("split_sentences", None, "pages")(lambda p: p.select("file_id", "page_number", F.size(text.split_sentences(F.col("text"))).alias("sentences")))
query("chunk_documents", None, "pages")(lambda p: documents.chunk_documents(documents.assemble_documents(p)))
query("estimate_page", None, "pages")(lambda p: documents.estimate_page(documents.chunk_texts(documents.assemble_documents(p)), p))

PAIRS = ("pairs",
    """select q.job_id, query_id, chunk_id, c.file_id, position, round(list_dot_product(cast(q.embedding as double[]), cast(c.embedding as double[])) / (sqrt(list_dot_product(cast(q.embedding as double[]),
      cast(q.embedding as double[]))) * sqrt(list_dot_product(cast(c.embedding as double[]), cast(c.embedding as double[])))), 4) as score
      from questions q join chunks c on c.job_id = q.job_id""")
query("topk_cosine", """select job_id, query_id, max(score) as best, count(*) as returned from (select * from pairs qualify row_number() over (partition by job_id, query_id
      order by score desc) <= 5) group by 1, 2""", "questions", "chunks", extra=(PAIRS,))(
    lambda q, c: retrieval.topk_cosine(q, c, decimals=4).groupBy("job_id", "query_id").agg(F.max("score").alias("best"), F.count("*").alias("returned")))
query("retrieve", """select job_id, query_id, count(*) as hits from (select * from pairs qualify row_number() over (partition by job_id, query_id
      order by score desc) <= 5) where score >= 0.3 group by 1, 2""", "questions", "chunks", extra=(PAIRS,))(lambda q, c: retrieval.retrieve(q, c, decimals=4).groupBy("job_id",
          "query_id").agg(F.count("*").alias("hits")))
query("bidder_context", """select job_id, query_id, file_id, count(*) as n from (select job_id, query_id, file_id, chunk_id, s, bool_or(s) over (partition by job_id, query_id, file_id) as has_some
      from (select *, row_number() over (partition by job_id, query_id order by score desc, position) <= 15 and score >= 0.15 as s
      from pairs)) where s or not has_some group by 1, 2, 3""", "questions", "chunks", extra=(PAIRS,))(
    lambda q, c: retrieval.bidder_context(q, c, c.select("job_id", "file_id").distinct(), decimals=4).groupBy("job_id", "query_id", "file_id").agg(F.count("*").alias("n")))
query("l2_normalize", "select chunk_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 4) as length, 1.0 as unit from chunks", "chunks")(
    lambda c: c.select("chunk_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 4).alias("length"),
        F.round(F.aggregate(retrieval.l2_normalize(F.col("embedding")), F.lit(0.0), lambda a, x: a + x * x), 4).alias("unit")))
query("embedding_batches", """select job_id, file_id, page_number as chunk_index, p as position, cast(floor(p / 100) as bigint) as batch, substr(text, 1, 6000) as text, concat('vector:',
      job_id, ':', p) as reference from (select *, row_number() over (partition by job_id order by file_id, page_number) - 1 as p
      from pages)""", "pages")(lambda p: retrieval.embedding_batches(p.withColumnRenamed("page_number", "chunk_index")))

#: Texts that hold fields: each customer's extraction values and amounts, told in prose.
TOLD = ("told",
    """select id, file_id, criterion_id, concat('Bidder ', file_id, '. Average Annual Turnover (3 years): Rs. ', page_number, '.25 Crore. GSTIN: 29AABCI1234F1Z5. ISO 9001:2015 certificate ', parsed_value, '. EPF Registration No. KA/', page_number, '00. The firm is not blacklisted. Total Completed Projects: ', page_number) as text from extractions where parsed_value is not null""")


def _told(x):
    said = F.concat(F.lit("Bidder "), "file_id", F.lit(". Average Annual Turnover (3 years): Rs. "), "page_number",
        F.lit(".25 Crore. GSTIN: 29AABCI1234F1Z5. ISO 9001:2015 certificate "), "parsed_value", F.lit(". EPF Registration No. KA/"), "page_number",
        F.lit("00. The firm is not blacklisted. Total Completed Projects: "), "page_number")
    return x.where("parsed_value is not null").select("id", "file_id", "criterion_id", said.alias("text"))


def _got(name: str):
    return lambda x: _told(x).select("id", F.col("text"), X.extract_field(F.lit(name), F.col("text")).alias("f")).select("id", "f.parsed_value", "f.confidence")


#: Of the phrases of denial, those that the given texts hold, in the order of the library's lists.
DENIED = "when contains(lower(text), 'does not hold') then 'does not hold' when contains(lower(text), 'not yet allotted') then 'not yet allotted'"
query("extract_turnover", "select id, regexp_extract(text, 'Rs\\. (\\d+\\.?\\d*) Crore', 1) as parsed_value, 0.85 as confidence from told", "extractions", extra=(TOLD,))(_got("annual_turnover"))
query("extract_gst", "select id, regexp_extract(text, '\\b\\d{2}[A-Z]{5}\\d{4}[A-Z][A-Z\\d]Z[A-Z\\d]\\b') as parsed_value, 0.9 as confidence from told", "extractions", extra=(TOLD,))(_got("gstin"))
query("extract_iso",
    f"""select id, case when contains(text, 'certificate expired') then 'expired' {DENIED} else 'valid' end as parsed_value, case when contains(text, 'certificate expired') then 0.95 when (case {DENIED} end) is not null then 0.92 else 0.9 end as confidence
      from told""", "extractions", extra=(TOLD,))(_got("iso_certificate"))
query("extract_epf", f"""select id, case {DENIED} else 'registered' end as parsed_value, case when (case {DENIED} end) is not null then 0.92 else 0.85 end as confidence
      from told""", "extractions", extra=(TOLD,))(_got("epf_esi"))
query("extract_blacklist", """select id, case when regexp_matches(text, '(?i)not\\s+(blacklisted|debarred|listed)') then 'not_blacklisted' end as parsed_value, 0.9 as confidence
      from told""", "extractions", extra=(TOLD,))(_got("blacklist"))
query("extract_projects", "select id, regexp_extract(text, '(?i)total completed projects: (\\d+)', 1) as parsed_value, 0.9 as confidence from told", "extractions",
    extra=(TOLD,))(_got("similar_projects"))
query("denial_override", f"select id, case {DENIED} end as phrase from told", "extractions", extra=(TOLD,))(lambda x: _told(x).select("id",
    X.denial_override(F.lit("iso_9001"), F.lit(None).cast("string"), F.col("text"))["phrase"].alias("phrase")))


def _model():
    return F.to_json(F.struct(F.array(F.struct(F.col("criterion_id").alias("field_name"), F.col("parsed_value").alias("raw_value"), "parsed_value", "source_snippet",
        F.col("extraction_confidence").alias("confidence"), "not_found")).alias("fields")))


MODELLED = ("modelled",
    """select id, criterion_id as field_name, case when lower(parsed_value) in ('none', 'null', '') then null else parsed_value end as parsed_value, (not_found or parsed_value is null or parsed_value = '') as not_found,
    case when not_found or parsed_value is null or parsed_value = '' then least(extraction_confidence, 0.2) when coalesce(source_snippet, '') = '' then least(extraction_confidence, 0.65) else extraction_confidence end as confidence from extractions""")


def _modelled(x):
    return criteria.parse_llm_fields(x.select(F.col("id").alias("file_id"), _model().alias("answer")), x.select(F.col("id").alias("file_id"), F.col("criterion_id").alias("field_name")))


query("parse_llm_fields", "select id as file_id, field_name, parsed_value, not_found, confidence from modelled", "extractions",
    extra=(MODELLED,))(lambda x: _modelled(x).select("file_id", "field_name", "parsed_value", "not_found", "confidence"))
query("merge_field_sources",
    """select id as file_id, m.field_name, case when e.page_number = 1 and e.parsed_value is not null then e.parsed_value when not m.not_found then m.parsed_value end as parsed_value,
    case when e.page_number = 1 and e.parsed_value is not null then 0.9 when not m.not_found then m.confidence else 0.2 end as confidence, not (e.page_number = 1 and e.parsed_value is not null) and m.not_found as not_found,
    case when e.page_number = 1 and e.parsed_value is not null then 'regex' when not m.not_found then 'model' end as model_used from modelled m join extractions e using (id)""",
        "extractions", extra=(MODELLED,))(
    lambda x: criteria.merge_field_sources(x.select(F.col("id").alias("file_id"), F.col("criterion_id").alias("field_name"), F.when(F.col("page_number") == 1,
        F.col("parsed_value")).alias("parsed_value"), F.lit(0.9).alias("confidence")), _modelled(x)))
query("build_prompts",
    """select p.job_id, p.file_id, c.k as criterion_id, length(concat('Field: ', c.label, chr(10), chr(10), 'Context:', chr(10))) + sum(length(p.text)) + 7 * (count(*) - 1) as prompt_chars
      from pages p join (select source, 'k1' as k, 'Turnover' as label from (select distinct source
      from documents)) c on c.source = p.job_id group by p.job_id, p.file_id, c.k, c.label""", "pages")(
    lambda p: criteria.build_prompts(p.withColumnRenamed("page_number", "chunk_index"), p.select("job_id").distinct().withColumns({"id": F.lit("k1"),
        "label": F.lit("Turnover")})).select("job_id", "file_id", "criterion_id", F.length("prompt").cast("long").alias("prompt_chars")))
query("build_criterion_prompts", None, "pages", "criteria")(
    lambda p, c: criteria.build_prompts(p.withColumnRenamed("page_number", "chunk_index").withColumn("job_id", F.regexp_replace("job_id", "^src", "j")), c))
#: Pairs of snippets and pages of their file, by the first tier that places the one in the other.
PLACED = (
    "placed",
    """select a.file_id, a.file_id || '-' || a.page_number as snippet_id, q.page_number as page, case when length(raw) >= 20 and contains(q.text, raw) then 0 when length(h80) >= 20 and contains(q.text, h80) then 3
      when length(h50) >= 20 and contains(q.text, h50) then 4 when length(low) >= 20 and contains(regexp_replace(lower(q.text), '\\s+', ' ', 'g'), low) then 5
      when len(words) >= 4 and len(list_filter(words, lambda w: contains(lower(q.text), w))) > 3 then 6 end as tier, len(list_filter(words, lambda w: contains(lower(q.text), w))) as hits
    from (select file_id, page_number, raw, trim(substr(raw, 1, 80), concat(' ', chr(10))) as h80, trim(substr(raw, 1, 50), concat(' ', chr(10))) as h50, regexp_replace(lower(substr(raw, 1, 60)), '\\s+', ' ', 'g') as low,
      regexp_extract_all(lower(raw), '[A-Za-z0-9]{4,}') as words from (select *, trim(substr(text, 101, 100), concat(' ', chr(10))) as raw from pages)) a join pages q on q.file_id = a.file_id""",
)
for snippets_query in ("resolve_snippet_page", "resolve_all_snippets"):
    query(snippets_query, """select p.file_id, p.file_id || '-' || p.page_number as snippet_id, arg_min(page, (tier, case when tier = 6 then -hits else 0 end, page)) filter (tier is not null) as page
      from pages p left join placed t on t.file_id = p.file_id and t.snippet_id = p.file_id || '-' || p.page_number group by 1, 2""", "pages", extra=(PLACED,))(
        lambda p: criteria.resolve_snippet_page(p.select("file_id", F.concat("file_id", F.lit("-"), "page_number").alias("snippet_id"), F.substring("text", 101,
            100).alias("snippet")), p.withColumns({"chunk_index": F.col("page_number"), "page": F.col("page_number")})))

query("locate_snippets", None, "pages")(lambda p: locate.locate_snippets(p.withColumn("snippet", F.substring("text", 101, 80))).select("file_id", "page_number", "start", "end", "tier"))



def _altered(p):
    """Pages with a snippet of theirs told with other spaces between words, within other words, or by one of its words alone."""
    middle, kind = F.substring("text", 101, 80), (F.col("page_number") + F.length("text")) % 3
    snippet = F.when(kind == 0, F.regexp_replace(middle, " +", "\u00a0 ")).when(kind == 1, F.concat(F.lit("As it says: "), middle, F.lit(" indeed")))
    return p.withColumn("snippet", snippet.otherwise(F.concat(F.lit("none of 0x7; "), F.regexp_extract(middle, "[A-Za-z]{6,}", 0), F.lit(" zzqxj"))))


query("locate_altered_snippets", None, "pages")(lambda p: locate.locate_snippets(_altered(p)).select("file_id", "page_number", "snippet", "start", "end", "tier"))

query("dedupe_criteria", "select * from criteria qualify row_number() over (partition by job_id, criterion_key order by created_at, id) = 1", "criteria")(criteria.dedupe_criteria)
query("duplicate_criteria", "select job_id, criterion_key, count(*) as n from criteria group by 1, 2 having count(*) > 1", "criteria")(quality.duplicate_criteria)
query("list_criteria", "select job_id, id, criterion_key, label, count(*) over (partition by job_id) as total from criteria", "criteria")(criteria.list_criteria)
query("canonical_key", """select id, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as key, threshold_value as threshold
      from criteria""", "criteria")(lambda c: c.select("id", rules.canonical_key(F.lit(None).cast("string"), F.col("label")).alias("key"),
          rules.parse_threshold(F.concat(F.lit("Rs "), F.col("threshold_value").cast("string"))).alias("threshold")))
query("parse_criteria_json", "select job_id, criterion_key, label, criterion_type, mandatory, threshold_value, operator, ambiguous from criteria", "criteria")(
    lambda c: criteria.parse_criteria_json(c.select("job_id", F.to_json(F.struct(F.array(F.struct(F.col("criterion_key").alias("id"), "label", "criterion_type",
        "mandatory", F.col("threshold_value").cast("string").alias("threshold_value"), "operator", "ambiguous")).alias("criteria"))).alias("answer"))))
query("reuse_criteria",
    """select job_id, owner, c.id as criterion_id, c.criterion_key from (select t.job_id, o.job_id as owner, row_number() over (partition by t.job_id order by o.created_at, o.id) as n
    from (select * from files where file_type = 'tender') t join (select f.job_id, f.checksum, m.created_at, m.id from files f join (select job_id, min(created_at) as created_at, arg_min(id, (created_at, id)) as id from criteria group by 1) m on m.job_id = f.job_id where f.file_type = 'tender') o on o.checksum = t.checksum and o.job_id <> t.job_id) r
    join (select job_id as owner_job, id, criterion_key from criteria) c on c.owner_job = r.owner where n = 1""", "files", "criteria")(criteria.reuse_criteria)
query("reuse_extractions",
    """select w.job_id, w.file_id, w.criterion_id, b.id as source_id, b.parsed_value, b.extraction_confidence from (select f.job_id, f.file_id, f.checksum, c.id as criterion_id, c.criterion_key from files f join criteria c on c.job_id = f.job_id where f.file_type = 'bidder') w
    join (select f.checksum, c.criterion_key, e.* from extractions e join files f on f.file_id = e.file_id join criteria c on c.id = e.criterion_id where not not_found qualify row_number() over (partition by f.checksum, c.criterion_key order by extraction_confidence desc, e.created_at, e.id) = 1) b on b.checksum = w.checksum and b.criterion_key = w.criterion_key
    where not exists (select 1 from extractions e where e.job_id = w.job_id and e.file_id = w.file_id and e.criterion_id = w.criterion_id)""", "files", "criteria",
        "extractions")(criteria.reuse_extractions)

query("accept_uploads", "select *, case when mime_type not in ('application/pdf') then 415 when size_bytes > 104857600 then 413 end as reason from files", "files")(tables.accept_uploads)
query("dedupe_uploads", """select *, first_value(file_id) over (partition by job_id, checksum order by created_at, file_id) as survivor, file_id <> first_value(file_id) over (partition by job_id,
      checksum order by created_at, file_id) as is_duplicate from files""", "files")(tables.dedupe_uploads)
query("reset_jobs", "select * from results where job_id not in (select job_id from jobs where status = 'evaluating')", "results", "jobs")(lambda r,
    j: tables.reset_jobs(r, j.where("status = 'evaluating'")))
query("job_reports", None, "jobs", "results", "criteria", "files")(lambda j, r, c, f: tables.job_reports(_dashboard(j, r, c, f), j))


def _dashboard(j, r, c, f):
    from lotwise.operators.insight import dashboard

    return dashboard(j, r, c, f)


def _chain(logs):
    return audit.append_chain(logs.select("id", "job_id", F.col("action").alias("action_type"), F.col("details").alias("payload"), "created_at"))


query("append_chain", None, "audit_logs")(_chain)
query("verify_chain", "select job_id, count(*) as total, true as chain_valid from audit_logs group by 1", "audit_logs")(lambda a: audit.verify_chain(_chain(a)))
query("failure_index", None, "audit_logs")(lambda a: audit.failure_index(_chain(a).withColumn("payload", F.when(F.col("id").endswith("00"), F.lit("{}")).otherwise(F.col("payload")))))
query("chain_stats", "select job_id, 'system' as category, count(*) as entries from audit_logs group by 1", "audit_logs")(lambda a: audit.chain_stats(_chain(a)))
query("search_audit", """select l.id, l.job_id, action as action_type, title from audit_logs l join jobs j on j.job_id = l.job_id
      where j.status = 'completed' and (contains(lower(action), 'scanned') or contains(lower(details), 'scanned') or contains(lower(title), 'scanned')) and l.created_at >= timestamp '2024-01-05' and l.created_at < timestamp '2024-01-21'""",
          "audit_logs", "jobs")(
    lambda a, j: audit.search_audit(_chain(a), j, "scanned", None, "2024-01-05", "2024-01-20").select("id", "job_id", "action_type", "title"))
query("audit_reports", None, "audit_logs")(lambda a: tables.audit_reports(_chain(a)))


def _numbered(r):
    """Newest results with numbers of all of them, in order of job and id, as ids."""
    rows = running(_latest(r).withColumn("_all", F.lit(0)), "_all", ["job_id", "id"], F.lit(1), "_n")
    return rows.withColumn("id", F.concat(F.lit("x"), "_n")).drop("_all", "_n")


NUMBERED_BY_JOB = ("numbered", "select concat('x', row_number() over (order by job_id, id) - 1) as rid, job_id, bidder_file_id, weight from latest")
query("apply_reviews",
    """select a.id as action_id, n.job_id, n.bidder_file_id, a.criterion_id, case when reviewer_action = 'reject' then concat('Reviewer REJECTED this criterion. Reason: ', coalesce(nullif(updated_value, ''), 'not provided'))
      when c.threshold_value is null then concat('Reviewer override applied with value=', coalesce(updated_value, 'None')) else concat('Reviewer provided updated value=', coalesce('''' || updated_value || '''', 'None'), '. Re-evaluated: [', c.label, '] ',
      case when c.ambiguous then 'Criterion is ambiguous — cannot evaluate deterministically' when updated_value is null then 'Value not found or not numeric in bidder document'
        else concat('extracted=', cast(updated_value as double), ' ', c.operator, ' threshold=', c.threshold_value, ' → ', case when (case c.operator when 'gt' then cast(updated_value as double) > c.threshold_value else cast(updated_value as double) >= c.threshold_value end) then 'PASS' else 'FAIL' end) end) end as explanation,
    case when reviewer_action = 'reject' then 'fail' when c.threshold_value is null then 'pass' when c.ambiguous or updated_value is null then 'unknown'
    when (case c.operator when 'gt' then cast(updated_value as double) > c.threshold_value else cast(updated_value as double) >= c.threshold_value end) then 'pass' else 'fail' end as verdict,
    case when reviewer_action = 'reject' then 0.0 when c.threshold_value is null then 1.0 when c.ambiguous or updated_value is null then 0.3 when (case c.operator when 'gt' then cast(updated_value as double) > c.threshold_value else cast(updated_value as double) >= c.threshold_value end) then 0.87 else 0.0 end as score
    from reviews a join numbered n on n.rid = a.evaluation_result_id join criteria c on c.id = a.criterion_id where reviewer_action <> 'approve'""", "reviews", "results",
        "criteria", extra=(LATEST, NUMBERED_BY_JOB))(
    lambda a, r, c: review.apply_reviews(a, _numbered(r), c)[0].select("action_id", "job_id", "bidder_file_id", "criterion_id", "verdict", "score", "explanation"))
query("review_errors", """select a.id as action_id, case when evaluation_result_id is null then 'no result id' else 'unknown result' end as error
      from reviews a left join numbered n on n.rid = a.evaluation_result_id where reviewer_action <> 'approve' and n.rid is null""", "reviews", "results", "criteria", extra=(LATEST, NUMBERED_BY_JOB))(
    lambda a, r, c: review.apply_reviews(a, _numbered(r), c)[1])
query("recalculate_decision",
    f"""select j.job_id, coalesce(status, 'PENDING') as status, coalesce(score, 0) as score, coalesce(pass_count, 0) as pass_count, coalesce(fail_count, 0) as fail_count, coalesce(unknown_count, 0) as unknown_count from (select job_id from jobs) j left join
    (select r.job_id, case when bool_or(verdict = 'fail' and coalesce(c.mandatory, true)) then 'DISQUALIFIED' else 'QUALIFIED' end as status, {SCORE} as score, {COUNTS} from (select * from results qualify row_number() over (partition by job_id, criterion_id order by created_at desc, id desc) = 1) r left join criteria c on c.id = r.criterion_id group by 1) s on s.job_id = j.job_id""",
    "jobs", "results", "criteria")(review.recalculate_decision)
query("latest_review", "select * from reviews qualify row_number() over (partition by job_id, criterion_id order by created_at desc, id desc) = 1", "reviews")(review.latest_review)
query("review_entries",
    """select r.id, r.job_id, j.title, r.criterion_id, c.label, f.original_name as bidder_name, count(*) filter (s = 'pending') over (partition by r.job_id) as pending, count(*) filter (s = 'resolved') over (partition by r.job_id) as resolved
    from (select *, case when score >= 0.3 then 'pending' else 'resolved' end as s from latest) r left join jobs j on j.job_id = r.job_id left join criteria c on c.id = r.criterion_id left join files f on f.file_id = r.bidder_file_id qualify s = 'pending'""",
        "results", "criteria", "files", "jobs", extra=(LATEST,))(
    lambda r, c, f, j: review.review_entries(_latest(r).withColumn("status", F.when(F.col("score") >= 0.3, "pending").otherwise("resolved")), c, f, j).select("id",
        "job_id", "title", "criterion_id", "label", "bidder_name", "pending", "resolved"))


def _latest(r):
    from lotwise.operators.compare import latest_results

    return latest_results(r)


query("diff_runs",
    """select job_id, criterion_id, verdict, side from (select job_id, criterion_id, verdict, 'left' as side from ((select job_id, criterion_id, verdict from latest) except all (select job_id, criterion_id, verdict from results)))
    union all select job_id, criterion_id, verdict, 'right' from ((select job_id, criterion_id, verdict from results) except all (select job_id, criterion_id, verdict from latest))""",
        "results", extra=(LATEST,))(
    lambda r: quality.diff_runs(_latest(r).select("job_id", "criterion_id", "verdict"), r.select("job_id", "criterion_id", "verdict")))
query("audit_evidence",
    """select e.job_id, count(*) as found, count(*) filter (source_snippet <> '') as with_snippet, count(*) filter (page_number is not null) as with_page, count(*) filter (page_number between 1 and 2) as page_in_range, count(*) filter (source_snippet <> '' and page_number = 1) as on_page
    from extractions e where not not_found group by 1""", "extractions")(
    lambda x: quality.audit_evidence(x, x.select("file_id").distinct().withColumn("page_count", F.lit(2)), x.select("file_id").distinct().select("file_id",
        F.lit(1).cast("long").alias("page_number"), F.concat(F.lit("A Snippet\n"), F.substring("file_id", 2, 20)).alias("text"))))
query("score_bounds", """select job_id, min(score) as least, max(score) as most, count(distinct score) as distinct_values, bool_and(score between 0 and 1) as in_bounds
      from results group by 1""", "results")(lambda r: quality.score_bounds(r, "job_id", "score"))


def _events_stream(spark, sf_dir):
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("created_at", F.col("ts").cast("timestamp"))


def _streamed(make, mode: str = "append"):
    """A query that runs a stream over events until all is read, and gives what its sink has."""
    def run(spark, sf_dir):
        scratch, stream = Scratch(spark, "stream"), make(_events_stream(spark, sf_dir))
        streaming.run_to_table(stream, f"{scratch.root}/rows", f"{scratch.root}/state", mode)
        return streaming.read_batches(spark, f"{scratch.root}/rows", stream.schema, newest=mode == "complete")

    return run


QUERIES["stream_daily_counts"] = _streamed(lambda e: streaming.stream_daily_counts(e.select("created_at")), "complete")
SQL["stream_daily_counts"] = "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1"
QUERIES["stream_closed_days"] = _streamed(lambda e: streaming.stream_daily_counts(e.select("created_at")))
SQL["stream_closed_days"] = """select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1
    having max(date_trunc('day', ts)) + interval 1 day <= (select max(ts) - interval 1 day from events)"""
QUERIES["stream_append_chain"] = _streamed(
    lambda e: streaming.stream_append_chain(e.select(F.concat(F.lit("l"), "event_id").alias("id"), F.concat(F.lit("j"), F.col("user_id") % 25).alias("job_id"),
        F.col("event_type").alias("action_type"), F.struct("value", "event_id", F.struct("event_type", "props").alias("about")).alias("payload"), "created_at")))
SQL["stream_append_chain"] = """with recursive said as (select concat('l', event_id) as id, concat('j', user_id % 25) as job_id, event_type as action_type, ts as created_at,
      concat('{"about": {"event_type": "', event_type, '", "props": ', coalesce('"' || replace(props, '"', '\\"') || '"', 'null'), '}, "event_id": ', event_id, ', "value": ', coalesce(cast(value as varchar), 'null'), '}') as payload from events),
    ordered as (select *, row_number() over (partition by job_id order by created_at, id) as n from said),
    links as (select *, sha256('GENESIS') as previous_hash, sha256(concat(sha256('GENESIS'), payload)) as current_hash from ordered where n = 1
      union all select o.*, l.current_hash, sha256(concat(l.current_hash, o.payload)) from links l join ordered o on o.job_id = l.job_id and o.n = l.n + 1)
    select id, job_id, action_type, payload, previous_hash, current_hash, created_at from links"""
