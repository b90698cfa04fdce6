"""Reference-shaped tables from the given tables, as SQL that Spark and DuckDB both run.

One text serves both sides; Spark gets it with DataFrames for table names, the oracle as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Given tables that adapters read.
GIVEN = ("nation", "customer", "orders", "lineitem", "events", "documents", "embeddings")

ADAPTERS: dict[str, str] = {
    "jobs": """
        select concat('j', n_nationkey) as job_id, n_name as title,
               case n_nationkey % 6 when 0 then 'pending' when 1 then 'ingesting' when 2 then 'extracting' when 3 then 'evaluating' else 'completed' end as status,
               make_timestamp(2024, 1, 1 + cast(n_nationkey % 28 as int), cast(n_nationkey % 24 as int), 0, 0) as created_at,
               make_timestamp(2024, 2, 1 + cast(n_nationkey % 28 as int), cast(n_nationkey % 24 as int), 30, 0) as updated_at
        from nation""",
    "files": """
        select concat('f', c_custkey) as file_id, concat('j', c_nationkey) as job_id, concat(c_name, '.pdf') as original_name, 'bidder' as file_type,
               md5(concat(c_mktsegment, c_custkey % 40)) as checksum, c_custkey * 1000000 as size_bytes,
               case c_custkey % 11 when 0 then 'image/gif' else 'application/pdf' end as mime_type,
               make_timestamp(2024, 1, 1 + cast(c_custkey % 28 as int), cast(c_custkey % 24 as int), 0, 0) as created_at
        from customer where c_nationkey <> 24
        union all
        select concat('t', n_nationkey), concat('j', n_nationkey), concat('tender-', n_nationkey, '.pdf'), 'tender', md5(concat('tender', n_regionkey)), 5000, 'application/pdf',
               make_timestamp(2024, 1, 1, cast(n_nationkey % 24 as int), 0, 0)
        from nation""",
    "criteria": """
        select concat('c', n_nationkey, '_', k) as id, concat('j', n_nationkey) as job_id, criterion_key, label, criterion_type, mandatory, threshold_value, operator,
               (n_nationkey % 7 = 0 and k = 4) as ambiguous, make_timestamp(2024, 1, 2, 0, cast(k as int), 0) as created_at
        from nation cross join (values
            (1, 'turnover', 'Annual Turnover', 'Financial', true, 5.0e0, 'gte'), (2, 'projects', 'Similar Projects', 'Technical', true, 2.0e0, 'gt'),
            (3, 'gst', 'GST Registration', 'Compliance', true, cast(null as double), 'contains'), (4, 'iso', 'ISO 9001', 'Quality', false, cast(null as double), cast(null as string)),
            (5, 'epf', 'EPF / ESI', 'Compliance', true, cast(null as double), cast(null as string)), (6, 'blacklist', 'Not Blacklisted', 'Compliance', true, cast(null as double), cast(null as string)),
            (7, 'turnover', 'Turnover again', 'Financial', true, 50.0e0, 'lte')) as v(k, criterion_key, label, criterion_type, mandatory, threshold_value, operator)
        where k < 7 or n_nationkey % 5 = 0""",
    "extractions": """
        select concat('e', c_custkey, '_', k, '_', v) as id, concat('j', c_nationkey) as job_id, concat('f', c_custkey) as file_id, concat('c', c_nationkey, '_', k) as criterion_id,
               case k when 1 then case c_custkey % 5 when 0 then concat(n_orders, '.2 crore') when 1 then '[8.2, 9.1, 10.4]' when 2 then concat(n_orders, '2 lakhs') when 3 then 'abc' else concat('Rs. ', c_custkey % 17, '.5 crore') end
                      when 2 then concat('', n_orders) when 3 then case c_custkey % 4 when 0 then '29AABCI1234F1Z5' when 1 then 'invalid' when 2 then 'registered' else 'pending' end
                      when 4 then case c_custkey % 4 when 0 then 'valid' when 1 then 'expired' when 2 then 'does not hold' else 'something else' end
                      when 5 then case c_custkey % 3 when 0 then 'registered' when 1 then 'not yet allotted' else '' end
                      else case c_custkey % 3 when 0 then 'is not blacklisted' when 1 then 'was blacklisted' else 'hereby declare' end end as parsed_value,
               cast(80 + (c_custkey + 3 * v) % 20 as double) / 100 as extraction_confidence, ((c_custkey + v) % 13 = 0) as not_found,
               case when c_custkey % 4 = 0 then '' else concat('snippet ', c_custkey) end as source_snippet, 1 + c_custkey % 3 as page_number,
               make_timestamp(2024, 1, 3, 0, cast(v as int), cast(k as int)) as created_at
        from customer join (select o_custkey, count(*) as n_orders from orders group by o_custkey) on o_custkey = c_custkey
        cross join (values (1), (2), (3), (4), (5), (6)) as a(k) cross join (values (0), (1)) as b(v)""",
    "results": """
        select concat('r', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) as id, concat('j', l_suppkey % 25) as job_id, case when l_partkey % 17 = 0 then null else concat('f', l_partkey % 40) end as bidder_file_id,
               concat('c', l_suppkey % 25, '_', 1 + l_linenumber % 6) as criterion_id,
               case l_returnflag when 'A' then 'pass' when 'R' then 'fail' else 'unknown' end as verdict,
               case l_returnflag when 'A' then cast(55 + cast(l_quantity as bigint) % 45 as double) / 100 when 'R' then 0.0e0 else 0.3e0 end as score,
               1.0e0 as weight, case l_returnflag when 'A' then cast(55 + cast(l_quantity as bigint) % 45 as double) / 100 when 'R' then 0.0e0 else 0.3e0 end as weighted_score,
               concat('line ', l_linenumber) as explanation, l_shipdate as created_at
        from lineitem""",
    "reviews": """
        select concat('a', event_id) as id, concat('j', user_id % 25) as job_id, concat('c', user_id % 25, '_', 1 + event_id % 6) as criterion_id,
               case when event_id % 9 = 0 then null else concat('x', event_id % 500) end as evaluation_result_id,
               case event_type when 'click' then 'approve' when 'purchase' then 'edit' when 'error' then 'reject' else 'approve' end as reviewer_action,
               case when event_id % 4 = 0 then null else concat(event_id % 12, '.5') end as updated_value, ts as created_at
        from events where event_type in ('click', 'purchase', 'error')""",
    "audit_logs": """
        select concat('l', event_id) as id, concat('j', user_id % 25) as job_id, concat('f', user_id) as file_id, case event_type when 'signup' then 'ingestion_done' else event_type end as action,
               case when event_id % 7 = 0 then '{"document_kind": "scanned"}' else concat('{"ocr_quality": 0.', 10 + event_id % 90, ', "document_kind": "digital"}') end as details, ts as created_at
        from events""",
    "pages": """
        select concat('d', doc_id) as file_id, k as page_number, case when k = 3 then substr(text, 3001) else substr(text, 1 + 1500 * (k - 1), 1500) end as text,
               case when doc_id % 2 = 0 then 1.0e0 else cast(50 + doc_id % 50 as double) / 100 end as ocr_confidence, cast(doc_id % 10 as double) / 10 as sharpness,
               cast(doc_id % 80 as double) / 10 as skew_abs_deg, source as job_id
        from documents cross join (values (1), (2), (3)) as p(k) where 1500 * (k - 1) < length(text)""",
    "chunks": """
        select concat('v', vec_id) as chunk_id, concat('j', vec_id % 10) as job_id, concat('f', vec_id % 50) as file_id, vec_id as position, embedding from embeddings""",
    "tied_chunks": """
        select concat('v', a.vec_id) as chunk_id, concat('j', a.vec_id % 10) as job_id, concat('f', a.vec_id % 50) as file_id, a.vec_id as position, b.embedding
        from embeddings a join embeddings b on b.vec_id = a.vec_id % 40""",
    "uploads": """
        select concat('d', doc_id) as file_id, concat('doc', doc_id, case doc_id % 7 when 0 then '.PNG' when 1 then '.docx' else '.pdf' end) as original_name from documents""",
    "questions": """
        select concat('q', vec_id) as query_id, concat('j', vec_id % 10) as job_id, embedding from embeddings where vec_id % 100 = 0""",
}


_LIST = re.compile(r"cross join \(values\s+(.*?)\) as (\w+)\(([^)]*)\)", re.S)


def _rows_of(m: re.Match) -> str:
    """A list of constants as rows that Spark makes of each row by itself, without a join."""
    rows = re.sub(r"\),\s*\(", "), struct(", m[1].strip())
    return f"lateral view inline(array(struct{rows})) {m[2]} as {m[3]}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows as a DataFrame."""
    sql = _LIST.sub(_rows_of, ADAPTERS[name])
    used = [t for t in GIVEN if re.search(rf"\b(?:from|join)\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
    if "'{" in sql:
        sql = re.sub(r"'\{(?=\")", "'{{", sql).replace('"}\'', '"}}\'')
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [frame(spark, sf_dir, n) for n in names]


def with_adapters(sql: str, *extra: tuple[str, str]) -> str:
    """DuckDB SQL with the adapters it names, and further expressions, as common table expressions."""
    named, todo = {}, [sql, *(s for _, s in extra)]
    text = " ".join(todo)
    for n, s in ADAPTERS.items():
        if re.search(rf"\b{n}\b", text):
            named[n] = s
    parts = [f"{n} as ({s})" for n, s in [*named.items(), *extra]]
    parts = [p.replace("as string)", "as varchar)") for p in parts]
    return (f"with {', '.join(parts)} " if parts else "") + sql
