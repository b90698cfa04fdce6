"""Criteria: parsing stored model answers, deduplication, reuse by checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.rules import canonical_key, parse_threshold, strip
from lotwise.operators.latest import best_row
from lotwise.operators.retrieval import context_texts
from lotwise.operators.search import MostWords, first_places, search

_CRITERIA = "struct<criteria: array<struct<id: string, label: string, criterion_type: string, mandatory: boolean, threshold_value: string, threshold_unit: string, operator: string, ambiguous: boolean>>>"
_FIELDS = "struct<fields: array<struct<field_name: string, raw_value: string, parsed_value: string, unit: string, source_snippet: string, confidence: double, not_found: boolean>>>"


def parse_criteria_json(answers: DataFrame) -> DataFrame:
    """Criteria of stored answers (job_id, answer); broken JSON gives none."""
    c = F.explode(F.from_json("answer", _CRITERIA)["criteria"]).alias("c")
    rows = answers.select("job_id", c).select("job_id", "c.*")
    return rows.select("job_id", canonical_key(F.col("id"), F.col("label")).alias("criterion_key"), F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("criterion_type", F.lit("technical")).alias("criterion_type"), F.coalesce("mandatory", F.lit(True)).alias("mandatory"),
        parse_threshold(F.col("threshold_value")).alias("threshold_value"), "operator", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def dedupe_criteria(criteria: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The oldest criterion per job and key; keys that are stored already are left out."""
    fresh = best_row(criteria, ["job_id", "criterion_key"], F.struct("created_at", "id"))
    return fresh if stored is None else fresh.join(stored.select("job_id", "criterion_key").distinct(), ["job_id", "criterion_key"], "left_anti")


def _first_tender(files: DataFrame) -> DataFrame:
    return best_row(files.where("file_type = 'tender'").select("job_id", "file_id", "checksum", "created_at"), ["job_id"], F.struct("created_at", "file_id"))


def reuse_criteria(files: DataFrame, criteria: DataFrame) -> DataFrame:
    """For each job, the criteria of the other job with the same tender text whose criteria are the oldest."""
    tender = _first_tender(files).select("job_id", "checksum")
    oldest = criteria.groupBy("job_id").agg(F.min(F.struct("created_at", "id")).alias("_first"))
    owners = tender.join(oldest, "job_id").select(F.col("job_id").alias("owner"), "checksum", "_first")
    # Of each text the two best owners are enough: a job takes the best that isn't itself.
    two = owners.withColumn("_n", F.row_number().over(Window.partitionBy("checksum").orderBy("_first"))).where("_n <= 2")
    pairs = tender.join(two, "checksum").where("job_id <> owner").groupBy("job_id").agg(F.min_by("owner", "_first").alias("owner"))
    return pairs.join(criteria.withColumnRenamed("job_id", "owner"), "owner").select("job_id", "owner", F.col("id").alias("criterion_id"), "criterion_key")


def reuse_extractions(files: DataFrame, criteria: DataFrame, extractions: DataFrame) -> DataFrame:
    """For each bidder file and criterion without a row, the surest found row of a file with the same checksum and a criterion of the same key."""
    keyed = criteria.select("job_id", F.col("id").alias("criterion_id"), "criterion_key")
    bidders = files.where("file_type = 'bidder'").select("job_id", "file_id", "checksum")
    wanted = bidders.join(keyed, "job_id").join(extractions.select("job_id", "file_id", "criterion_id"), ["job_id", "file_id", "criterion_id"], "left_anti")
    found = extractions.where(~F.col("not_found")).join(files.select("file_id", "checksum"), "file_id").join(keyed.drop("job_id"), "criterion_id")
    best = best_row(found.select("checksum", "criterion_key", "id", "parsed_value", "extraction_confidence", "created_at"), ["checksum", "criterion_key"],
        F.struct(-F.col("extraction_confidence"), "created_at", "id"))
    return wanted.join(best.withColumnRenamed("id", "source_id"), ["checksum", "criterion_key"]).select("job_id", "file_id", "criterion_id", "source_id", "parsed_value", "extraction_confidence")


def list_criteria(criteria: DataFrame) -> DataFrame:
    """Criteria in order of job, key and id, each with its job's total."""
    totals = criteria.groupBy("job_id").agg(F.count("*").alias("total"))
    return criteria.select("job_id", "id", "criterion_key", "label").join(totals, "job_id").orderBy("job_id", "criterion_key", "id")


def parse_llm_fields(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected fields (file_id, field_name) with what stored answers (file_id, answer) give; else not found."""
    listed = answers.select("file_id", F.posexplode(F.from_json("answer", _FIELDS)["fields"]).alias("_at", "f"))
    last = listed.groupBy("file_id", F.col("f.field_name").alias("field_name")).agg(F.max_by("f", "_at").alias("f"))
    value = F.when(F.lower("f.parsed_value").isin("none", "null", ""), None).otherwise(F.col("f.parsed_value"))
    missing = F.coalesce(F.col("f.not_found"), F.col("f.raw_value").isNull()) | value.isNull()
    rows = expected.join(last, ["file_id", "field_name"], "left").withColumns({"parsed_value": value, "not_found": F.coalesce(missing, F.lit(True))})
    sure = F.coalesce("f.confidence", F.lit(0.20))
    sure = F.when(F.col("not_found"), F.least(sure, F.lit(0.20))).when(F.coalesce(F.length("f.source_snippet"), F.lit(0)) == 0, F.least(sure, F.lit(0.65))).otherwise(sure)
    return rows.select("file_id", "field_name", "f.raw_value", "parsed_value", "f.unit", "f.source_snippet", "not_found", F.greatest(F.least(sure, F.lit(1.0)), F.lit(0.0)).alias("confidence"))


def merge_field_sources(by_pattern: DataFrame, by_model: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Per file and field the pattern's value, else the model's, else the fallback pattern's, else nothing.

    Each has columns parsed_value and confidence; fields that only the model was asked for have rows there as well.
    """
    keys = by_pattern.select("file_id", "field_name").unionByName(by_model.select("file_id", "field_name")).distinct()
    tiers = [("regex", by_pattern), ("model", by_model.where(~F.col("not_found"))), *([("regex-fallback", fallback)] if fallback is not None else [])]
    for name, rows in tiers:
        found = F.struct("parsed_value", "confidence", F.lit(name).alias("model_used")).alias(name)
        keys = keys.join(rows.where("parsed_value is not null").select("file_id", "field_name", found), ["file_id", "field_name"], "left")
    got = F.coalesce(*(F.col(f"`{name}`") for name, _ in tiers))
    return keys.select("file_id", "field_name", got["parsed_value"].alias("parsed_value"), F.coalesce(got["confidence"], F.lit(0.20)).alias("confidence"),
        got.isNull().alias("not_found"), got["model_used"].alias("model_used"))


#: Families of criteria: parts of keys, and what a prompt says is wanted, where it may stand, and how to answer.
FAMILIES = (
    (("turnover", "revenue", "financial"), """WANTED: how much the bidder turns over in a year, in crores of rupees.
WHERE: statements of turnover or of operating revenue, and sums given in crores or lakhs.
ANSWER: one number; the mean of the newest three years if several are told. A sum of 8.2 Cr is answered by 8.2."""),
    (("project", "work", "experience", "similar"), """WANTED: how many comparable works of at least two crores each the bidder has finished.
WHERE: lists of works with their contract sums, and certificates of completion.
ANSWER: a whole number of works."""),
    (("gst", "gstin", "tax"), """WANTED: the bidder's number under the goods and services tax, which has 15 characters.
WHERE: next to the words GSTIN or GST.
ANSWER: the whole number as it stands, such as 29AABCI1234F1Z5."""),
    (("iso", "certif", "quality"), """WANTED: whether the bidder is certified by ISO 9001 today.
WHERE: certificates and the days on which they end.
ANSWER: valid or expired; a certificate until next year is answered by valid."""),
    (("epf", "esi", "pf", "provident"), """WANTED: whether the bidder is registered for its workers' provident fund and state insurance.
WHERE: numbers or codes of EPF, ESI or PF.
ANSWER: registered, if there is one."""),
    (("blacklist", "debar", "integrity", "litigation"), """WANTED: whether the bidder has been shut out of tenders.
WHERE: the bidder's own declarations.
ANSWER: not_blacklisted, if it declares that it has not."""),
)


def field_description(key: Column, label: Column, description: Column) -> Column:
    """What a criterion asks for: its description and its family's hints by key; of no family, the description or else the label."""
    low, said = F.lower(F.coalesce(key, F.lit(""))), F.coalesce(description, F.lit(""))
    got = None
    for parts, hints in FAMILIES:
        hit = low.rlike("|".join(parts))
        text = F.concat(said, F.lit("\n" + hints))
        got = F.when(hit, text) if got is None else got.when(hit, text)
    return got.otherwise(F.when(said != "", said).otherwise(F.coalesce(label, F.lit(""))))


def build_prompts(context: DataFrame, criteria: DataFrame) -> DataFrame:
    """One prompt per file and criterion: what is wanted, and the file's context chunks (file_id, job_id, chunk_index, text).

    Criteria have id, job_id and label, and may have criterion_key (else the id is the key) and description.
    """
    joined = context.groupBy("job_id", "file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("_context"))
    return joined.join(_fields(criteria), "job_id").select("job_id", "file_id", "criterion_id", _prompt())


def build_retrieved_prompts(context: DataFrame, chunks: DataFrame, criteria: DataFrame) -> DataFrame:
    """One prompt per file and criterion over what bidder_context has found for it (its query_id is the criterion's id)."""
    texts = context_texts(context, chunks).select("job_id", F.col("query_id").alias("criterion_id"), "file_id", F.col("context").alias("_context"))
    return texts.join(_fields(criteria), ["job_id", "criterion_id"]).select("job_id", "file_id", "criterion_id", _prompt())


def criterion_questions(criteria: DataFrame) -> DataFrame:
    """(job_id, query_id, text) that are embedded to search for each criterion: its label and description."""
    said = F.col("description") if "description" in criteria.columns else F.lit("")
    return criteria.select("job_id", F.col("id").alias("query_id"), F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.coalesce(said, F.lit(""))).alias("text"))


def _fields(criteria: DataFrame) -> DataFrame:
    """(job_id, criterion_id, _field): what prompts ask for."""
    label = F.coalesce("label", F.lit(""))
    key = F.col("criterion_key" if "criterion_key" in criteria.columns else "id")
    wanted = field_description(key, label, F.col("description") if "description" in criteria.columns else F.lit(None).cast("string"))
    field = F.when(wanted == label, label).otherwise(F.concat(label, F.lit("\n"), wanted))
    return criteria.select("job_id", F.col("id").alias("criterion_id"), field.alias("_field"))


def _prompt() -> Column:
    return F.concat(F.lit("Field: "), "_field", F.lit("\n\nContext:\n"), "_context").alias("prompt")


def resolve_snippet_page(snippets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Page (file_id, snippet_id, page) of the chunk that holds each snippet: by exact heads, by a loose head, by words.

    Each tier is one pass of an automaton over the chunks of a file; only snippets that none has placed meet the next one.
    """
    keys = ["file_id", "snippet_id"]
    asked = snippets.select(*keys, strip(F.col("snippet")).alias("_raw"))
    texts = chunks.select("file_id", F.col("chunk_index").alias("at"), "page", F.coalesce("text", F.lit("")).alias("text"))
    raw = F.col("_raw")
    # A tier's sign stands before the id, so that each pattern has an id of its own: five exact heads, then a loose one.
    heads = [("0", raw), *((str(k), strip(F.substring(raw, 1, n))) for k, n in enumerate((200, 120, 80, 50), 1)), ("~", F.substring(raw, 1, 60))]
    wanted = asked.select("file_id", "snippet_id", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), p.alias("head")) for t, p in heads))).alias("_h")).where(F.length("_h.head") >= 20)
    found = first_places(wanted.select("file_id", F.concat("_h.tier", "snippet_id").alias("pattern_id"), "_h.head"), texts, F.col("head"))
    found = found.select("file_id", F.expr("substring(pattern_id, 2)").alias("snippet_id"), F.substring("pattern_id", 1, 1).alias("tier"), "page")
    placed = found.groupBy(*keys).agg(F.min_by("page", "tier").alias("page"))

    left = asked.select("file_id", "snippet_id", F.regexp_extract_all(F.lower(raw), F.lit(r"[A-Za-z0-9]{4,}"), 0).alias("words")).where(F.size("words") >= 4)
    rest = left.join(placed.select(*keys), keys, "left_anti").select("file_id", F.col("snippet_id").alias("pattern_id"), "words")
    worded = search(rest, texts, MostWords).where("hits > 3")
    later = worded.select("file_id", F.col("pattern_id").alias("snippet_id"), "page")
    kind = chunks.schema["page"].dataType
    return snippets.select(*keys).join(placed.unionByName(later), keys, "left").withColumn("page", F.col("page").cast(kind))
