"""Queries without SQL, sinks, sources and streams: brute force, and properties of every row."""

import datetime
import hashlib
import json
import os
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lotwise.operators import documents, insight
from lotwise.plans import registry
from lotwise.sources import adapters, tables
from lotwise.streaming import jobs

SF = "/root/testdata/sf0.001"


def check_chunks(text, size, overlap, chunks):
    """Properties of a text's chunks: their order, length and place, and that no word is lost."""
    cursor = 0
    for chunk, start, end in chunks:
        assert end - start == len(chunk) and chunk == chunk.strip() != "" and start >= cursor
        at = text.find(chunk[:50], cursor)
        assert start == (at if at >= 0 else cursor)
        cursor = start
        assert len(chunk) <= size + overlap + 1 or any(len(w) >= size - overlap for w in chunk.split())
    said = iter(" ".join(c for c, _, _ in chunks).split())
    assert all(any(w == x for x in said) for w in text.split()) or overlap >= size


def test_chunks_of_any_text(spark):
    rng = random.Random(11)
    parts = ["a", "bb", "word", "longerword", "x" * 30, "é😀", "\n", "\n\n", "\n \n\n", " "]
    texts = {str(k): " ".join(rng.choice(parts) for _ in range(rng.randrange(60))).replace(" \n ", "\n") for k in range(300)} | {"none": None, "blank": " \n\n "}
    docs = spark.createDataFrame(list(texts.items()), "file_id string, raw_text string")
    for size, overlap in ((5, 1), (12, 4), (25, 3), (60, 4)):
        made = documents.chunk_documents(docs, size, overlap)
        assert "Python" not in made._jdf.queryExecution().toString()
        got = {}
        for r in made.orderBy("file_id", "chunk_index").collect():
            assert r.chunk_index == len(got.setdefault(r.file_id, []))
            got[r.file_id].append((r.text, r.char_start, r.char_end))
        for f, text in texts.items():
            check_chunks(text or "", size, overlap, got.get(f, []))
    assert documents.chunk_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,size,overlap,want", [
    ("alpha beta\n\ngamma", 20, 4, [("alpha beta", 0, 10), ("beta gamma", 0, 10)]), ("first line here\nsecond line", 15, 5, [("first line here", 0, 15), ("here second line", 0, 16)]),
    ("one two three four five six", 12, 4, ["one two", "two two three", "hree hree four", "four four five", "five five six"]), ("abc\n\n\n\ndefghij", 3, 2, ["abc", "bc defghij"]),
    (" \n ", 9, 2, []), ("aa bb cc", 5, 0, ["aa", "bb", "cc"]),
])
def test_chunks_of_rows(spark, text, size, overlap, want):
    rows = documents.chunk_documents(spark.createDataFrame([("f", text)], "file_id string, raw_text string"), size, overlap).orderBy("chunk_index").collect()
    assert [(r.text, r.char_start, r.char_end) if w and isinstance(w, tuple) else r.text for r, w in zip(rows, want)] == want and len(rows) == len(want)


def test_chunks_of_documents(spark):
    texts = {r.file_id: r.raw_text for r in registry.QUERIES["assemble_documents"](spark, SF).collect()}
    got = {}
    for r in registry.QUERIES["chunk_documents"](spark, SF).orderBy("file_id", "chunk_index").collect():
        got.setdefault(r.file_id, []).append((r.chunk_index, r.text, r.char_start, r.char_end))
    assert set(got) == {f for f, t in texts.items() if t.strip()}
    for f, rows in got.items():
        assert [k for k, *_ in rows] == list(range(len(rows)))
        check_chunks(texts[f], 500, 100, [tuple(x) for _, *x in rows])


def test_texts_of_chunks(spark):
    """The chunks without places are those with them, and no place is looked for."""
    docs = registry.QUERIES["assemble_documents"](spark, SF)
    for overlap in (0, 100):
        made = documents.chunk_texts(docs, 500, overlap)
        assert "char_start" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, documents.chunk_documents(docs, 500, overlap).select("file_id", "chunk_index", "text").collect()))


def test_pages_of_chunks(spark):
    pages = {}
    for p in sorted(adapters.frame(spark, SF, "pages").collect(), key=lambda p: p.page_number):
        pages.setdefault(p.file_id, []).append((p.page_number, p.text))
    chunks = registry.QUERIES["chunk_documents"](spark, SF).collect()
    want = {(c.file_id, c.chunk_index): next((n for n, t in pages[c.file_id] if c.text[:100] in t), 1) for c in chunks}
    assert {(r.file_id, r.chunk_index): r.page for r in registry.QUERIES["estimate_page"](spark, SF).collect()} == want


def test_places_of_snippets(spark):
    """Each snippet is cut from its own page, so it is found as it stands, at its first place."""
    texts = {(p.file_id, p.page_number): p.text for p in adapters.frame(spark, SF, "pages").collect()}
    rows = registry.QUERIES["locate_snippets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.file_id, r.page_number]
        words = text[100:180].split()
        if not words:
            assert r.tier is None
            continue
        first = re.search(r"\s+".join(map(re.escape, words)), text, re.I)
        assert (r.start, r.end, r.tier) == (first.start(), first.end(), "exact")


def slow_place(snippet, text):
    """All windows of a snippet's words as patterns, the longest first; then its most distinctive word."""
    words, gap = snippet.split(), r"[\s\-–—:;,]+"
    find = lambda ws: re.search(gap.join(map(re.escape, ws)), text, re.I)
    if words and (m := find(words)):
        return m.start(), m.end(), "exact"
    for n in range(min(len(words), 30), 2, -1):
        found = [m for k in range(len(words) - n + 1) if (m := find(words[k : k + n]))]
        if found:
            m = max(found, key=lambda m: m.end() - m.start())
            return m.start(), m.end(), "phrase"
    cores = [re.sub(r"[^A-Za-z0-9.\-]", "", w) for w in words]
    for core in sorted((c for c in cores if re.fullmatch(r"\d+(?:\.\d+)?|[A-Za-z][A-Za-z\-]{5,}", c)), key=len, reverse=True):
        if m := re.search(rf"\b{re.escape(core)}\b", text, re.I | re.A):
            return m.start(), m.end(), "token"
    return None, None, None


def test_places_of_altered_snippets(spark):
    texts = {(p.file_id, p.page_number): p.text for p in adapters.frame(spark, SF, "pages").collect()}
    rows = registry.QUERIES["locate_altered_snippets"](spark, SF).collect()
    assert len(rows) == len(texts)
    tiers = [(r.start, r.end, r.tier) for r in rows]
    assert tiers == [slow_place(r.snippet.replace("\u00a0", " "), texts[r.file_id, r.page_number]) for r in rows]
    assert {t for *_, t in tiers} >= {"exact", "phrase", "token"}


def test_job_reports(spark):
    said = {r.job_id: json.loads(r.report) for r in registry.QUERIES["job_reports"](spark, SF).collect()}
    jobs_, summary = adapters.frame(spark, SF, "jobs").collect(), {r.job_id: r for r in registry.QUERIES["job_summary"](spark, SF).collect()}
    ranked = {}
    for r in registry.QUERIES["rank_bidders"](spark, SF).collect():
        ranked.setdefault(r.job_id, {})[r.bidder_file_id] = (r.bidder_name, r.total_score, r.is_disqualified)
    assert set(said) == {j.job_id for j in jobs_}
    for j in jobs_:
        report = said[j.job_id]["evaluation"]
        assert said[j.job_id]["title"] == j.title and report["status"] == summary[j.job_id].status and report["total_score"] == summary[j.job_id].total_score
        assert {b.get("bidder_file_id"): (b["bidder_name"], b["total_score"], b["is_disqualified"]) for b in report.get("bidders", [])} == ranked.get(j.job_id, {})


def test_pieces_of_dashboards(spark):
    """Pieces of some kilobytes join to the lists of the whole dashboard, and the registered query has all jobs."""
    j, r, c, f, x, a = (adapters.frame(spark, SF, n) for n in ("jobs", "results", "criteria", "files", "extractions", "audit_logs"))
    insights = insight.criterion_insights(r, c, f, x, a)
    whole = {d.job_id: json.loads(d.d) for d in insight.dashboard(j, r, c, f, insights).select("job_id", F.to_json(F.struct("*")).alias("d")).collect()}
    got = {}
    for row in tables.dashboard_pieces(j, r, c, f, insights, most_bytes=3000).orderBy("job_id", "part", "piece").collect():
        held = got.setdefault(row.job_id, {}).setdefault(row.part, [])
        assert row.piece == len(held) and len(row.document.encode()) < 3600
        held.append(json.loads(row.document))
    assert got.keys() == whole.keys() and any(len(parts["criteria"]) > 3 for parts in got.values() if "criteria" in parts)
    for job, parts in got.items():
        for part in ("bidders", "criteria"):
            assert [e for d in parts.get(part, []) for e in d[part]] == whole[job].get(part, [])
        assert {k: v for k, v in whole[job].items() if k not in ("job_id", "bidders", "criteria")} == parts["summary"][0]
    assert registry.QUERIES["dashboard_pieces"](spark, SF).select("job_id").distinct().count() == len(whole)


def test_ranks_from_stored_results(spark):
    """From results that lie by job and bidder to ranks, only the few ranked rows are exchanged, not the results."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.QUERIES["ranks_from_layout"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*0123456789()"))
    wide = next(k for k, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x and "weighted_score" in x)
    above, at = [], depth(lines[wide])
    for x in reversed(lines[:wide]):
        if depth(x) < at:
            above, at = [*above, x], depth(x)
    assert sum("Exchange" in x for x in above) <= 1, above


def test_uploads_and_results(spark, tmp_path):
    (tmp_path / "up" / "deep").mkdir(parents=True)
    for name, data in (("x.bin", b"abc"), ("deep/z.bin", b"q" * 10_000), ("deep/no ne.bin", b"")):
        (tmp_path / "up" / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.checksum) for r in tables.read_upload_files(spark, str(tmp_path / "up")).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in (("x.bin", b"abc"), ("z.bin", b"q" * 10_000), ("no ne.bin", b""))}
    rows = spark.createDataFrame([("r1", "pass"), ("r2", "fail")], "id string, verdict string")
    for part in (rows, rows.withColumn("verdict", F.lit("unknown")), rows.limit(0)):
        tables.append_results(part, str(tmp_path), "results")
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path), "results").collect())) == [("r1", "pass"), ("r1", "unknown"), ("r2", "fail"), ("r2", "unknown")]


def stream(spark, rows, schema, path):
    """Rows as a stream of one file a batch."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
        for f in pathlib.Path(path, str(k)).glob("part-*"):
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)


def test_repeated_uploads_in_a_stream(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    batches = [[("f1", "j", "a", at(0)), ("f2", "j", "a", at(1)), ("f3", "j", "b", at(1))], [("f4", "j", "a", at(2)), ("f5", "k", "a", at(2)), ("f6", "j", None, at(3)), ("f7", "j", None, at(3))]]
    rows = stream(spark, batches, "file_id string, job_id string, checksum string, created_at timestamp", str(tmp_path / "in"))
    jobs.stream_dedupe_uploads(rows).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation",
        str(tmp_path / "c")).start().awaitTermination()
    kept = spark.table("kept").collect()
    assert sorted((r.job_id, r.checksum or "") for r in kept) == [("j", ""), ("j", "a"), ("j", "b"), ("k", "a")]
    assert {r.file_id for r in kept if r.checksum == "a" and r.job_id == "j"} <= {"f1", "f2"}


def test_late_rows_of_daily_counts(spark, tmp_path):
    day = lambda d, h=0: (datetime.datetime(2024, 1, d, h),)
    batches = [[day(1), day(1, 5), day(2)], [day(6)], [day(6, 3)], [day(1, 7)], [day(9)], [day(9)]]
    rows = stream(spark, batches, "created_at timestamp", str(tmp_path / "in"))
    jobs.stream_daily_counts(rows).writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).option("checkpointLocation",
        str(tmp_path / "c")).start().awaitTermination()
    got = {r.day: r.n for r in spark.table("daily").collect()}
    # The row of 1 January that comes after 6 January is too late; 9 January is still open.
    assert got == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-06": 2}


@pytest.mark.parametrize("names,want", [(("a.PDF", "b.jpeg", "c.docx", "d"), [("digital", None), ("image", None), (None, "UNSUPPORTED_FILE_TYPE"), (None, "UNSUPPORTED_FILE_TYPE")])])
def test_kinds_of_documents(spark, names, want):
    files = spark.createDataFrame([(f"f{k}", n) for k, n in enumerate(names)] + [("f9", "e.pdf"), ("f8", None)], "file_id string, original_name string")
    pages = spark.createDataFrame([("f0", 1, "x" * 60), ("f1", 1, "x" * 60)], "file_id string, page_number int, text string")
    got = {r.file_id: (r.document_kind, r.error) for r in documents.document_kinds(files, pages).collect()}
    assert [got[f"f{k}"] for k in range(len(names))] == want and got["f9"] == (None, "PDF_EMPTY") and got["f8"] == (None, "UNSUPPORTED_FILE_TYPE")


def test_pieces_of_dashboards_find_newest_results_once(spark, tmp_path):
    """Results pass once to the dashboard's newest rows, and once to the insights, however often the rows of pieces are read."""
    j, r, c, f, x, a = (adapters.frame(spark, SF, n) for n in ("jobs", "results", "criteria", "files", "extractions", "audit_logs"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        read.add(1)
        return v

    seen = r.withColumn("verdict", counted.asNondeterministic()("verdict"))
    made = tables.dashboard_pieces(j, seen, c, f, insight.criterion_insights(seen, c, f, x, a))
    made.write.parquet(str(tmp_path / "out"))
    assert read.value == 2 * r.count()


def test_words_of_pages_travel_together(spark):
    """Words in any order and of any characters, pages in several stretches, nulls; pages, not words, are shuffled."""
    rng = random.Random(4)
    pages = [(f, p, k, rng.choice(["a", "b c", "\x01", "x\x02y", "é|", " ", None]), rng.choice([-1, 40, 71, None])) for f in ("f", "g", None) for p in (1, None, 3) for k in range(40)]
    rows = rng.sample(pages, len(pages)) + [("h", 1, k, f"w{k}", 50) for k in range(3000)]
    schema = "file_id string, page_number int, position int, text string, conf int"
    made = documents.ocr_page_text(spark.createDataFrame(rows, schema).coalesce(1))
    got = {(r.file_id, r.page_number): (r.text, round(r.confidence, 9)) for r in made.collect()}
    good = {}
    for f, p, k, t, c in sorted((r for r in rows if r[4] not in (-1, None) and (r[3] or "").strip()), key=lambda r: r[2]):
        good.setdefault((f, p), []).append((t, c))
    assert got == {key: (" ".join(t for t, _ in ws), round(sum(c for _, c in ws) / len(ws) / 100, 9)) for key, ws in good.items()}
    plain = spark.createDataFrame(rows[360:], schema).coalesce(1).where("conf <> -1").select("file_id", "page_number", "position", "text", "conf")
    assert plain.mapInArrow(documents._stretches, "file_id string, page_number int, at array<int>, words string, part string, sum double, n long").count() == 1


def test_buckets_of_laid_out_results_grow_with_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 100)
    rows = spark.range(2000).select(F.col("id").cast("string").alias("job_id"), F.lit("b").alias("bidder_file_id"), "id")
    for n, want in ((300, 8), (2000, 20)):
        tables.write_laid_out(rows.limit(n), f"laid_{n}", str(tmp_path / str(n)))
        spec = spark.sql(f"describe extended laid_{n}").where("col_name = 'Num Buckets'").first()
        assert int(spec.data_type) == want and tables.read_laid_out(spark, f"laid_{n}").count() == n
        spark.sql(f"drop table laid_{n}")
