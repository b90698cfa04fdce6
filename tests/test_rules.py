"""Scenario tables of the rule engine, quality formula, chunks, chains and streams."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import fields, rules, text
from lotwise.operators import audit, documents, latest, locate, review
from lotwise.sources import tables


@pytest.mark.parametrize("value,want", [("8.2", 8.2), ("8.2 crore", 8.2), ("82 lakhs", 0.82), ("[8.2, 9.1, 10.4]", 27.7 / 3), ("1,234", 117.5), ("-5", 5.0), ("None",
    None), ("nan", None), ("", None), (None, None), ("abc", None)])
def test_to_float(spark, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(rules.to_float(F.col("v"))).first()[0]
    assert got == want if want is None else abs(got - want) < 1e-9


@pytest.mark.parametrize("label,ambiguous,threshold,op,value,conf,want", [
    ("any", True, 5.0, "gte", "9", 0.9, ("unknown", 0.3)), ("turnover", False, 5.0, "gte", "9.23", 0.85, ("pass", 0.85)), ("turnover", False, 5.0, "gte", "2.67", 0.85, ("fail", 0.0)),
    ("turnover", False, 5.0, "contains", "5", 0.85, ("pass", 0.85)), ("turnover", False, 5.0, "gte", "abc", 0.85, ("unknown", 0.3)), ("GST", False, None, None, "29AABCI1234F1Z5", 0.9, ("pass", 0.9)),
    ("GST", False, None, None, "invalid", 0.9, ("fail", 0.0)), ("blacklist", False, None, None, "is not blacklisted", 0.9, ("pass", 0.9)), ("blacklist", False, None,
        None, "was blacklisted", 0.9, ("fail", 0.0)),
    ("ISO", False, None, None, "does not hold", 0.9, ("fail", 0.0)), ("ISO", False, None, None, "something else", 0.87, ("pass", 0.87)), ("ISO", False, None, None, "",
        0.9, ("unknown", 0.3)), ("ISO", False, None, None, None, 0.9, ("unknown", 0.3)),
])
def test_verdict(spark, label, ambiguous, threshold, op, value, conf, want):
    row = spark.createDataFrame([(label, ambiguous, threshold, op, value, conf)], "l string, a boolean, t double, o string, v string, c double")
    got = row.select(rules.verdict(F.col("l"), F.col("a"), F.col("t"), F.col("o"), F.col("v"), F.col("c")).alias("x")).first()["x"]
    assert (got["verdict"], got["score"]) == want


@pytest.mark.parametrize("args,want", [
    (("pass", .92, .92, False, True, False, True, 1.0), 0.92), (("fail", 0.0, .85, False, True, False, True, 1.0), 0.0), (("unknown", .3, .85, False, False, True, True,
        1.0), 0.95), (("unknown", .3, .20, True, True, False, False, 1.0), 0.05),
    (("unknown", .3, .20, True, True, False, False, .55), 0.0), (("unknown", .3, .85, False, True, False, True, .65), 0.7975), (("unknown", .3, None, True, True, False,
        False, 1.0), 0.05), (("unknown", 0.0, 1.0, False, False, True, True, 1.0), 1.0),
])
def test_review_confidence(spark, args, want):
    row = spark.createDataFrame([args], "a string, b double, c double, d boolean, e boolean, f boolean, g boolean, h double")
    assert row.select(rules.review_confidence(*(F.col(c) for c in "abcdefgh"))).first()[0] == want


PAGE = "file_id string, page_number int, text string, ocr_confidence double, text_density double, sharpness double, skew_abs_deg double, is_empty boolean"
FULL, OCR = "x" * 1500, "OCR text " * 200


@pytest.mark.parametrize("rows,want", [
    ([(FULL, 1.0, 1.0, 1.0, 0.0, False)] * 5, 1.0), ([(OCR, .92, .95, .95, .5, False)] * 5, 0.935), ([(OCR, .70, .65, .55, 4.0, False)] * 5, 0.65), ([(OCR, .45, .30, .20, 2.5, False)] * 5, 0.45),
    ([("", 0.0, 0.0, 0.0, 0.0, True), (OCR, .05, .05, .05, 8.0, False)] * 2 + [("", 0.0, 0.0, 0.0, 0.0, True)], 0.092), ([("", 0.0, 0.0, 0.0, 0.0, True)] * 3, 0.1),
        ([(OCR, 0.0, 0.0, 0.0, 10.0, False)] * 3, 0.1),
])
def test_ocr_quality(spark, rows, want):
    pages = spark.createDataFrame([("f", k, *r) for k, r in enumerate(rows, 1)], PAGE)
    assert documents.ocr_quality(pages).first()["ocr_quality"] == want


def test_extract(spark):
    said = "Average Annual Turnover (FY 2021-22 to FY 2023-24): Rs. 9.23 Crore\nEPF not yet allotted. ISO 9001:2015: does not hold.\n5 qualifying projects. The firm is not blacklisted. GSTIN 27ABCDE1234F1Z5"
    row = spark.createDataFrame([(said,)], "t string").select(*(fields.extract_field(F.lit(n), F.col("t"))["parsed_value"].alias(n) for n in ("turnover", "epf", "iso",
        "projects", "blacklist", "gst"))).first()
    assert (row.turnover, row.projects, row.blacklist, row.gst) == ("9.23", "5", "not_blacklisted", "27ABCDE1234F1Z5")
    assert row.iso == "does not hold" and row.epf == "does not hold"
    years = spark.createDataFrame([("FY 2021-22: Rs. 8.20 Crore\nFY 2022-23: Rs. 9.10 Crore\nFY 2023-24: Rs. 10.40 Crore",)], "t string")
    assert years.select(fields.extract_turnover(F.col("t"))["parsed_value"]).first()[0] == "9.23"


def test_text(spark):
    row = spark.createDataFrame([(" a  b \r\n---\r\n c​",)], "t string").select(text.clean_text(F.col("t")).alias("c"), text.normalize_chars(F.lit("“a”—b")).alias("n"),
        text.split_sentences(F.lit("One. Two? three. Four")).alias("s")).first()
    assert row.c == "a b\nc" and row.n == '"a"-b' and row.s == ["One.", "Two? three.", "Four"]


def test_chain(spark):
    actions = spark.createDataFrame([(str(k), "j", "x", f'{{"k": {k}}}') for k in range(4)],
        "id string, job_id string, action_type string, payload string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    chain = audit.append_chain(actions)
    assert audit.verify_chain(chain).first()["chain_valid"]
    tampered = chain.withColumn("payload", F.when(F.col("id") == "1", "{}").otherwise(F.col("payload")))
    assert not audit.verify_chain(tampered).first()["chain_valid"]
    assert audit.failure_index(tampered).first()["failure_index"] == 1
    assert audit.failure_index(chain.where("id <> '1'")).first()["failure_index"] == 1
    more = audit.append_chain(actions.withColumn("id", F.concat(F.lit("n"), "id")), chain)
    assert audit.verify_chain(chain.unionByName(more)).first()["chain_valid"]
    assert audit.verify_chain(chain.limit(0)).count() == 0


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "a"), ("f2", "b"), ("f3", "c")], "file_id string, text string")
    tables.write_table(rows, str(tmp_path), "chunks", "file_id", 4)
    tables.replace_rows(spark, spark.createDataFrame([("f2", "new"), ("f4", "d")], "file_id string, text string"), str(tmp_path), "chunks", "file_id", 4)
    tables.replace_rows(spark, spark.createDataFrame([("f2", "new"), ("f4", "d")], "file_id string, text string"), str(tmp_path), "chunks", "file_id", 4)
    got = sorted((r.file_id, r.text) for r in tables.read_table(spark, str(tmp_path), "chunks").collect())
    assert got == [("f1", "a"), ("f2", "new"), ("f3", "c"), ("f4", "d")]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "x.bin").write_bytes(b"abc")
    assert tables.read_upload_files(spark, str(tmp_path / "up")).first()["size_bytes"] == 3


def test_null_keys(spark):
    rows = spark.createDataFrame([("j", None, 1, "b"), ("j", None, 2, "a"), ("j", "x", 1, "c")], "job_id string, bidder_file_id string, created_at int, id string")
    assert sorted(r.id for r in latest.newest_row(rows, ["job_id", "bidder_file_id"]).collect()) == ["a", "c"]


TOLD = """Bid Document — Acme Constructions Pvt Ltd
Annual Turnover Statement
Average Annual Turnover (FY 2021-22 to FY 2023-24): Rs. 9.23 Crore
FY 2023-24: Rs. 11.40 Crore
FY 2022-23: Rs. 9.90 Crore
FY 2021-22: Rs. 6.40 Crore
Project Experience
Total Completed Projects: 5 projects worth above Rs. 2 Crore
GSTIN: 27ABCDE1234F1Z5
ISO 9001:2015 — Certificate Valid until December 2025
Organization is not blacklisted by any Government department."""


@pytest.mark.parametrize("snippet,want", [
    ("Average Annual Turnover (FY 2021-22 to FY 2023-24): Rs. 9.23 Crore", (68, 134, "exact")),
        ("Annual Turnover for FY 2023-24 is Rs. 11.40 Crore in their financial statement", (147, 162, "phrase")),
    ("Average\u00a0Annual\u00a0Turnover — Rs.\u00a09.23\u00a0Crore", (68, 91, "phrase")), ("Qualifying projects: 5", (252, 260, "token")),
        ("FY values: [11.4, 9.9, 6.4] -> avg 9.23 Crore", (124, 128, "token")),
    ("GSTIN: 27ABCDE1234F1Z5", (297, 319, "exact")), ("ISO 9001:2015 Certificate", (320, 347, "exact")), ("Organization is not blacklisted by any Government department.", (374, 435, "exact")),
    ("The quick brown fox jumps over the lazy dog ABCXYZ987", (None, None, None)), (None, (None, None, None)), ("", (None, None, None)),
])
def test_locate(snippet, want):
    assert locate.locate(snippet, TOLD) == want


def test_locate_rows(spark):
    df = spark.createDataFrame([("GSTIN: 27ABCDE1234F1Z5", TOLD), (None, None)], "snippet string, text string")
    assert [tuple(r)[2:] for r in locate.locate_snippets(df).collect()] == [(297, 319, "exact"), (None, None, None)]


@pytest.mark.parametrize("text,want", [
    ("Qualifying projects: 6 (six). Elsewhere 5 qualifying projects.", "6"), ("5 qualifying projects. Total qualifying projects: 6", "5"), ("total qualifying similar projects completed - 7", "7"), ("none", None),
])
def test_qualifying_projects(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(fields.extract_projects(F.col("t")).alias("f")).first()["f"]
    assert (got and got["parsed_value"]) == want


def test_explanations_of_reviews(spark):
    actions = spark.createDataFrame([(str(k), c, r, a, v) for k, (c, r, a, v) in enumerate([("t", "r", "reject", None), ("t", "r", "reject", "too small"), ("n", "r", "edit", None), ("n", "r", "edit", "ok"),
        ("t", "r", "edit", "it's 0.0004"), ("t", "r", "edit", None), ("t", "r", "edit", 'a "b"\n'), ("t", "r", "edit", "12345678.5"), ("t", "r", "approve", "9")])],
        "id string, criterion_id string, evaluation_result_id string, reviewer_action string, updated_value string")
    results = spark.createDataFrame([("r", "j", "f", 1.0)], "id string, job_id string, bidder_file_id string, weight double")
    rules_ = spark.createDataFrame([("t", "Sum", False, 0.00005, "gte"), ("n", "Paper", False, None, None)], "id string, label string, ambiguous boolean, threshold_value double, operator string")
    got = {r.action_id: r.explanation for r in review.apply_reviews(actions, results, rules_)[0].collect()}
    again = lambda said, text: f"Reviewer provided updated value={said!r}. Re-evaluated: [Sum] {text}"
    missing = "Value not found or not numeric in bidder document"
    assert got == {
        "0": "Reviewer REJECTED this criterion. Reason: not provided", "1": "Reviewer REJECTED this criterion. Reason: too small", "2": "Reviewer override applied with value=None",
        "3": "Reviewer override applied with value=ok", "4": again("it's 0.0004", "extracted=0.0004 gte threshold=5e-05 → PASS"), "5": again(None, missing), "6": again('a "b"\n', missing),
        "7": again("12345678.5", "extracted=12345678.5 gte threshold=5e-05 → PASS"),
    }


def test_snippets_compile_no_patterns(monkeypatch):
    """A pattern made for each row costs more than the search; words that start like a gap take the other way."""
    monkeypatch.setattr(locate, "re", None)
    assert locate.locate("ISO 9001:2015   certificate", TOLD) == (320, 347, "exact")
    assert locate.locate("Here: Organization is not blacklisted by", TOLD)[2] == "phrase"
    assert locate.locate("a -b", "a b a - -b") == (4, 10, "exact")
