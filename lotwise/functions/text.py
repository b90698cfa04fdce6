"""Text columns: cleaning, density, sentences, character normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.rules import clip, strip

#: Characters that occupy one place and are read as another: quotes, dashes, spaces. Fixed values.
ODD_CHARACTERS = "‘’‚′“”„″–—−‐‑    ​‌‍﻿"
PLAIN_CHARACTERS = "''''\"\"\"\"-----        "
KNEE_CHARS = 1500


def clean_text(text: Column) -> Column:
    """Lines that hold a letter or digit, stripped, without odd spaces; null is empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ ​‌‍﻿]", " "), r"\r\n?", "\n")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x.rlike(r"[A-Za-z0-9\x{0900}-\x{097F}]"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), " {2,}", " "))


def text_density(text: Column) -> Column:
    """Stripped length over the length of a full page, at most 1."""
    return clip(F.length(strip(F.coalesce(text, F.lit("")))) / float(KNEE_CHARS))


def split_sentences(text: Column) -> Column:
    """Sentences as an array: cut after . ! ? and white space where a capital or a Devanagari letter follows."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z\x{0900}-\x{097F}])"), strip), lambda x: x != "")


def normalize_chars(text: Column) -> Column:
    """Odd quotes, dashes and spaces as ASCII, place by place."""
    return F.translate(text, ODD_CHARACTERS, PLAIN_CHARACTERS)


def table_rows_text(rows: Column) -> Column:
    """Rows of cells as lines of text."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: strip(F.coalesce(x, F.lit("")))), " | ")), "\n")


def pick_page_text(primary: Column, fallback: Column) -> Column:
    """The fallback where the primary text is short and the fallback is longer."""
    return F.when((F.length(primary) < 30) & (F.length(strip(fallback)) > F.length(primary)), strip(fallback)).otherwise(primary)
