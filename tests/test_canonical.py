"""Texts that Python's json and repr() write, against them."""

import datetime
import decimal
import json
import math
import random
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import canonical

TEXTS = ["", "plain", 'a "quoted" \\ one', "line\nfeed\r\t\f\b", "é ü — “”", "😀 \U0010ffff", "\x00\x1f\x7f\x80\x9f", "  ﻿​\xa0", "it's", "both ' and \"", None]


def test_floats(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 5.0, 0.1, 1 / 3, 0.0005, 1e-5, 1.5e-7, 1e15, 1e16, 123456789012345678.0, 1e22, 1e23, 2e23, 9.5367431640625e-07, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 100.0, -1e7,
        12345678.9, 1e7, 2.0**-44, 0.3, 27.7 / 3]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)) if math.isfinite(x)] + [round(rng.random() * 10 ** rng.randrange(9), rng.randrange(6)) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", canonical.python_float(F.col("x")).alias("s")).collect()
    other = [r for r in rows if r.s != repr(r.x)]
    assert all(float(r.s) == r.x for r in rows)
    assert len(other) <= 4 and all(abs(r.x) < 1e-307 or len(repr(r.x).split("e")[0].replace("-", "")) >= 18 for r in other), other
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(canonical.python_float(F.col("x")).alias("s"))
    assert [r.s for r in odd.collect()] == ["nan", "inf", "-inf", None]


def test_quoted_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", canonical.python_repr(F.col("t")).alias("r"), canonical.json_string(F.col("t")).alias("j")).collect()
    for r in rows:
        assert r.r == repr(r.t) and (r.t is None or r.j == json.dumps(r.t))


def test_nested_events(spark):
    rng = random.Random(3)
    schema = T._parse_datatype_string(
        "z string, a struct<y: double, `a b`: array<struct<n: long, b: string>>, `B`: boolean>, m map<string, array<double>>, at timestamp, day date, d decimal(9,2), i int, e array<int>, deep map<string, map<string, string>>")
    some = lambda x: None if rng.random() < 0.2 else x
    rows = []
    for _ in range(200):
        inner = some([some((some(rng.randrange(-9, 9)), some(rng.choice(TEXTS)))) for _ in range(rng.randrange(3))])
        rows.append((some(rng.choice(TEXTS)), some((some(rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 20)), inner, some(rng.random() < 0.5))),
            some({k or "none": some([some(1.5), 2e-7]) for k in rng.sample(TEXTS, 3)}), some(datetime.datetime(2024, 1, 2, 3, 4, 5, rng.choice([0, 120]))), some(datetime.date(2024, 2, 3)),
            some(decimal.Decimal("12.50")), some(7), some([1, None]), some({"é": {"b": None, "a": "x"}, "A": {}, "a": None})))
    df = spark.createDataFrame(rows, schema)
    plain = lambda v: v.asDict(True) if hasattr(v, "asDict") else v
    got = df.select("*", canonical.canonical(df, *df.columns).alias("said"), canonical.canonical(df, "a").alias("one")).collect()
    for r in got:
        d = r.asDict(True)
        said, one = d.pop("said"), d.pop("one")
        assert said == json.dumps({k: plain(v) for k, v in d.items()}, sort_keys=True, default=str)
        assert one == json.dumps(d["a"], sort_keys=True, default=str)
