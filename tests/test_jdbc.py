"""Round trips over a database that lives in the driver's memory."""

import pytest
from pyspark.sql import functions as F

from lotwise.sources import jdbc


@pytest.fixture(scope="module")
def url(spark):
    return "jdbc:derby:memory:lotwise;create=true"


def test_round_trip(spark, url):
    rows = spark.range(0, 5000, 1, 5).select(F.col("id"), F.concat(F.lit("é name "), "id").alias("name"), F.when(F.col("id") % 3 == 0, F.col("id") / 4).alias("score"), F.timestamp_seconds("id").alias("at"))
    jdbc.upsert_jdbc(rows, url, "results", ["id"])
    jdbc.upsert_jdbc(rows.where("id < 10"), url, "results", ["id"])
    back = jdbc.read_jdbc(spark, url, "results", "id", rows=700)
    assert back.rdd.getNumPartitions() == 8 and back.count() == 5000
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,4990)]" in back.where("id > 4990")._jdf.queryExecution().executedPlan().toString()
    sizes = [len(p) for p in back.rdd.glom().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1000


def test_rows_are_replaced_and_added(spark, url):
    schema = "id long, part string, name string"
    jdbc.upsert_jdbc(spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (2, "a", "old")], schema), url, "entries", ["id", "part"])
    fresh = spark.createDataFrame([(1, "b", "new"), (3, "a", "new"), (3, "a", "new")], schema)
    for _ in range(2):
        jdbc.upsert_jdbc(fresh, url, "entries", ["id", "part"])
    assert sorted(map(tuple, jdbc.read_jdbc(spark, url, "entries", "id").collect())) == [(1, "a", "old"), (1, "b", "new"), (2, "a", "old"), (3, "a", "new")]
    left = [r[0] for r in spark.read.jdbc(url, "(select tablename from sys.systables where tabletype = 'T') t").collect()]
    assert not [t for t in left if "STAGED" in t.upper()]


def test_an_empty_table(spark, url):
    jdbc.upsert_jdbc(spark.createDataFrame([], "id long, name string"), url, "nothing", ["id"])
    assert jdbc.read_jdbc(spark, url, "nothing", "id").count() == 0


def test_a_failed_change_leaves_all_rows(spark, url):
    jdbc.upsert_jdbc(spark.createDataFrame([(1, "a")], "id long, name string"), url, "kept", ["id"])
    with pytest.raises(Exception, match="(?i)missing"):
        jdbc._in_one(spark, url, {}, ["delete from kept", "insert into missing select * from kept"])
    assert jdbc.read_jdbc(spark, url, "kept", "id").count() == 1
