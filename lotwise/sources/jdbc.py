"""Tables of a relational store, read in ranges of a key and replaced row by row through a staging table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of a range that one task reads, about, and ranges at most (each is a connection to the store).
RANGE_ROWS, MOST_RANGES = 1_000_000, 256


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, properties: dict[str, str] | None = None, rows: int = RANGE_ROWS, most: int = MOST_RANGES, quote: str = '"') -> DataFrame:
    """A stored table, in as many ranges of a whole-numbered key as it has rows for; rows of a null key come with the first.

    Least and greatest key and the number of rows are asked of the store, which has them from an index as a rule. Keys
    should be dealt evenly between those two. Filters and columns are the store's to apply, as with any such source.
    """
    options, name = properties or {}, f"{quote}{key}{quote}"
    low, high, n = spark.read.jdbc(url, f"(select min({name}) as low, max({name}) as high, count(*) as n from {table}) stats", properties=options).first()
    parts = min(most, -(-n // rows))
    if parts < 2 or low is None or low == high:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts, properties=options)


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], properties: dict[str, str] | None = None, text_chars: int = 4000, most: int = 64, quote: str = '"') -> None:
    """Replace the stored rows of df's keys (unique in df, not null) by df's, and add those that aren't there.

    Tasks write a staging table of their own; one transaction on the driver then deletes and inserts, so readers see all
    or nothing of it, and a failed run leaves the table as it was. Rows that a repeated task has staged twice count once.
    Texts are stored with text_chars characters at most; a missing table is made.
    """
    spark, options = df.sparkSession, properties or {}
    kinds = ", ".join(f"{f.name} VARCHAR({text_chars})" for f in df.schema if isinstance(f.dataType, T.StringType))
    typed = lambda w: w.option("createTableColumnTypes", kinds) if kinds else w
    staging = f"{table}_staged_{uuid.uuid4().hex[:12]}"
    typed(df.limit(0).write).mode("append").jdbc(url, table, properties=options)
    typed(df.coalesce(most).write).mode("overwrite").jdbc(url, staging, properties=options)
    named = lambda prefix, columns: ", ".join(f"{prefix}{quote}{c}{quote}" for c in columns)
    same = " and ".join(f"s.{quote}{k}{quote} = {table}.{quote}{k}{quote}" for k in keys)
    _in_one(spark, url, options, [
        f"delete from {table} where exists (select 1 from {staging} s where {same})",
        f"insert into {table} ({named('', df.columns)}) select distinct {named('s.', df.columns)} from {staging} s",
    ])
    _in_one(spark, url, options, [f"drop table {staging}"])


def _in_one(spark: SparkSession, url: str, properties: dict[str, str], statements: list[str]) -> None:
    """Statements as one transaction on a connection of the driver's."""
    given = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
