"""Written intermediate tables, and running sums within groups of any size."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range of a group at least, and ranges at most.
RANGE_ROWS, MOST_RANGES = 20_000, 2_000


class Scratch:
    """Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

    A written table cuts lineage as checkpoint() does, is columnar and compressed, and survives lost executors.
    Where a session on one machine sets no folder (as in tests), a folder under its warehouse is used; a cluster must set one.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df under name and return it reread."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Delete all tables, once what was made of them has been written."""
        self.drop("")


def running(df: DataFrame, group: str, order: list[str], weight: Column, name: str, rows: int | None = None) -> DataFrame:
    """df with the sum of weight over the rows before each in its group, in order.

    Groups are cut into ranges of the order at sampled keys: sums run within a range, and each range's offset is added.
    The cuts are fixed values, so a row falls into the same range whenever it is computed; rows of one key stay together.
    """
    spark, keys = df.sparkSession, df.select(group, F.struct(*order).alias("_at"))
    total = keys.count()
    rows = max(rows or RANGE_ROWS, total // MOST_RANGES)
    # Some ten sampled keys a range; every tenth of a group is a cut.
    sampled = keys.sample(min(1.0, 10 / rows), seed=1).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_at"))).where("_n % 10 = 0")
    cuts = sampled.groupBy(group).agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)
    placed = df.join(F.broadcast(cuts), group, "left").withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts",
        lambda c: c <= F.struct(*order))))).drop("_cuts").withColumn("_weight", weight)
    sums = placed.groupBy(group, "_range").agg(F.sum("_weight").alias("_sum"))
    # Only groups that are cut have offsets: as many rows as there are cuts, and one more for each such group.
    before = sums.join(F.broadcast(cuts.select(group)), group, "left_semi").select(group, "_range", F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("_weight").over(Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, inside).join(F.broadcast(before), [group, "_range"], "left").withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_range", "_weight", "_offset")
