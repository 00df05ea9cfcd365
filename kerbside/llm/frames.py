"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.session import checkpoint_dir, cut, ship

__all__ = ["checkpoint_dir", "col", "cut", "fresh", "ids_for_join", "ranked", "ship", "table"]

MAX_BROADCAST = 1 << 25
#: Bytes of the batches that go to Python workers, where the session doesn't say otherwise: texts may be long, and workers keep what memory they once took.
BATCH_BYTES = "8m"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    have = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        found.append(name)
    return found


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name; dots in it are no field access."""
    return df[f"`{name}`"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query; the Python workers get this package first."""
    ship(spark)
    name_ = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name_) == "67108864b":
        spark.conf.set(name_, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_for_join(df: DataFrame, name: str) -> DataFrame:
    """A table of ids, for a join with texts: broadcast if it takes at most MAX_BROADCAST bytes, which is counted, else joined by a shuffle."""
    size = df.agg(F.sum(F.octet_length(F.col(f"`{name}`").cast("string")) + 24)).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def ranked(rows: DataFrame, group: str, order: list[str], per_bucket: int, widest: int) -> DataFrame:
    """rows (group, buckets, c, order's columns, ...), each c equal rows, with the rank from 0 of the first of them in its group.

    A group is cut into ``buckets`` hash buckets by order's first column, so that no task sorts a whole group, however large: ranks
    are the rows before in the bucket and those of the group's earlier buckets. Rows of more than per_bucket equal ones, of
    which the largest has widest, come back in pieces of that many, spread over the tasks.
    """
    keyed = rows.withColumn("bucket", F.expr(f"pmod(`{order[0]}`, buckets)")).drop("buckets")
    totals = keyed.groupBy(group, "bucket").agg(F.sum("c").alias("rows"))
    starts = totals.select(group, "bucket", (F.sum("rows").over(Window.partitionBy(group).orderBy("bucket")) - F.col("rows")).alias("base"))
    here = Window.partitionBy(group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = keyed.join(starts, [group, "bucket"]).withColumn("rank", F.col("base") + F.sum("c").over(here) - F.col("c")).drop("bucket", "base")
    if widest > per_bucket:
        pieces = found.select("*", F.explode(F.expr(f"sequence(0, (c - 1) div {per_bucket})")).alias("part")).repartition(group, *order, "part")
        found = pieces.withColumns({"c": F.expr(f"least({per_bucket}, c - part * {per_bucket})"), "rank": F.expr(f"rank + part * {per_bucket}")}).drop("part")
    return found
